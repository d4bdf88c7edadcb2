"""Token counts by a compiled finite-state transducer.

The tokenizer file (white-space split words, byte-level BPE with word ends) is
compiled into a deterministic transducer whose transitions carry the number of
tokens that they emit; counting a text is one walk over its characters, without
any token being built.

*Word machine.*  A state is the set of still possible token starts of the
running word: (trie node reached since that start, last token before it, tokens
before it relative to now).  A token may end here if it and the last token
before its start are neighbours that BPE leaves as they are; exactly one does,
so the state is deterministic.  A state also holds how many tokens more there
are if the word ends here, since a word's last byte is a symbol of its own.

*Text machine.*  Adds the split rules: letter runs, single digits, runs of
other characters, and the contractions that begin at an apostrophe.

States are made when a walk first needs them and forgotten all at once when
``MAX_STATES`` exist, as lazily built automata do; results do not depend on it.
White space resets the machine, so a word met before is one transition.

*Chunks.*  A long text is cut into chunks that tasks walk independently.  A
chunk that starts in an unknown state is mapped to a state map: the text up to
its first white space, which alone depends on the entry state (behind it every
state meets), the tokens emitted after that, and the state it ends in, written
as the text that leads there.  State maps form a monoid; a parallel prefix scan
over (document, chunk) composes them.

Defined cases: a null text counts as empty (0 tokens); the tokenizer's special
strings count as one token each, as its library's default does; repeated rows
are counted one by one; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import q, slices

CHUNK_CHARS = 1 << 16
MAX_STATES = 120_000      # states kept by a worker; then the table starts anew
MAX_WORDS = 300_000       # whole words kept by a worker
BLOCK = 64                # chunks composed per task and level of the scan

# FIXED VALUES: the contractions of the tokenizer's split pattern
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")

# A chunk may only begin at an ASCII character that no composed character and no special string runs through.
CHUNKS = f"(?s).{{1,{CHUNK_CHARS}}}[|>a-z[^\\x00-\\x7F]]*+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], extra = chr(extra), extra + 1
    return [table[b] for b in range(256)]


_SPACE, _LETTER, _DIGIT = (regex.compile(x) for x in (r"\p{White_Space}", r"\p{L}", r"\p{N}"))
_LAST_SPACE = regex.compile(r"(?r)\p{White_Space}")


@lru_cache(maxsize=1 << 16)
def kind_of(ch: str) -> str:
    return "space" if _SPACE.match(ch) else "letter" if _LETTER.match(ch) else "digit" if _DIGIT.match(ch) else "other"


class State(dict):
    """A state of the text machine: character -> (next state, tokens emitted)."""

    __slots__ = ("machine", "mode", "items", "final")

    def __init__(self, machine, mode, items=(), final=0):
        super().__init__()
        self.machine, self.mode, self.items, self.final = machine, mode, items, final

    def __missing__(self, ch):
        step = self.machine.step(self, ch)
        self[ch] = step
        return step


class Words(dict):
    """Transitions of the start state over whole white-space delimited strings: string -> tokens emitted."""

    __slots__ = ("machine",)

    def __init__(self, machine):
        super().__init__()
        self.machine = machine

    def __missing__(self, word):
        if len(self) >= MAX_WORDS:
            self.clear()
        state, n = self.machine.walk(self.machine.start, word)
        n += self.machine.close(state)
        if len(word) <= 64:
            self[word] = n
        return n


class Transducer:
    """Compiled from a tokenizer file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")
        symbols = byte_symbols()
        base = {s: i for i, s in enumerate(symbols)} | {s + self.suffix: 256 + i for i, s in enumerate(symbols)}
        # tokens are numbered in the order in which merges make them
        tokens = dict(base)
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(512)]
        for m in model["merges"]:
            x, y = m if isinstance(m, list) else m.split(" ")
            new = tokens.setdefault(x + y, len(tokens))
            if new == len(self.halves):
                self.halves.append((tokens[x], tokens[y]))
            self.merged.setdefault((tokens[x], tokens[y]), new)
        # the trie over symbols 0-255 (byte) and 256-511 (last byte of a word); node -> {symbol: node}, node -> token
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for t, number in tokens.items():
            end = t.endswith(self.suffix) and t != self.suffix
            body = t[: -len(self.suffix)] if end else t
            node = 0
            for k, c in enumerate(body):
                code = base[c] + (256 if end and k == len(body) - 1 else 0)
                nxt = self.trie[node].get(code)
                if nxt is None:
                    nxt = self.trie[node][code] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = nxt
            self.token_at[node] = number
        self._pairs: dict[tuple[int, int], bool] = {}
        self.words = Words(self)
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self.state("idle")
        if len(self._pairs) > 4 * MAX_STATES:
            self._pairs.clear()

    def state(self, mode: str, items: tuple = (), final: int = 0) -> State:
        key = (mode, items, final)
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = State(self, mode, items, final)
        return s

    # -- word machine
    def neighbours(self, a: int, b: int) -> bool:
        """True if BPE leaves the token pair as it is.

        Merges are undone from the latest back; the pair falls if, at any such
        moment, a merge across the seam came before the one just undone.
        """
        known = self._pairs.get((a, b))
        if known is None:
            x, y, limit = a, b, len(self.halves) + 1
            while True:
                across = self.merged.get((x, y))
                if across is not None and across < limit:
                    known = False
                    break
                if max(x, y) < 512:
                    known = True
                    break
                if x > y:
                    limit, x = x, self.halves[x][1]
                else:
                    limit, y = y + 1, self.halves[y][0]
            self._pairs[a, b] = known
        return known

    def push(self, items: tuple, code: int) -> tuple[tuple, int]:
        """(items behind one more symbol, tokens emitted by it); () is the start of a word.

        An item is (trie node since a start, last token before that start or
        -1, tokens before that start minus tokens now).
        """
        alive, last, total = [], -1, None
        for node, before, rel in items or ((0, -1, 0),):
            nxt = self.trie[node].get(code)
            if nxt is None:
                continue
            token = self.token_at[nxt]
            if total is None and token >= 0 and (before < 0 or self.neighbours(before, token)):
                last, total = token, rel + 1
            if self.trie[nxt]:
                alive.append((nxt, before, rel))
        return tuple([(n, t, r - total) for n, t, r in alive] + [(0, last, 0)]), total

    def _char(self, items: tuple, ch: str) -> tuple[tuple, int, int]:
        """(items behind a character, tokens emitted, tokens more if the word ends with it)."""
        n = total = 0
        before, b = items, 0
        for b in ch.encode("utf-8"):
            before = items
            items, total = self.push(items, b)
            n += total
        return items, n, self.push(before, 256 + b)[1] - total

    # -- text machine
    def close(self, s: State) -> int:
        """Tokens emitted when the running word ends in ``s``."""
        if not s.mode.startswith("'"):
            return s.final
        return sum(sum(self._char((), ch)[1:]) for ch in s.mode)    # an apostrophe, then a contraction's start

    def step(self, s: State, ch: str) -> tuple[State, int]:
        kind = kind_of(ch)
        if s.mode.startswith("'"):
            tail = s.mode[1:] + ch
            if tail in CONTRACTIONS:
                return self.start, self._contraction("'" + tail)
            if any(c.startswith(tail) for c in CONTRACTIONS):
                return self.state("'" + tail), 0
            items, n, final = self._char((), "'")
            run = self.state("other", items, final)
            for x in tail:                               # the apostrophe stands alone or begins a run
                run, k = self.step(run, x)
                n += k
            return run, n
        if s.mode == kind and kind in ("letter", "other"):
            items, n, final = self._char(s.items, ch)
            return self.state(kind, items, final), n
        closing = self.close(s)
        if kind == "space":
            return self.start, closing
        if ch == "'":
            return self.state("'"), closing
        items, n, final = self._char((), ch)
        if kind == "digit":
            return self.start, closing + n + final
        return self.state(kind, items, final), closing + n

    def _contraction(self, word: str) -> int:
        items, n, final = (), 0, 0
        for ch in word:
            items, k, final = self._char(items, ch)
            n += k
        return n + final

    # -- walks over normalised text
    def walk(self, state: State, text: str) -> tuple[State, int]:
        if len(self.states) > MAX_STATES:
            mode, items, final = state.mode, state.items, state.final
            self.reset()
            state = self.state(mode, items, final)
        n = 0
        for ch in text:
            state, k = state[ch]
            n += k
        return state, n

    def count(self, text: str) -> int:
        """Tokens of normalised text without special strings, from the start to its end.

        White space leads every state to the start state, so the walk takes one
        transition per string between white space where such strings recur.
        """
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):     # split() takes these for white space, the tokenizer does not
            state, n = self.walk(self.start, text)
            return n + self.close(state)
        return sum(map(self.words.__getitem__, text.split()))

    def count_raw(self, raw: str) -> int:
        """Tokens of one whole text."""
        if not any(x in raw for x in self.specials):
            return self.count(self.normalise(raw))
        return len(self.special.findall(raw)) + sum(self.count(self.normalise(x)) for x in self.special.split(raw))

    @staticmethod
    def normalise(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:                         # the library lowers each character by itself
                text = text.replace("Σ", "σ")
        return text.lower()

    def state_map(self, raw: str) -> tuple[str, int, str, bool]:
        """(head, tokens behind it, tail, synced) of a chunk of raw text; see ``compose``."""
        parts, at = [], 0
        for m in self.special.finditer(raw):
            parts.append((raw[at:m.start()], 1))
            at = m.end()
        parts.append((raw[at:], 0))
        head, total, tail, synced = self._plain_map(self.normalise(parts[0][0]))
        for k, (segment, _) in enumerate(parts[1:], 1):
            # a special string ends the running word: it acts as a white space that emits one token
            if not synced:
                head, total, synced = head + " ", 0, True
            else:
                total += self.count(tail)
            total += 1
            h, t, tail, s = self._plain_map(self.normalise(segment))
            if s:
                total += self.count(h) + t
            else:
                tail = h
        return head, total, tail, synced

    def _plain_map(self, text: str) -> tuple[str, int, str, bool]:
        m = _SPACE.search(text)
        if m is None:
            return text, 0, "", False
        head, body = text[:m.end()], text[m.end():]
        end = _LAST_SPACE.search(body)
        cut = end.end() if end else 0
        return head, self.count(body[:cut]), body[cut:], True

    def compose(self, a: tuple, b: tuple) -> tuple[str, int, str, bool]:
        """The state map of two neighbouring chunks (associative)."""
        if not a[3]:
            return a[0] + b[0], b[1], b[2], b[3]
        if not b[3]:
            return a[0], a[1], a[2] + b[0], True
        return a[0], a[1] + self.count(a[2] + b[0]) + b[1], b[2], True

    def finish(self, m: tuple) -> int:
        """Tokens of a whole text from its state map: enter at the start, close at the end."""
        return (self.count(m[0]) + m[1] + self.count(m[2])) if m[3] else self.count(m[0])


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


_MAP = "doc long, row long, chunk int, n_bytes long, head string, total long, tail string, synced boolean"
_MAP_NAMES = [x.split(" ")[0] for x in _MAP.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
    cols = list(zip(*rows)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=_MAP_NAMES)


def state_maps(chunks: DataFrame, path: str) -> DataFrame:
    """State map of every chunk (doc, row, chunk, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            ids, rows, nos, texts = (b.column(k).to_pylist() for k in range(4))
            yield _batch([(d, r, k, len(x.encode("utf-8")), *t.state_map(x)) for d, r, k, x in zip(ids, rows, nos, texts)])

    return chunks.mapInArrow(run, _MAP)


def scan_level(maps: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """One level of the scan: neighbouring maps of one document and block composed into one."""
    parts = int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocked = maps.withColumn("_block", F.floor(F.col("chunk") / block).cast("int"))
    ordered = blocked.repartition(parts, "row", "_block").sortWithinPartitions("row", "_block", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, now = transducer(path), None              # now: [doc, row, block, bytes, map]
        for b in batches:
            out = []
            for doc, row, _, size, head, total, tail, synced, blk in zip(*(c.to_pylist() for c in b.columns)):
                m = (head, total, tail, synced)
                if now is not None and now[1:3] == [row, blk]:
                    now[3] += size
                    now[4] = t.compose(now[4], m)
                else:
                    if now is not None:
                        out.append((*now[:4], *now[4]))
                    now = [doc, row, blk, size, m]
            if out:
                yield _batch(out)
        if now is not None:
            yield _batch([(*now[:4], *now[4])])

    return ordered.select(*_MAP_NAMES, "_block").mapInArrow(run, _MAP)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every whole text.

    Documents of one chunk are finished where they are read.  Only the state
    maps of longer ones (a few bytes per chunk) meet, over three levels of
    ``BLOCK`` chunks each, which covers any text that fits a Spark string.
    """
    rows = docs.select(q(id_col).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(q(text_col).cast("string"), F.lit("")).alias("text"))
    fits = F.length("text") <= CHUNK_CHARS
    chunks = rows.where(~fits).select("doc", "row", F.posexplode(
        F.regexp_extract_all("text", F.lit(CHUNKS), F.lit(0))).alias("chunk", "text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    maps = state_maps(chunks.repartition(parts, "row", "chunk"), path)
    for _ in range(3):
        maps = scan_level(maps, path)
    schema = "doc_id long, n_bytes long, n_tokens long"

    def result(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "n_bytes", "n_tokens"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            yield result([(d, n, t.finish((h, k, e, s))) for d, _, _, n, h, k, e, s in zip(*cols)])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(path)
        for b in slices(batches):
            yield result([(d, len(x.encode("utf-8")), t.count_raw(x)) for d, x in zip(*(c.to_pylist() for c in b.columns))])

    short = rows.where(fits).select("doc", "text")
    return short.mapInArrow(whole, schema).unionByName(maps.mapInArrow(finish, schema))
