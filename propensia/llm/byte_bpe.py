"""Byte-level BPE by monoid tree reduction.

A text's encoding is a tree: leaves of at most LEAF_CHARS characters are encoded
directly, a node joins the encodings of its two halves.  Joining happens on
three levels.

*Between spaces.*  In a text whose white space is single spaces and line feeds
no match runs over a space into the text before it, and none looks further than
the space behind it.  So what a space begins is stable as soon as the next
space is known: a node holds the open text before its first space, the ids
between, and the open text from its last space on, and a join encodes only the
window from the last space of the left half to the first space of the right.

*Between pieces* (matches of the pattern).  A match depends on the text from
its start to at most ``LOOKAHEAD`` characters behind its start or one behind
its end, never on what precedes it.  So all pieces of the left half that end
more than ``LOOKAHEAD`` characters before the cut are final; the text from the
first other piece on is matched again, in a window that grows until a match
ends where the right half has a piece boundary too -- from there on both
agree.  Only the pieces inside that window are encoded again.

*Inside a piece* (a run longer than ``LEAF_BYTES``).  A token sequence is the
BPE encoding of its bytes exactly if each two neighbours, encoded together,
give themselves.  The windows around the cut grow until the encoding of the
window begins with the first token and ends with the last token of the window
before; then every pair on either side is one that was already proven, so the
tokens outside cannot change.

Decoding concatenates byte strings up the same kind of tree; a leaf gathers the
bytes of its tokens in one pass over an array.

Defined cases: a null text counts as empty; the empty text has no tokens;
special strings inside a text are ordinary text; repeated rows are encoded one
by one; a very long text, with or without spaces, is one row whose joins look at
windows only; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import q, slices, texts_of

LEAF_CHARS = 1 << 8       # a text up to this length is encoded in one go
LEAF_BYTES = 1 << 10      # a piece up to this length is merged in one go
LOOKAHEAD = 3             # the longest alternative of fixed length in the pattern ('re)
CACHED_PIECES = 50_000    # pieces whose ids are remembered per worker; then the memory starts anew
CACHED_CHUNKS = 250_000   # the same for texts between two spaces
LEAF_IDS = 1 << 15


class Chunks(dict):
    """Text between two single spaces -> ids of a space and that text, packed as 4-byte numbers."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        packed = self.codec.packed(" " + chunk)
        if len(chunk) <= 64:
            self[chunk] = packed
        return packed


class Codec:
    """Ranks, pattern and the tree reductions of one vocabulary."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.n_joins = 0
        sizes = np.zeros(max(self.bytes_of, default=-1) + 1, np.int64)
        for i, b in self.bytes_of.items():
            sizes[i] = len(b)
        self._sizes, self._starts = sizes, np.cumsum(sizes) - sizes
        self._all_bytes = np.frombuffer(b"".join(self.bytes_of[i] for i in sorted(self.bytes_of)), np.uint8)
        self.pattern = regex.compile(pattern)
        self._known: dict[str, list[int]] = {}
        self._chunks = Chunks(self)

    @cached_property
    def _merge(self) -> Callable[[bytes], list[int]]:
        """BPE of a short piece; a worker that only decodes never builds the tables."""
        ranks = {b: i for i, b in self.bytes_of.items()}
        return tiktoken.Encoding("ranks", pat_str=self.pattern.pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    # -- inside a piece
    def merge(self, data: bytes) -> list[int]:
        """BPE of one piece: halves, then the growing boundary window."""
        if len(data) <= LEAF_BYTES:
            return self._merge(data)
        half = len(data) // 2
        return self.join_tokens(self.merge(data[:half]), self.merge(data[half:]))

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """Encoding of the concatenation of two pieces' bytes, given theirs."""
        n = 4
        while True:
            left, right = a[-n:], b[:n]
            window = b"".join(map(self.bytes_of.__getitem__, left + right))
            tokens = self._merge(window)
            first = len(left) == len(a) or tokens[0] == left[0]
            last = len(right) == len(b) or tokens[-1] == right[-1]
            if first and last and (len(tokens) > 1 or (len(left) == len(a) and len(right) == len(b))):
                return a[:len(a) - len(left)] + tokens + b[len(right):]
            n *= 2

    # -- between pieces
    def _ids(self, piece: str) -> list[int]:
        ids = self._known.get(piece)
        if ids is None:
            ids = self.merge(piece.encode("utf-8"))
            if len(piece) <= 64:
                if len(self._known) >= CACHED_PIECES:
                    self._known.clear()
                self._known[piece] = ids
        return ids

    def _leaf(self, text: str) -> tuple[list[str], list[list[int]]]:
        pieces = self.pattern.findall(text)
        return pieces, [self._known.get(p) or self._ids(p) for p in pieces]

    def _node(self, text: str) -> tuple[list[str], list[list[int]]]:
        """Pieces of a text and the ids of each."""
        if len(text) <= LEAF_CHARS:
            return self._leaf(text)
        half = len(text) // 2
        return self._join(self._node(text[:half]), self._node(text[half:]))

    def _join(self, a: tuple, b: tuple) -> tuple[list[str], list[list[int]]]:
        self.n_joins += 1
        (ap, ai), (bp, bi) = a, b
        keep, open_chars = len(ap), 0
        while keep and open_chars <= LOOKAHEAD:      # pieces ending within LOOKAHEAD of the cut are not final
            keep -= 1
            open_chars += len(ap[keep])
        head = "".join(ap[keep:])
        taken, size = 0, 1
        while True:
            more = min(len(bp), taken + size)
            window = head + "".join(bp[:more])
            bounds, at = {}, len(head)               # right-half boundaries inside the window, as offsets
            for k in range(more):
                bounds[at] = k
                at += len(bp[k])
            whole = more == len(bp)
            limit = len(window) if whole else len(window) - LOOKAHEAD - 1
            pieces, pos = [], 0
            for m in self.pattern.finditer(window):
                if pos >= len(head) and pos in bounds and pos <= limit:
                    k = bounds[pos]
                    return self._splice(a, keep, pieces, b, k)
                if m.end() > limit and not whole:
                    break
                pieces.append(m[0])
                pos = m.end()
            if whole:
                return self._splice(a, keep, pieces, b, len(bp))
            taken, size = more, size * 2

    def _splice(self, a: tuple, keep: int, pieces: list[str], b: tuple, k: int) -> tuple[list[str], list[list[int]]]:
        """Ids of the re-matched pieces; a long piece that spans the cut is joined from its halves' tokens."""
        (ap, ai), (bp, bi) = a, b
        ids = []
        for p in pieces:
            if len(p) > LEAF_BYTES and len(ap) > keep and bp and p == ap[-1] + bp[0] and len(ap) - keep == 1:
                ids.append(self.join_tokens(ai[-1], bi[0]))
            else:
                ids.append(self._ids(p))
        del ap[keep:], ai[keep:]
        ap += pieces
        ai += ids
        ap += bp[k:]
        ai += bi[k:]
        return ap, ai

    def packed(self, text: str) -> bytes:
        """Ids of a text as 4-byte numbers."""
        if len(text) <= LEAF_CHARS:
            known = self._known.get
            return array("i", [i for p in self.pattern.findall(text) for i in known(p) or self._ids(p)]).tobytes()
        return np.array([i for ids in self._node(text)[1] for i in ids], np.int32).tobytes()

    # -- between spaces
    def _spaced(self, text: str) -> tuple[str, list[bytes] | None, str]:
        """(text before the first space, ids between, text behind the last space); without a space only the first."""
        if len(text) <= LEAF_CHARS:
            head, *rest = text.split(" ")
            if not rest:
                return head, None, ""
            return head, list(map(self._chunks.__getitem__, rest[:-1])), rest[-1]
        half = len(text) // 2
        return self._join_spaced(self._spaced(text[:half]), self._spaced(text[half:]))

    def _join_spaced(self, a: tuple, b: tuple) -> tuple[str, list[bytes] | None, str]:
        self.n_joins += 1
        (a_head, a_ids, a_tail), (b_head, b_ids, b_tail) = a, b
        if a_ids is None:
            return a_head + b_head, b_ids, b_tail
        if b_ids is None:
            return a_head, a_ids, a_tail + b_head
        a_ids.append(self._chunks[a_tail + b_head])
        a_ids += b_ids
        return a_head, a_ids, b_tail

    def encode(self, text: str) -> np.ndarray:
        """Token ids of a whole text."""
        if " ".join(text.split()) == text.replace("\n", " "):
            head, ids, tail = self._spaced(text)
            whole = self.packed(head) if ids is None else b"".join([self.packed(head), *ids, self._chunks[tail]])
            return np.frombuffer(whole, np.int32)
        return np.frombuffer(self.packed(text), np.int32)

    def decode_leaf(self, ids: np.ndarray) -> bytes:
        """The bytes of the tokens, one gather."""
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self._all_bytes[np.repeat(self._starts[ids] - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        ids = np.asarray(ids, dtype=np.int64)
        if len(ids) <= LEAF_IDS:
            return self.decode_leaf(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>): the token ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, 512):
            ids = [c.encode(t) for t in texts_of(b.column(1))]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "ids"])

    return docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Append ``decoded`` (binary) to the columns of ``encoded``, which holds ``ids``."""
    cols = keep or encoded.columns
    chosen = encoded.select(*[q(c) for c in cols])
    at = cols.index("ids")
    schema = T.StructType([*chosen.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in slices(batches, 512):
            ids = b.column(at)
            values, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
            out = [c.decode(values[i:j]) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=schema.names)

    return chosen.mapInArrow(run, schema)


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded and decoded documents."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
