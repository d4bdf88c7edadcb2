"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

*Kernel.*  Two strings are alike by the subsequences of ``ORDER`` characters
that they share, each weighed by ``DECAY`` to the power of the span it takes in
either string, normalised to 1 for equal strings.  Inserted characters and gaps
only lengthen spans, so ``id.iot`` and ``idxiot`` stay close to ``idiot``.

*Nyström.*  Landmark strings stand for the kernel's space: those that tell
labelled toxic from other texts best, and the most similar strings of the other
texts.  A string is described by its kernel values with the landmarks, mapped by
the inverse square root of the landmarks' own kernel matrix.

*Machine.*  A linear machine (squared hinge) on those vectors, trained on
labelled sentences.  A sentence scores as its highest string and a text as its
highest sentence, that is, as its highest string; a string scores -1, the margin of the other
side, at least.  Strings whose best match is under ``FLOOR`` are no examples; their scores follow from the weights.  Labels are given per text, so the string of a toxic
text that scores highest is its example, chosen anew in each of ``ROUNDS`` rounds, besides those
that stand out by ``SURE_Z`` standard errors; of other texts every matching
string is one.  Landmark strings that only toxic texts hold are also given with
a character inserted or a letter drawn out.  A logistic curve fitted to
the training texts maps scores to 0..1.

At most ``MAX_LABELLED`` labelled texts of at most ``MAX_FIT_CHARS`` characters
are used for fitting (the documented bound); scoring reads every whole text.

Strings are white-space delimited words without their punctuation, the parts
between it, and runs of single letters joined (``i d i o t``); a string longer than ``WINDOW`` is matched in overlapping
windows.  The kernel is worked out for every string and landmark, without any
screen: an index from subsequences to the landmarks that hold them gives the sums.

Defined cases: a null or empty text has no sentence and gets the score of a
text without any match; rows with a null label are not used for fitting;
without both labels every text scores 0; repeated rows get the same score; a
very long text is scored whole, string by string (only fitting leaves texts
over MAX_FIT_CHARS out); labelled rows beyond the bound are chosen by a hash,
ties by id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import combinations
from string import ascii_lowercase, digits
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, q, slices, texts_of

ORDER = 3
DECAY = 0.7
LANDMARKS = 100
NEAR_MISSES = 200         # landmarks from the other texts
DISGUISED = 150           # landmarks from disguised examples
FLOOR = 0.4
WINDOW = 24
ROUNDS = 4
SURE_Z = 4.0
INSERTIONS = 3            # characters that disguised examples insert at a place, drawn from all letters and digits
DISGUISE_COST = 0.2       # of a disguised example, in plain ones
RIDGE = 0.05
MAX_LABELLED = 4_000
MAX_FIT_CHARS = 20_000
SEED = 5
BLOCK = 8_192            # strings compared with the landmarks at a time
CELLS = 1 << 18           # subsequences of strings, or shares of landmarks in them, held at a time
TABLE = 1 << 22           # largest table of subsequence numbers; beyond it they are searched
MAX_WORDS = 600_000       # strings whose matches a worker keeps; then the table starts anew
_PART = re.compile(r"[^\W_]+")
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_ALPHABET = ascii_lowercase + digits
_PAD = -1


# -- strings of a text
def parts_of(word: str) -> list[str]:
    """The strings of one white-space delimited word."""
    parts = [word] if word.isalnum() else _PART.findall(word)
    if len(parts) > 1:
        parts.append("".join(parts))
    return [w for p in parts for w in windows(p) if len(w) >= ORDER]


def windows(string: str) -> list[str]:
    """A string, or overlapping windows that cover a long one."""
    if len(string) <= WINDOW:
        return [string]
    return [string[i:i + WINDOW] for i in range(0, len(string) - WINDOW // 2, WINDOW // 2)]


def words_of(text: str) -> list[str]:
    """Lower-case words of a whole text, and its runs of single letters as words."""
    words = [w.strip(_EDGES) for w in text.lower().split()]
    if sum(len(w) == 1 for w in words) > 2:
        run: list[str] = []
        for w in [*words, ""]:
            if len(w) == 1 and w.isalpha():
                run.append(w)
            else:
                if len(run) > 2:
                    words.append("".join(run))
                run = []
    return words


# -- kernel
def _codes(items: list[str]) -> np.ndarray:
    width = max(map(len, items), default=1)
    out = np.full((len(items), width), _PAD, np.int32)
    for row, s in zip(out, items):
        row[: len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def subsequence_kernel(a: np.ndarray, b: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted common subsequences of the string pairs ``a`` (n, la) and ``b`` (n, lb).

    The usual recursion over prefixes, run for all pairs at once; padding
    matches nothing.
    """
    n, lb = b.shape
    prefix = np.zeros((order, lb + 1, n), np.float32)
    prefix[0] = 1.0
    total, square, decay = np.zeros(n, np.float32), np.float32(decay * decay), np.float32(decay)
    for col in a.T:
        match = ((b.T == col) & (col != _PAD)).astype(np.float32) * square
        total += np.einsum("jn,jn->n", match, prefix[order - 1, :-1])
        for i in range(order - 1, 0, -1):
            running = np.zeros(n, np.float32)
            prefix[i] *= decay
            for j in range(lb):
                running *= decay
                running += match[j] * prefix[i - 1, j]
                prefix[i, j + 1] += running
    return total


@cache
def _places(width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the subsequences of a string of ``width`` characters, and what each weighs by its span."""
    at = np.array(list(combinations(range(width), ORDER)), np.int64).reshape(-1, ORDER)
    return at, DECAY ** (at[:, -1] - at[:, 0] + 1.0)


class Landmarks:
    """Landmark strings with the index of their subsequences."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        codes = _codes(strings)
        norm = np.sqrt(subsequence_kernel(codes, codes))
        self.letters = np.array(sorted({ord(c) for s in strings for c in s}), np.int32)
        keys, marks, values = [], [], []
        for k, s in enumerate(strings):
            at, value = _places(len(s))
            own, of = np.unique(self._keys(codes[k:k + 1, :len(s)], at)[0], return_inverse=True)
            keys.append(own)
            marks.append(np.full(len(own), k))
            values.append(np.bincount(of, value, len(own)) / norm[k])
        keys, marks, values = map(np.concatenate, (keys, marks, values))
        order = np.argsort(keys, kind="stable")
        # known subsequences, and the landmarks that hold each one: marks[first[t]:first[t + 1]]
        self.known, first = np.unique(keys[order], return_index=True)
        self.first = np.append(first, len(keys))
        self.marks, self.values = marks[order], values[order]
        size = (len(self.letters) + 1) ** ORDER
        self.number = np.full(size, -1, np.int32) if size <= TABLE else None
        if self.number is not None:
            self.number[self.known] = np.arange(len(self.known))

    def _keys(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One number for each subsequence of each string; the last letter stands for any that no landmark has."""
        letter = np.searchsorted(self.letters, codes)
        letter[self.letters[np.minimum(letter, len(self.letters) - 1)] != codes] = len(self.letters)
        key = np.zeros((len(codes), len(at)), np.int64)
        for place in at.T:
            key = key * (len(self.letters) + 1) + letter[:, place]
        return key

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of known subsequences, -1 for others."""
        if self.number is not None:
            return self.number[keys]
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, at, -1)

    def blocks(self, items: list[str]) -> Iterator[tuple[slice, np.ndarray]]:
        """Normalised kernel values of at most BLOCK strings at a time with every landmark."""
        for k in range(0, len(items), BLOCK):
            yield slice(k, min(k + BLOCK, len(items))), self._block(items[k:k + BLOCK])

    def _block(self, items: list[str]) -> np.ndarray:
        out = np.zeros((len(items), len(self.strings)), np.float32)
        codes, width = _codes(items), np.array(list(map(len, items)), np.int64)
        for length in np.unique(width[width >= ORDER]).tolist():
            rows, (at, value) = np.flatnonzero(width == length), _places(length)
            size = max(1, min(1024, CELLS // len(at)))
            for k in range(0, len(rows), size):
                part = rows[k:k + size]
                own = codes[part, :length]
                numbers = self._numbers(self._keys(own, at))
                row, place = np.nonzero(numbers >= 0)
                if len(row):
                    norm = np.sqrt(np.maximum(subsequence_kernel(own, own), 1e-30))
                    out[part] = self._shared(row, numbers[row, place], value[place], len(part)) / norm[:, None]
        return out

    def _shared(self, row: np.ndarray, number: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Sums over the subsequences that each of ``n`` strings shares with each landmark."""
        width = len(self.strings)
        out = np.zeros(n * width)
        count = self.first[number + 1] - self.first[number]
        ends = np.cumsum(count)
        cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], CELLS)), len(row)))
        for a, b in zip(cuts[:-1], cuts[1:]):
            c = count[a:b]
            at = np.arange(c.sum()) + np.repeat(self.first[number[a:b]] - (np.cumsum(c) - c), c)
            out += np.bincount(np.repeat(row[a:b] * width, c) + self.marks[at], np.repeat(value[a:b], c) * self.values[at],
                               len(out))
        return out.reshape(n, width)

    def nearest(self, items: list[str]) -> np.ndarray:
        """Largest kernel value of each string with a landmark."""
        best = np.zeros(len(items))
        for at, values in self.blocks(items):
            best[at] = values.max(axis=1)
        return best

    def matrix(self, items: list[str]) -> np.ndarray:
        """The kernel values as a dense (strings, landmarks) table."""
        out = np.zeros((len(items), len(self.strings)), np.float32)
        for at, values in self.blocks(items):
            out[at] = values
        return out


@dataclass
class Model:
    """Landmarks, the linear machine on kernel values with them, and the logistic curve."""

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: float = 0.0
    offset: float = -50.0

    def __post_init__(self):
        self._known: dict[str, float] = {}
        self._marks = Landmarks(self.landmarks) if self.landmarks else None

    def __reduce__(self):
        return Model, (self.landmarks, self.weights, self.bias, self.slope, self.offset)

    def string_scores(self, items: list[str]) -> np.ndarray:
        """Machine output of each string, -1 at least."""
        total = np.full(len(items), self.bias)
        for at, values in self._marks.blocks(items):
            total[at] += np.einsum("ij,j->i", values, self.weights)     # the same sum in any block
        return np.maximum(total, -1.0)

    def _learn(self, new: set[str]) -> None:
        """Scores of words not met before."""
        words = sorted(new)
        for k in range(0, len(words), 8192):
            part = words[k:k + 8192]
            split = [parts_of(w) for w in part]
            items = sorted({p for ps in split for p in ps})
            score = dict(zip(items, self.string_scores(items).tolist()))
            self._known.update((w, max(map(score.__getitem__, ps), default=-1.0)) for w, ps in zip(part, split))

    def raw(self, texts: list[str]) -> list[float]:
        """Score of each text's highest string."""
        if not self.landmarks:
            return [-1.0] * len(texts)
        split = [set(words_of(t)) for t in texts]
        new = set().union(*split).difference(self._known)
        if len(self._known) + len(new) > MAX_WORDS:
            self._known.clear()
            new = set().union(*split)
        self._learn(new)
        return [max(map(self._known.__getitem__, t), default=-1.0) for t in split]

    def scores(self, texts: list[str]) -> list[float]:
        f = np.clip(self.slope * np.array(self.raw(texts)) + self.offset, -40, 40)
        return (1.0 / (1.0 + np.exp(-f))).tolist()


# -- training
def disguises(string: str) -> list[str]:
    """A string with one character inserted, and with one letter drawn out, at each inner place.

    A hash of string and place draws the characters, so no one character is
    learned as the sign of a disguise.
    """
    drawn = lambda i, k: _ALPHABET[crc32(f"{string} {i} {k}".encode()) % len(_ALPHABET)]
    return [string[:i] + c + string[i:] for i in range(1, len(string))
            for c in (*(drawn(i, k) for k in range(INSERTIONS)), string[i - 1] * 2)]


def associations(bags: list[frozenset[str]], toxic: list[int]) -> dict[str, float]:
    """Standard errors by which a string's share of toxic texts exceeds that of other texts."""
    seen = [Counter(), Counter()]
    for bag, y in zip(bags, toxic):
        seen[y].update(bag)
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)

    def z(w: str) -> float:
        a, b = seen[1][w], seen[0][w]
        p = (a + b) / (n1 + n0)
        return (a / n1 - b / n0) / max(np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0)), 1e-9)

    return {w: z(w) for w in seen[1]}


def _machine(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Squared-hinge linear machine on the examples x[rows], by Newton steps on those inside the margin."""
    w = np.zeros(x.shape[1])
    ridge = RIDGE * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6                                # the bias
    for _ in range(50):
        gram, rhs = ridge.copy(), np.zeros(x.shape[1])
        for k in range(0, len(rows), 4096):             # block by block: memory does not grow with the examples
            part, yk, ck = x[rows[k:k + 4096]].astype(np.float64), y[k:k + 4096], cost[k:k + 4096]
            active = yk * (part @ w) < 1
            part, yk, ck = part[active], yk[active], ck[active]
            gram += (part * ck[:, None]).T @ part
            rhs += (part * ck[:, None]).T @ yk
        new = np.linalg.solve(gram, rhs)
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w


def fit(texts: list[str], toxic: list[int]) -> Model:
    """Train on texts and their labels."""
    if not texts or len(set(toxic)) < 2:
        return Model()
    known: dict[str, str] = {}                          # one object per distinct string
    bags = [frozenset(known.setdefault(p, p) for w in set(words_of(t)) for p in parts_of(w)) for t in texts]
    del known
    z = associations(bags, toxic)
    marks = [w for w in sorted(z, key=lambda w: (-z[w], w)) if z[w] > 0][:LANDMARKS]
    if not marks:
        return Model()
    other = sorted({w for bag, y in zip(bags, toxic) if not y for w in bag})
    like = Landmarks(marks).nearest(other)
    chosen = set(marks)
    marks += [other[i] for i in np.argsort(-like, kind="stable")[:NEAR_MISSES].tolist()
              if like[i] >= FLOOR and other[i] not in chosen]
    clean = {w for bag, y in zip(bags, toxic) if not y for w in bag}
    made = sorted({v for w in marks[:LANDMARKS] if z[w] >= SURE_Z and w not in clean for v in disguises(w)} - clean)
    marks += made[:: max(1, -(-len(made) // DISGUISED))]
    landmarks = Landmarks(marks)
    own = landmarks.matrix(marks).astype(np.float64)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T

    vocabulary = sorted(set().union(*bags, made))
    like = landmarks.nearest(vocabulary)
    matching = [vocabulary[i] for i in np.flatnonzero(like >= FLOOR).tolist()]
    row_of = {w: k for k, w in enumerate(matching)}
    x = np.ones((len(matching), len(marks) + 1), np.float32)
    for k in range(0, len(matching), BLOCK):
        x[k:k + BLOCK, :-1] = landmarks.matrix(matching[k:k + BLOCK]) @ root.astype(np.float32)
    hidden = np.array([row_of[w] for w in made if w in row_of], np.int64)
    against = Counter(row_of[w] for bag, y in zip(bags, toxic) if not y for w in bag if w in row_of)
    negative = np.array(sorted(against), np.int64)
    cost = np.array([against[r] for r in sorted(against)], float)       # texts that hold the string
    witnesses = [[row_of[w] for w in sorted(bag) if w in row_of] for bag, y in zip(bags, toxic) if y]
    witnesses = [rows for rows in witnesses if rows]
    sure = {row_of[w] for w in matching if z.get(w, 0.0) >= SURE_Z}
    pick = [[r for r in rows if r in sure] for rows in witnesses]
    w = np.zeros(x.shape[1])
    for _ in range(ROUNDS):
        positive = np.array([r for rs in pick for r in rs], np.int64)
        sign = np.concatenate([np.ones(len(positive) + len(hidden)), -np.ones(len(negative))])
        weight = np.concatenate([np.ones(len(positive)), np.full(len(hidden), DISGUISE_COST), cost])
        w = _machine(x, np.concatenate([positive, hidden, negative]), sign, weight)
        f = x @ w
        pick = [sorted({max(rows, key=lambda r: f[r]), *sure.intersection(rows)}) for rows in witnesses]
    model = Model(marks, root @ w[:-1], float(w[-1]))
    model.slope, model.offset = _logistic(np.array(model.raw(texts)), np.array(toxic, float))
    return model


def _logistic(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(y | f), with smoothed targets, by damped Newton steps."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.column_stack([f, np.ones(len(f))])
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    loss = lambda v: float(np.logaddexp(0, x @ v).sum() - t @ (x @ v) + 1e-3 * v @ v)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2), x.T @ (p - t) + 2e-3 * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


# -- Spark
def fold(id_column: Column) -> Column:
    """The contract's fold of a document: crc32 of its id as text, modulo 5 (0: held out)."""
    return F.crc32(id_column.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = MAX_LABELLED, seed: int = SEED) -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold."""
    use = (fold(F.col("doc_id")) != 0) & F.col("toxic").isNotNull()
    chosen = labelled_sample(labels, use, [F.max("toxic").alias("toxic")], max_labelled, seed)
    rows = docs.select(q(id_col).alias("doc_id"), q(text_col).cast("string").alias("text")).where(
        F.length("text") <= MAX_FIT_CHARS).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    data = sorted((r["text"], int(r["toxic"] == 1)) for r in rows.collect())
    return fit([t for t, _ in data], [y for _, y in data])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for b in slices(batches, 512):
            values = machine.scores(texts_of(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).cast("string").alias("text")).mapInArrow(
        run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
