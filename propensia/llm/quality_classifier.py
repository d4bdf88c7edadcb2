"""Quality classifier by importance resampling.

Two generative models over hashed n-grams -- one of the target text (labelled
good documents), one of all raw text -- give each document the log of its
importance weight, the sum of log(target / raw) over its n-grams.  Adding
Gumbel noise and keeping the k largest draws k documents without replacement in
proportion to their weights.

N-grams are hashed unigrams and bigrams of runs of letters and digits or of
punctuation; a token that repeats the one before it gives a bigram of its own
kind, so that stuttering is one feature.  Raw counts cover all documents; the
target model may use at most ``max_labelled`` labelled rows (the documented
bound).  Raw counts are scaled to the target's size and both sides get the same
pseudo-count, so an n-gram too rare to judge weighs nothing.

k is ``keep_share`` of the documents; with None it is the labelled share of
good rows plus ``SLACK``, so that rare good text is not what the cut falls on.  The k-th key is found by counting keys in ever finer bins (never a
global sort); rows that tie with it stay.

Defined cases: a null or empty text has log weight 0; repeated rows get the
same noise, hence the same verdict (the noise depends on seed, id and text);
labels that are null are not used; without any good label all weights are 0,
and without any label all documents stay;
an empty table gives an empty result; other columns are passed through by
``select_documents`` and ignored by ``score``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, fresh, labelled_sample, q, slices, texts_of, written

BUCKETS = 1 << 16
MAX_WORDS = 200_000       # whole words whose hashes a worker keeps
PSEUDO = 2.0
MAX_LABELLED = 20_000
SEED = 17
SLACK = 0.02              # of the documents, kept beyond the labelled share of good rows
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_BINS = 1024
_MIX = np.uint64(0x9E3779B97F4A7C15)
_AGAIN = np.uint64(0xD1B54A32D192ED03)      # the bigram of a token and itself
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


class WordTokens(dict):
    """White-space delimited string -> the 8-byte hashes of its tokens; starts anew at a bound."""

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.clear()
        tokens = b"".join(xxhash.xxh3_64_digest(t.encode("utf-8")) for t in _TOKEN.findall(word))
        if len(word) <= 64:
            self[word] = tokens
        return tokens


_words = WordTokens()


def buckets(text: str) -> np.ndarray:
    """Bucket numbers of the unigrams and bigrams of a whole text."""
    h = np.frombuffer(b"".join(map(_words.__getitem__, text.split())), np.uint64)
    if not len(h):
        return np.zeros(0, np.int64)
    first, second = h[:-1], h[1:]
    pairs = np.where(first == second, _AGAIN, (first * _MIX) ^ (second + (first >> np.uint64(29))))
    mixed = np.concatenate((h, pairs)) * _MIX >> _SHIFT
    return mixed.view(np.int64)


def ngram_counts(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """(target, raw) bucket counts; the raw ones over every document.

    Each task sums its documents into ``BUCKETS`` cells; the cells meet in one
    aggregation, and 2 x BUCKETS numbers reach the driver whatever the corpus.
    ``target_ids`` is bounded by MAX_LABELLED, hence broadcast.
    """
    flagged = docs.select(q(id_col).alias("doc_id"), q(text_col).cast("string").alias("text")).join(
        F.broadcast(target_ids.withColumn("good", F.lit(True))), "doc_id", "left").select(
        "text", F.coalesce("good", F.lit(False)).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in slices(batches):
            marked = list(zip(map(buckets, texts_of(b.column(0))), b.column(1).to_pylist()))
            for counts, chosen in ((raw, marked), (target, [x for x in marked if x[1]])):
                if chosen:
                    counts += np.bincount(np.concatenate([ids for ids, _ in chosen]), minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(target[used]), pa.array(raw[used])],
                                         names=["bucket", "target", "raw"])

    cells = flagged.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw")).toPandas()
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    target[cells.bucket], raw[cells.bucket] = cells.target, cells.raw
    return target, raw


def log_ratios(target: np.ndarray, raw: np.ndarray, pseudo: float = PSEUDO) -> np.ndarray:
    """log(target / raw) per bucket, with raw counts scaled to the target's size; 0 without a target."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + pseudo) / (raw * (target.sum() / raw.sum()) + pseudo))


def _gumbel(seed: int, *columns: Column) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def with_keys(docs: DataFrame, labels: DataFrame, names: tuple[str, str], id_col: str = "doc_id", text_col: str = "text",
              max_labelled: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """``docs`` with the log weight and the sampling key (log weight plus Gumbel noise) appended."""
    good = labelled_sample(labels, F.col("quality").isNotNull(), [F.max("quality").alias("quality")], max_labelled, seed)
    good = written(good.where("quality = 1").select("doc_id"), "quality_target")
    ratios = log_ratios(*ngram_counts(docs, good, id_col, text_col))
    weights = docs.sparkSession.sparkContext.broadcast(ratios)
    at = docs.columns.index(text_col)

    def columns(b: pa.RecordBatch) -> list:
        w = weights.value
        return [pa.array([float(w[buckets(t)].sum()) for t in texts_of(b.column(at).cast(pa.string()))], pa.float64())]

    scored = append_columns(docs, [T.StructField(names[0], T.DoubleType())], columns)
    noise = _gumbel(seed, F.coalesce(q(id_col).cast("string"), F.lit("")), F.coalesce(q(text_col), F.lit("")))
    return scored.withColumn(names[1], F.col(names[0]) + noise)


def kth_largest(keys: DataFrame, key: str, k: int) -> float | None:
    """The k-th largest value of a column: bins are counted and the bin that holds it is cut again."""
    span = keys.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(key).alias("n")).first()
    if not span["n"] or k < 1:
        return None
    if k >= span["n"]:
        return span["lo"]
    lo, hi = span["lo"], span["hi"]
    while lo < hi:
        width = (hi - lo) / _BINS
        at = F.least(F.floor((F.col(key) - F.lit(lo)) / F.lit(width)), F.lit(_BINS - 1)) if width > 0 else F.lit(0)
        cells = keys.where(F.col(key).between(lo, hi)).groupBy(at.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for cell in sorted(cells, key=lambda c: -c["hi"]):
            if k <= cell["n"]:
                break
            k -= cell["n"]
        if (cell["lo"], cell["hi"]) == (lo, hi):      # neighbouring doubles: settle them one by one
            top = keys.where(F.col(key) == hi).count()
            return hi if k <= top else lo
        lo, hi = cell["lo"], cell["hi"]
    return lo


def _cut(keys: DataFrame, key: str, labels: DataFrame, keep_share: float | None) -> float | None:
    if keep_share is None:
        share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
        keep_share = 1.0 if share is None else min(1.0, share + SLACK)
    return kth_largest(keys, key, math.ceil(keep_share * keys.count()))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          keep_share: float | None = None, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, log_weight, sample_key, kept."""
    narrow = docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text"))
    keyed = with_keys(narrow, labels, ("log_weight", "sample_key"), "doc_id", "text", max_labelled, seed)
    keys = written(keyed.select("doc_id", "log_weight", "sample_key"), "quality_keys")
    cut = _cut(keys, "sample_key", labels, keep_share)
    return keys.withColumn("kept", F.col("sample_key") >= F.lit(cut) if cut is not None else F.lit(False))


def select_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     keep_share: float | None = None, max_labelled: int = MAX_LABELLED, seed: int = SEED) -> DataFrame:
    """The sampled documents, with the columns they came with."""
    names = []
    for base in ("_weight", "_key"):
        names.append(fresh(docs.columns + names, base))
    keyed = written(with_keys(docs, labels, tuple(names), id_col, text_col, max_labelled, seed), "quality_documents")
    cut = _cut(keyed.select(names[1]), names[1], labels, keep_share)
    kept = keyed.where(F.col(names[1]) >= F.lit(cut) if cut is not None else F.lit(False))
    return kept.select(*[q(c) for c in docs.columns])
