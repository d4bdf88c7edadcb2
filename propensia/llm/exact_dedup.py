"""Exact dedup: an extendible-hash index on shared files.

1. *Record file.*  One Arrow pass normalises each text (white space deleted),
   hashes it to a 64-bit key and writes documents and keys as one table in the
   shared folder.  Texts equal inside an Arrow batch are collapsed to one index
   entry there (bytes compared), so a group of copies that holds a third of all
   rows reaches its owner as one entry per batch, not one per row.
2. *Directory.*  Entries are counted by the top bits of their key; while a
   bucket is overfull and its keys differ in the next bit, the directory
   doubles and the bucket splits.  The directory has about
   entries / ``bucket_entries`` cells, whatever the texts' size.
3. *Owners.*  Only keys with two or more entries need a comparison.  Their
   texts are range-partitioned by (bucket, key): each owner task reads its key
   range in order, chains entries whose bytes differ under one key, and gives
   every entry its place in the chain.
4. *Verdict.*  Per (key, chain place) the row with the most code points, then
   the smallest doc_id, then the first row, stays.

Defined cases: a null text counts as empty; texts without any visible
character are equal to each other; a null doc_id loses against any other;
rows repeated with one doc_id are rows of their own (one of them stays); a very
long text is one entry, compared byte by byte; an
empty table gives an empty result; other columns, whatever their names, are
passed through by ``dedup`` and ignored by ``classes``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bytes_of, fresh, q, written

DELETED = b" \t\n\x0b\x0c\r"
BUCKET_ENTRIES = 200_000
COLLAPSE_ROWS = 10_000    # rows among which equal texts become one index entry
_FIRST_DEPTH = 4


def normalise(text: bytes) -> bytes:
    return text.translate(None, DELETED)


def _key(norm: bytes, bits: int) -> int:
    """Signed 64-bit key whose top ``bits`` bits carry the hash (fewer only in tests)."""
    h = xxhash.xxh3_64_intdigest(norm) >> (64 - bits) << (64 - bits)
    return h - (1 << 64) if h >= 1 << 63 else h


def _index_rows(docs: DataFrame, id_col: str, text_col: str, key_bits: int, n: dict) -> DataFrame:
    """Documents with row id, key, digest, and the batch-local entry they collapse to."""
    with_row = docs.withColumn(n["row"], F.monotonically_increasing_id())
    at_row, at_text, at_id = (with_row.columns.index(c) for c in (n["row"], text_col, id_col))

    def columns(b: pa.RecordBatch) -> list:
        rows, ids = b.column(at_row).to_pylist(), b.column(at_id).to_pylist()
        texts = bytes_of(b.column(at_text).cast(pa.string()))
        seen: dict[bytes, list] = {}   # normalised text -> [entry row, best (-chars, id), best row, count]
        entry_of, keys, digests, chars, best = [], [], [], [], []
        for row, doc, text in zip(rows, ids, texts):
            norm = normalise(text)
            n_chars = len(text.decode("utf-8"))
            rank = (-n_chars, doc is None, doc if doc is not None else 0, row)
            e = seen.get(norm)
            if e is None:
                digest = hashlib.sha256(norm).hexdigest()
                e = seen[norm] = [row, rank, 0, _key(norm, key_bits), digest]
            e[1] = min(e[1], rank)
            e[2] += 1
            entry_of.append(e)
            chars.append(n_chars)
        for e in entry_of:
            keys.append(e[3])
            digests.append(e[4])
            best.append(e[1])
        return [
            pa.array(keys, pa.int64()), pa.array(digests, pa.string()),
            pa.array([e[0] for e in entry_of], pa.int64()),
            pa.array([e[2] for e in entry_of], pa.int64()),
            pa.array([-x[0] for x in best], pa.int64()),
            pa.array([None if x[1] else x[2] for x in best], pa.int64()),
            pa.array([x[3] for x in best], pa.int64()),
        ]

    kinds = [("key", "long"), ("digest", "string"), ("entry", "long"), ("count", "long"), ("chars", "long"),
             ("best", "long"), ("best_row", "long")]
    fields = [T.StructField(n[k], T.LongType() if t == "long" else T.StringType()) for k, t in kinds]
    return append_columns(with_row, fields, columns, COLLAPSE_ROWS)


def directory(entries: DataFrame, key: str, bucket_entries: int = BUCKET_ENTRIES) -> list[tuple[int, int, int]]:
    """Buckets (local depth, first key, last key), in key order, from repeated directory doubling.

    ``entries`` holds one row per distinct key with its number of entries in
    ``n``.  One aggregation per doubling counts the children of the overfull
    buckets only.  A bucket of a single key is never split (its chain is
    walked instead).
    """
    full = [(0, 0)]                    # (depth, prefix) still to be counted
    done: list[tuple[int, int]] = []
    unsigned_top = lambda d: F.shiftrightunsigned(F.col(key), 64 - d) if d else F.lit(0).cast("long")
    while full:
        depth = full[0][0]
        step = min(64, depth + _FIRST_DEPTH) - depth
        parents = [p for _, p in full]
        at = entries if depth == 0 else entries.where(unsigned_top(depth).isin(parents))
        counts = {r["p"]: (r["n"], r["k"]) for r in at.groupBy(unsigned_top(depth + step).alias("p")).agg(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect()}
        full = []
        for p in parents:
            stack = [(depth, p)]
            while stack:               # doubling by one bit, from counts already known
                d, x = stack.pop()
                lo, hi = x << (depth + step - d), (x + 1) << (depth + step - d)
                inside = [counts[c] for c in range(lo, hi) if c in counts]
                n, k = sum(i[0] for i in inside), sum(i[1] for i in inside)
                if n <= bucket_entries or k <= 1:
                    done.append((d, x))
                elif d < depth + step:
                    stack += [(d + 1, 2 * x), (d + 1, 2 * x + 1)]
                elif d < 64:
                    full.append((d, x))
                else:
                    done.append((d, x))
    buckets = [(d, x << (64 - d), ((x + 1) << (64 - d)) - 1) for d, x in done]
    return sorted(buckets, key=lambda b: b[1])


def _chain(key_at: int, entry_at: int, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, chain = None, []
        for b in batches:
            keys, entries = b.column(key_at).to_pylist(), b.column(entry_at).to_pylist()
            links = []
            for key, text in zip(keys, bytes_of(b.column(text_at).cast(pa.string()))):
                norm = normalise(text)
                if key != last:
                    last, chain = key, []
                for place, known in enumerate(chain):
                    if known == norm:
                        break
                else:
                    place = len(chain)
                    chain.append(norm)
                links.append(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(entries, pa.int64()), pa.array(keys, pa.int64()), pa.array(links, pa.int64())],
                names=["_entry", "_key", "_place"])

    return run


def _resolve(docs: DataFrame, id_col: str, text_col: str, bucket_entries: int, key_bits: int) -> tuple[DataFrame, dict]:
    """The record file joined with the verdict of every row; names of the added columns."""
    cols = docs.columns
    n = {}
    for base in ("row", "key", "digest", "entry", "count", "chars", "best", "best_row", "keep", "keep_row", "size"):
        n[base] = fresh(cols + list(n.values()), f"_{base}")
    records = written(_index_rows(docs, id_col, text_col, key_bits, n), "exact_records")
    entry = records.where(F.col(n["row"]) == F.col(n["entry"]))
    per_key = entry.groupBy(F.col(n["key"]).alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    per_key = written(per_key, "exact_keys")
    buckets = directory(per_key, "_key", bucket_entries)
    spark = docs.sparkSession
    # one row per bucket: bounded by the directory, which grows with entries / bucket_entries
    signed = lambda u: u - (1 << 64) if u >= 1 << 63 else u
    cells = spark.createDataFrame([(i, d, signed(lo)) for i, (d, lo, _) in enumerate(buckets)],
                                  "_bucket long, _depth int, _first long")
    owned = None
    for depth in sorted({d for d, _, _ in buckets}):
        top = F.shiftleft(F.shiftrightunsigned(F.col("_key"), 64 - depth), 64 - depth) if depth else F.lit(0).cast("long")
        part = per_key.select("_key", top.alias("_first")).join(
            cells.where(F.col("_depth") == depth).select("_bucket", "_first"), "_first").select("_key", "_bucket")
        owned = part if owned is None else owned.unionByName(part)
    texts = entry.select(F.col(n["key"]).alias("_key"), F.col(n["entry"]).alias("_entry"), q(text_col).alias("_text")).join(
        owned, "_key")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = texts.repartitionByRange(parts, "_bucket", "_key").sortWithinPartitions("_bucket", "_key", "_entry")
    order = ["_key", "_entry", "_text"]
    places = written(ranged.select(*order).mapInArrow(_chain(0, 1, 2), "_entry long, _key long, _place long"),
                     "exact_places")
    facts = entry.select(F.col(n["entry"]).alias("_entry"), F.col(n["count"]).alias("_n"), F.struct(
        (-F.col(n["chars"])).alias("c"), F.col(n["best"]).isNull().alias("z"), F.col(n["best"]).alias("d"),
        F.col(n["best_row"]).alias("r")).alias("_rank")).join(places, "_entry")
    classes = facts.groupBy("_key", "_place").agg(F.min("_rank").alias("_top"), F.sum("_n").alias("_size"))
    verdict = places.join(classes, ["_key", "_place"]).select(
        F.col("_entry").alias(n["entry"]), F.col("_top.d").alias(n["keep"]), F.col("_top.r").alias(n["keep_row"]),
        F.col("_size").alias(n["size"]), F.lit(True).alias("_met"))
    out = records.join(verdict, n["entry"], "left").select(
        *[records[f"`{c}`"] for c in records.columns],
        F.when(F.col("_met"), F.col(n["keep"])).otherwise(F.col(n["best"])).alias(n["keep"]),
        F.coalesce(n["keep_row"], n["best_row"]).alias(n["keep_row"]),
        F.coalesce(n["size"], n["count"]).alias(n["size"]))
    return out, n


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            bucket_entries: int = BUCKET_ENTRIES, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    narrow = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text"))
    out, n = _resolve(narrow, "doc_id", "text", bucket_entries, key_bits)
    return out.select("doc_id", F.col(n["keep"]).alias("keep_id"), F.col(n["size"]).alias("group_size"),
                      (F.col(n["row"]) == F.col(n["keep_row"])).alias("kept"),
                      F.col(n["digest"]).alias("text_sha256"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    out, n = _resolve(docs, id_col, text_col, BUCKET_ENTRIES, 64)
    return out.where(F.col(n["row"]) == F.col(n["keep_row"])).select(*[q(c) for c in docs.columns])
