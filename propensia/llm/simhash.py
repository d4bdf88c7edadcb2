"""SimHash near-dedup with pigeonring filtering.

1. *Fingerprints.*  One Arrow pass; a text is hashed window by window and the
   bit counts are summed in blocks, so memory does not grow with its length.
   Documents and fingerprints are written once to the shared folder.
2. *Candidates.*  Work goes on with distinct fingerprints (copies never pair).
   64 bits are cut into ``SEGMENTS`` = 7 segments on a ring.  Two fingerprints
   within 4 bits agree on at least 3 whole segments, so each fingerprint is
   filed under its 35 triples of segments and owner tasks read the files key
   by key, in order.
3. *Pigeonring.*  A pair goes on to the Hamming check only if, from some start
   on the ring, every chain of l consecutive segments differs in at most
   l * max_bits / SEGMENTS bits in total.  (If all starts failed, the ring
   could be cut into chains that each exceed their share, so the sum would
   exceed max_bits: no true pair is lost.)
4. *Links.*  A file of at most ``PAIR_BLOCK`` fingerprints is compared in its
   owner task, which returns a spanning forest, not all pairs.  Fingerprints
   of a larger file take the exact ball join: x and y within 4 bits share a z
   within 2 bits of both, so every z links its members to the smallest one.
   That path is linear in the fingerprints and needs no comparison at all.
5. *Components.*  Alternating large and small stars over the links, each round
   written to the shared folder; only a count reaches the driver.

Defined cases: a null, empty or white-space text has fingerprint zero and is
linked like any other; fewer words than the shingle length make one shingle;
a very long text is read whole; repeated rows share a fingerprint, hence a component; a null doc_id never is a
component's id unless all are null; an empty table gives an empty result;
other columns are ignored by ``components`` and passed through by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, bytes_of, fresh, q, written

SHINGLE = 4
MAX_BITS = 4
SEED = 42
SEGMENTS = 7
PAIR_BLOCK = 4096
_HASH_BLOCK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit majority of the shingles' XXH64; A-Z lower-cased, no words give 0."""
    words = text.lower().split()    # of bytes: lowers A-Z only, splits at space and \\x09-\\x0D only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()
    counts, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, len(starts), _HASH_BLOCK):
        part = np.array([h(joined[a:b], SEED) for a, b in zip(starts[i:i + _HASH_BLOCK], ends[i:i + _HASH_BLOCK])], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(starts), bitorder="little").view("<u8")[0])


def _fingerprinted(docs: DataFrame, text_col: str, fp: str, shingle: int) -> DataFrame:
    at = docs.columns.index(text_col)

    def columns(b: pa.RecordBatch) -> list:
        fps = [fingerprint(t, shingle) for t in bytes_of(b.column(at).cast(pa.string()))]
        return [pa.array(np.array(fps, np.uint64).view(np.int64), pa.int64())]

    return append_columns(docs, [T.StructField(fp, T.LongType())], columns)


def segments(m: int = SEGMENTS) -> list[tuple[int, int]]:
    """(shift, width) of m nearly equal segments of 64 bits, in ring order."""
    cuts = [64 * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def pigeonring(xor: np.ndarray, max_bits: int = MAX_BITS, m: int = SEGMENTS) -> np.ndarray:
    """True where some start on the ring keeps every chain's differences within its proportional budget."""
    d = np.stack([np.bitwise_count((xor >> np.uint64(s)) & np.uint64((1 << w) - 1)) for s, w in segments(m)])
    ok = np.zeros(xor.shape, bool)
    for start in range(m):
        viable, total = np.ones(xor.shape, bool), np.zeros(xor.shape, np.int64)
        for length in range(1, m + 1):
            total += d[(start + length - 1) % m]
            viable &= total * m <= length * max_bits
            if not viable.any():
                break
        ok |= viable
    return ok


def triples(max_bits: int = MAX_BITS, m: int = SEGMENTS) -> list[tuple[int, int]]:
    """(number, mask): m - max_bits whole segments that a pair within max_bits must share for some number."""
    segs = [((1 << w) - 1) << s for s, w in segments(m)]
    return [(i, sum(segs[j] for j in c)) for i, c in enumerate(combinations(range(m), m - max_bits))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _links_of(fps: np.ndarray, starts: np.ndarray, ends: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning links of the files [start, end) of ``fps``.

    All files' pairs at one offset are tested together; pairs that earlier
    links already connect need no test, since they cannot add to the forest.
    """
    if not len(starts):
        return []
    parent = np.arange(len(fps))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])
    last = np.repeat(ends, ends - starts)
    out, offset = [], 1
    while True:
        live = left + offset < last
        left, last = left[live], last[live]
        if not len(left):
            return out
        apart = left[parent[left] != parent[left + offset]]
        xor = fps[apart] ^ fps[apart + offset]
        ring = pigeonring(xor, max_bits)
        apart, xor = apart[ring], xor[ring]
        for a in apart[np.bitwise_count(xor) <= max_bits].tolist():
            x, y = find(a), find(a + offset)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(fps[a]), int(fps[a + offset])))
        while (parent[parent] != parent).any():
            parent = parent[parent]
        offset += 1


def _owner(max_bits: int, pair_block: int):
    """Walks files in key order; a file that goes on in the next batch is carried over."""

    def emit(keys: np.ndarray, fps: np.ndarray):
        cut = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
        size = ends - starts
        small = (size > 1) & (size <= pair_block)
        links = _links_of(fps.view(np.uint64), starts[small], ends[small], max_bits)
        a = [_signed(x) for x, _ in links]
        b = [_signed(y) for _, y in links]
        for s, e in zip(starts[size > pair_block], ends[size > pair_block]):
            a += fps[s:e].tolist()
            b += [None] * int(e - s)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        hot = None                       # key of a file already known to be too large; its rows stream out
        for batch in batches:
            k = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            f = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
            if hot is not None:
                n = int(np.searchsorted(k != hot, True)) if (k != hot).any() else len(k)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(f[:n], pa.int64()), pa.nulls(n, pa.int64())], names=["a", "b"])
                k, f = k[n:], f[n:]
                if not len(k):
                    keys, fps = k, f
                    continue
                hot = None
            tail = len(k) - int(np.argmax(k[::-1] != k[-1])) if len(k) and (k != k[-1]).any() else 0
            if tail:
                yield emit(k[:tail], f[:tail])
            keys, fps = k[tail:], f[tail:]
            if len(keys) > pair_block:
                yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.nulls(len(fps), pa.int64())], names=["a", "b"])
                hot, keys, fps = int(keys[0]), keys[:0], fps[:0]
        if len(keys):
            yield emit(keys, fps)

    return run


def links(distinct: DataFrame, max_bits: int = MAX_BITS, pair_block: int = PAIR_BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints in column ``fp`` with the same components as all true links."""
    spark = distinct.sparkSession
    files = distinct.select("fp", F.explode(F.array(*[
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(mask)))) for i, mask in triples(max_bits)])).alias("file"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = files.repartition(parts, "file").sortWithinPartitions("file", "fp").select("file", "fp").mapInArrow(
        _owner(max_bits, pair_block), "a long, b long")
    found = written(found.coalesce(spark.sparkContext.defaultParallelism), "simhash_links")
    near = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    return near.unionByName(ball_links(hot, max_bits)).distinct()


def ball_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links of ``fps`` by common neighbours within half of ``max_bits``; exact and linear in the rows."""
    near, far = max_bits // 2, max_bits - max_bits // 2
    masks = lambda r: [sum(1 << i for i in c) for n in range(r + 1) for c in combinations(range(64), n)]
    # one constant text instead of thousands of literals keeps the plan small
    flips = lambda r: F.explode(F.split(F.lit(",".join(str(_signed(x)) for x in masks(r))), ",").cast("array<bigint>"))
    around = fps.select("fp", flips(far).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("z"))
    hub = fps.select("fp", flips(near).alias("m")).groupBy(F.col("fp").bitwiseXOR(F.col("m")).alias("z")).agg(
        F.min("fp").alias("hub"))
    return around.join(hub, "z").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))


def star_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star rounds.

    Nodes without a link are not in the result.  A round is two aggregations
    and two joins on the node; every round is written (as one file per core, the
    rows being narrow), so a lost executor costs one round at most.
    """
    files = edges.sparkSession.sparkContext.defaultParallelism
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
                  .coalesce(files), "stars")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_of = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_of, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            small_of.select("u", F.col("m").alias("v"))).distinct()
        now = written(small.coalesce(files), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state


def _with_component(docs: DataFrame, id_col: str, text_col: str, shingle: int, max_bits: int, pair_block: int,
                    n: dict) -> tuple[DataFrame, DataFrame]:
    """Written documents with fingerprints, and (fp, group fingerprint) of every fingerprint that has a link."""
    records = written(_fingerprinted(docs.withColumn(n["row"], F.monotonically_increasing_id()), text_col, n["fp"], shingle),
                      "simhash_records")
    distinct = records.select(F.col(n["fp"]).alias("fp")).distinct()
    return records, star_components(links(distinct, max_bits, pair_block))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               max_bits: int = MAX_BITS, pair_block: int = PAIR_BLOCK) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id (smallest doc_id reachable)."""
    narrow = docs.select(q(id_col).cast("long").alias("doc_id"), q(text_col).alias("text"))
    n = {"fp": "fp", "row": "row"}
    fps = _fingerprinted(narrow, "text", "fp", shingle).select("doc_id", "fp")
    records = written(fps, "simhash_fingerprints")
    firsts = records.groupBy("fp").agg(F.min("doc_id").alias("first"))
    linked = star_components(links(records.select("fp").distinct(), max_bits, pair_block))
    group = firsts.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), "first")
    smallest = group.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = group.join(smallest, "component").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return records.join(by_fp, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
          max_bits: int = MAX_BITS, pair_block: int = PAIR_BLOCK) -> DataFrame:
    """The documents that stay, with the columns they came with: of each component the smallest doc_id's first row."""
    cols = docs.columns
    n = {}
    for base in ("row", "fp"):
        n[base] = fresh(cols + list(n.values()), f"_{base}")
    records, linked = _with_component(docs, id_col, text_col, shingle, max_bits, pair_block, n)
    order = F.struct(q(id_col).isNull().alias("z"), q(id_col).alias("d"), F.col(n["row"]).alias("r"))
    first = records.groupBy(F.col(n["fp"]).alias("fp")).agg(F.min(order).alias("o"))
    group = first.join(linked.select(F.col("node").alias("fp"), "component"), "fp", "left")
    stay = group.groupBy(F.coalesce("component", "fp").alias("g")).agg(F.min("o").alias("o")).select(
        F.col("o.r").alias(n["row"]))
    return records.join(stay, n["row"], "left_semi").select(*[q(c) for c in cols])
