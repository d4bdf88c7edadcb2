"""Exact top-k search by inner product: vector-approximation files.

1. *Vectors.*  Every whole vector becomes a long vector x = floor(256 * c).
   Equal vectors are one class with its k + 1 smallest ids: no query can
   return more of them, itself left out, so a vector that a third of all rows
   share is one entry of the file.
2. *Cells.*  Every dimension is cut into at most 2^bits cells of about equally
   many vectors.  The cut points come from a histogram of all vectors with
   logarithmic buckets (a bounded number per dimension); a cell keeps its least
   and greatest value.
3. *Approximation file.*  Each vector as ``bits`` per dimension, packed in
   blocks; queries are packed alike.
4. *Scan.*  Every block meets every pack of queries (a tile, one equi-join on
   both numbers).  Least and greatest values of the cells give a lower and an
   upper bound of each score by two matrix products.  A tile keeps, per query,
   the candidates whose upper bound reaches its (k + 1)th lower bound, and the
   (k + 1)th lower bound over all tiles drops most of the rest.
5. *Exact vectors.*  Candidates are read best bound first, in rounds of growing
   length: a round joins the next candidates of each query with their vectors,
   and a query goes on only while its next upper bound reaches the (k + 1)th
   exact score.  (One of k + 1 classes may be the query's own row alone, so k
   others are always certain.)

The work is queries x vectors: a stated query set against all rows, in blocks.
A task holds one tile of at most about 2 x TILE_BYTES and slabs of
QUERY_SLAB x ROW_SLAB bounds.  Only cell limits (2^bits per dimension), sizes
and counts reach the driver.

Defined cases: vectors that are null or hold a null or non-finite component
take no part; shorter vectors count as padded with zeros; rows repeated with
one id are rows of their own (a repeated query has as many answers, and a copy
of its own row is a candidate); a null id is never a query, and a candidate
that loses ties against any id; ties go to the smaller id, then to the earlier
row; fewer than k other rows: all of them; an empty table gives an empty
result; scores beyond 64 bits count as the nearest long; very long vectors
make tiles of fewer rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import clamp, integer_vectors, largest, matrix, padded, row_dots

BITS = 6
TILE_BYTES = 4 << 20
QUERY_SLAB, ROW_SLAB = 512, 4096
_MANTISSA = 128           # buckets per power of two: exact up to 256

RESULT = "query_id long, rank int, vec_id long, score long"


# ------------------------------------------------------------------ cells
def _bucket(v: np.ndarray) -> np.ndarray:
    """Monotone bucket number of every value: linear near zero, logarithmic beyond."""
    m, e = np.frexp(np.abs(v.astype(float)))
    return (np.sign(v) * (e.astype(np.int64) * _MANTISSA + ((m - 0.5) * 2 * _MANTISSA).astype(np.int64) + 1)).astype(np.int64)


def cell_limits(classes: DataFrame, width: int, total: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(lo, hi), both width x cells: least and greatest value in every cell; unused cells repeat the last."""

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(0), width)
            dims, values = np.tile(np.arange(width), len(m)), m.ravel()
            buckets = _bucket(values)
            order = np.lexsort((values, buckets, dims))
            dims, values, buckets = dims[order], values[order], buckets[order]
            new = np.flatnonzero(np.r_[True, (np.diff(dims) != 0) | (np.diff(buckets) != 0)]) if len(dims) else np.zeros(0, int)
            end = np.r_[new[1:], len(dims)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(dims[new].astype(np.int32)), pa.array(buckets[new]), pa.array((end - new).astype(np.int64)),
                 pa.array(values[new]), pa.array(values[end - 1])], names=["dim", "bucket", "n", "lo", "hi"])

    counts = classes.select("x").mapInArrow(histogram, "dim int, bucket long, n long, lo long, hi long") \
        .groupBy("dim", "bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("bucket")) - F.col("n")
    cell = F.floor(before * cells / float(total)).cast("int")
    got = counts.select("dim", cell.alias("cell"), "lo", "hi").groupBy("dim", "cell").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("dim", "cell").collect()
    lo, hi = np.zeros((width, cells), np.int64), np.zeros((width, cells), np.int64)
    used = [0] * width
    for r in got:
        d = r["dim"]
        lo[d, used[d]:], hi[d, used[d]:] = r["lo"], r["hi"]
        used[d] += 1
    return lo, hi


def encode(m: np.ndarray, lo: np.ndarray, bits: int) -> bytes:
    """Rows as cell numbers of ``bits`` bits per dimension, one row after the other, padded to whole bytes."""
    codes = np.empty(m.shape, np.uint8)
    for d in range(m.shape[1]):
        starts = np.unique(lo[d])
        codes[:, d] = np.searchsorted(starts, m[:, d], "right") - 1
    planes = (codes[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return np.packbits(planes.reshape(len(m), -1), axis=1).tobytes()


def decode(packed: bytes, rows: int, width: int, bits: int) -> np.ndarray:
    """Cell numbers (rows x width) of ``encode``."""
    stride = -(-width * bits // 8)
    planes = np.unpackbits(np.frombuffer(packed, np.uint8).reshape(rows, stride), axis=1, count=width * bits)
    codes = np.zeros((rows, width), np.uint8)
    for i in range(bits):
        codes = (codes << 1) | planes[:, i::bits]
    return codes


# ------------------------------------------------------------------ scan
def bounds(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of every query x row score, given the limits of the rows' cells.

    Single precision where all sums are exact in it; else double precision,
    moved outwards by more than its rounding error.
    """
    most = max(largest(lo), largest(hi))
    total = float(largest(queries)) * float(most) * max(1, queries.shape[1])
    kind = np.float32 if total < 2 ** 24 else np.float64
    plus, minus = np.maximum(queries, 0).astype(kind), np.minimum(queries, 0).astype(kind)
    low, high = lo.astype(kind).T, hi.astype(kind).T
    slack = total * 2.0 ** -40 if total >= 2 ** 52 else 0
    return plus @ low + minus @ high - kind(slack), plus @ high + minus @ low + kind(slack)


def scan_tile(queries: np.ndarray, lo: np.ndarray, hi: np.ndarray, k: int) -> Iterator[tuple]:
    """(query place, row place, lower, upper) arrays of the pairs that may be among a query's ``k`` best of this tile."""
    for q0 in range(0, len(queries), QUERY_SLAB):
        slab = queries[q0: q0 + QUERY_SLAB]
        best = np.full((len(slab), k), -np.inf)
        kept = []
        for r0 in range(0, len(lo), ROW_SLAB):
            lower, upper = bounds(slab, lo[r0: r0 + ROW_SLAB], hi[r0: r0 + ROW_SLAB])
            both = np.concatenate([best, lower], axis=1)
            best = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
            at_q, at_r = np.nonzero(upper >= best.min(axis=1)[:, None])
            kept.append((at_q, at_r + r0, lower[at_q, at_r], upper[at_q, at_r]))
        at_q, at_r, lower, upper = (np.concatenate(x) for x in zip(*kept))
        last = upper >= best.min(axis=1)[at_q]
        yield at_q[last] + q0, at_r[last], lower[last].astype(float), upper[last].astype(float)


def _packed(df: DataFrame, number: str, groups: int, names: list[str], pack) -> DataFrame:
    """One row per group number (0 to groups - 1): the long column ``names[0]`` and what ``pack`` makes of the matrix."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        ids = t.column(1).combine_chunks().to_numpy().astype(np.int64)
        return pa.table({number: pa.array([key[0].as_py()], pa.int64()),
                         names[0]: pa.array([ids.tobytes()], pa.binary()),
                         names[1]: pa.array([pack(t.column(2).combine_chunks())], pa.binary())})

    dealt = df.select(F.pmod(F.xxhash64(df.columns[0]), F.lit(groups)).alias(number), *df.columns)
    return dealt.groupBy(number).applyInArrow(run, f"{number} long, {names[0]} binary, {names[1]} binary")


def candidates(classes: DataFrame, queries: DataFrame, width: int, total: int, n_queries: int, k: int,
               bits: int) -> DataFrame:
    """(q, c, lower, upper) of the pairs of query row and class that the approximations cannot rule out within a tile."""
    spark = classes.sparkSession
    lo, hi = cell_limits(classes, width, total, 1 << bits)
    cores = spark.sparkContext.defaultParallelism
    block_rows = max(64, TILE_BYTES // (8 + -(-width * bits // 8)))
    blocks = max(-(-total // block_rows), min(2 * cores, -(-total // 256)))
    packs = -(-n_queries // max(16, TILE_BYTES // (8 * (1 + width))))
    rows_of = lambda column: matrix(column, width)
    file = written(_packed(classes.select("c", "x"), "block", blocks, ["cs", "cells"],
                           lambda x: encode(rows_of(x), lo, bits)), "va_approximations")
    asked = written(_packed(queries.select("q", "x"), "pack", packs, ["qs", "xs"],
                            lambda x: rows_of(x).tobytes()), "va_queries")
    tasks = min(blocks * packs, max(4 * cores, blocks * packs // 16))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims = np.arange(width)
        for b in batches:
            for i in range(b.num_rows):
                cs, cells, qs, xs = (b.column(j)[i].as_buffer() for j in range(4))
                cs, qs = np.frombuffer(cs, np.int64), np.frombuffer(qs, np.int64)
                codes = decode(cells, len(cs), width, bits)
                asked_x = np.frombuffer(xs, np.int64).reshape(len(qs), width)
                for at_q, at_c, lower, upper in scan_tile(asked_x, lo[dims, codes], hi[dims, codes], k):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(qs[at_q]), pa.array(cs[at_c]), pa.array(lower), pa.array(upper)],
                        names=["q", "c", "lower", "upper"])

    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    tiles = file.select("*", F.explode(numbers(packs)).alias("pack")) \
        .repartition(tasks, "pack", "block").join(
            asked.select("*", F.explode(numbers(blocks)).alias("block"))
            .repartition(tasks, "pack", "block").hint("merge"), ["pack", "block"])
    return tiles.select("cs", "cells", "qs", "xs").mapInArrow(scan, "q long, c long, lower double, upper double")


# ------------------------------------------------------------------ exact scores
def _scores(pairs: DataFrame, queries: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """(q, c, score): exact inner products of the pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dots = row_dots(matrix(b.column(2), width), matrix(b.column(3), width))
            dots = dots if isinstance(dots, np.ndarray) else clamp(dots)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dots, pa.int64())],
                                             names=["q", "c", "score"])

    joined = pairs.select("q", "c").join(classes.select("c", "x"), "c").join(
        queries.select("q", F.col("x").alias("qx")), "q")
    return joined.select("q", "c", "x", "qx").mapInArrow(run, "q long, c long, score long")


def _kth(df: DataFrame, value: str, k: int) -> DataFrame:
    """(q, kth): the kth largest value per query, for queries that have as many."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc(value)))
    return df.select("q", value, place.alias("place")).where(F.col("place") <= k).groupBy("q").agg(
        F.min(value).alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select("q", "kth")


def exact_in_order(pairs: DataFrame, queries: DataFrame, classes: DataFrame, width: int, k: int) -> DataFrame:
    """Exact scores of the candidates, read best upper bound first until the kth score of each query is certain."""
    by_bound = Window.partitionBy("q").orderBy(F.desc("upper"), "c")
    reach = (F.col("upper") >= F.col("kth")) | F.col("kth").isNull()
    ranked = written(pairs.join(_kth(pairs, "lower", k), "q", "left").where(reach)
                     .select("q", "c", "upper", F.row_number().over(by_bound).alias("place")), "va_ranked")
    found, todo, upto = None, ranked, 2 * k
    while True:
        now = written(_scores(todo.where(F.col("place") <= upto), queries, classes, width), "va_scores")
        found = now if found is None else found.unionByName(now)
        kth = _kth(found, "score", k)
        todo = written(todo.where(F.col("place") > upto).join(kth, "q", "left").where(reach)
                       .select("q", "c", "upper", "place"), "va_pending")
        if todo.isEmpty():
            return found.join(kth, "q", "left").where((F.col("score") >= F.col("kth")) | F.col("kth").isNull())
        upto *= 4


def top_k(df: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5,
          bits: int = BITS) -> DataFrame:
    """The ``k`` best other rows of every query row: see RESULT.  ``is_query`` is a condition on ``vec_id``."""
    spark = df.sparkSession
    base = written(integer_vectors(df, id_col, vec_col).withColumn("r", F.monotonically_increasing_id()), "va_vectors")
    size = base.agg(F.max(F.size("x")).alias("width"), F.count_if(is_query).alias("queries")).first()
    if not size["queries"]:
        return spark.createDataFrame([], RESULT)
    width = max(1, size["width"])
    base = base.select("vec_id", "r", padded(F.col("x"), width).alias("x"))
    copy = F.row_number().over(Window.partitionBy("x").orderBy(F.asc_nulls_last("vec_id"), "r"))
    few = base.select("*", copy.alias("copy")).where(F.col("copy") <= k + 1)
    classes = written(few.groupBy("x").agg(F.collect_list(F.struct("vec_id", "r")).alias("members"))
                      .withColumn("c", F.monotonically_increasing_id()), "va_classes")
    queries = base.where(is_query).select(F.col("r").alias("q"), F.col("vec_id").alias("query_id"), "x")
    pairs = written(candidates(classes, queries, width, classes.count(), size["queries"], k + 1, bits), "va_candidates")
    found = exact_in_order(pairs, queries, classes, width, k + 1)
    rows = found.select("q", "c", "score").join(classes.select("c", "members"), "c") \
        .select("q", "score", F.explode("members").alias("m")).where(F.col("m.r") != F.col("q"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("m.vec_id"), "m.r"))
    best = rows.select("q", place.cast("int").alias("rank"), F.col("m.vec_id").alias("vec_id"), "score").where(F.col("rank") <= k)
    return best.join(queries.select("q", "query_id"), "q").select("query_id", "rank", "vec_id", "score")
