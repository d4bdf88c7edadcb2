"""Column medians of wide data (P3): one scan of mergeable sketches, one scan that repairs them to exact ranks.

1. One Arrow pass sorts every ``CHUNK_ROWS`` rows of a column and hands on at
   most ``CHUNK_POINTS`` of its values, each with the number of rows up to it.
   Spark sums these up by value and ranks them per column, all columns side by
   side; what a chunk's points leave open bounds the error, so the two values
   per column that reach the driver are certain to bracket the middle rank.
2. The second scan is one Arrow pass: per column it counts the numbers below
   the bracket and keeps the values inside with their counts (about a
   five-hundredth of a continuous column), which Spark sums up by value.  The
   exact middle ranks then decide.

A bracket that turns out to miss the middle is opened to the whole column and
read again; the points never decide the result.  ``approx_medians`` is the
choice for data so wide that one scan must do: the middle value of a quantile
sketch (one task merges the sketches of all tasks, so not for very many).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, importable
from .rank import global_rank

SKETCH_ACCURACY = 2_000     # a rank in the sketch is off by at most n / SKETCH_ACCURACY
CHUNK_ROWS = 1 << 16        # rows that are sorted at a time
CHUNK_POINTS = 512          # values that stand for a chunk's column
HELD_VALUES = 1 << 20       # values a task holds before it hands on their counts

_NONE = "c int, median double"


def number(name: str) -> Column:
    """The column as a double; NaN counts as missing."""
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


def _numbers(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[number(c).alias(f"v{i}") for i, c in enumerate(cols)])


def approx_medians(df: DataFrame, cols: list[str], accuracy: int = SKETCH_ACCURACY) -> DataFrame:
    """(column index, median) whose rank is off by at most n / ``accuracy``: one scan, no exchange of values."""
    if not cols:
        return df.sparkSession.createDataFrame([], _NONE)
    row = _numbers(df, cols).agg(*[F.percentile_approx(f"v{i}", 0.5, accuracy).alias(f"q{i}") for i in range(len(cols))])
    items = [F.struct(F.lit(i).alias("c"), F.col(f"q{i}").alias("median")) for i in range(len(cols))]
    return row.select(F.explode(F.array(*items)).alias("r")).select("r.*").where("median IS NOT NULL")


def exact_medians(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column index, median) for every column with at least one number."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], _NONE)
    numbers = _numbers(df, cols)
    brackets, sizes = _brackets(numbers, len(cols))
    out = spark.createDataFrame([], _NONE)
    while brackets:
        found, missed = _repair(numbers, brackets, sizes)
        out = out.unionByName(found)
        brackets = {i: (-math.inf, math.inf) for i in missed}
    return out


def _points(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, rows, open): at most ``most`` values, each with the rows above the one before it up to itself.

    So the rows up to a value are never fewer than the points say, nor more by over ``open``.
    """
    v, n = np.unique(values + 0.0, return_counts=True)          # -0.0 and 0.0 are one value
    if len(v) <= most:
        return v, n, 0
    upto = np.cumsum(n)
    ends = np.unique(np.searchsorted(upto, np.arange(1, most + 1) * len(values) // most))
    rows = np.diff(upto[ends], prepend=0)
    return v[ends], rows, int((rows - n[ends]).max())


def _brackets(numbers: DataFrame, n_cols: int, chunk_rows: int | None = None,
              most: int | None = None) -> tuple[dict[int, tuple[float, float]], dict[int, int]]:
    """Two values around the middle ranks of every column that has numbers, and how many it has: one scan."""
    chunk_rows, most = chunk_rows or CHUNK_ROWS, most or CHUNK_POINTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def chunk() -> pa.RecordBatch:
            cs, vs, ns, opens = [], [], [], []
            for c in range(n_cols):
                values = np.concatenate([b.column(c).drop_null().to_numpy(zero_copy_only=False) for b in held])
                if len(values):
                    v, n, left = _points(values, most)
                    cs.append(np.full(len(v), c, np.int32))
                    vs.append(v)
                    ns.append(n)
                    opens.append(np.array([left] + [0] * (len(v) - 1), np.int64))
            held.clear()
            parts = [np.concatenate(x) if x else np.zeros(0) for x in (cs, vs, ns, opens)]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(parts, (pa.int32(), pa.float64(), pa.int64(), pa.int64()))],
                                              names=["c", "v", "cnt", "open"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= chunk_rows:
                yield chunk()
        if held:
            yield chunk()

    def bracket(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("v")
        v, upto, left = t["v"].to_numpy(), np.cumsum(t["cnt"].to_numpy()), int(np.sum(t["open"].to_numpy()))
        n = int(upto[-1])
        below = int(np.searchsorted(upto + left, (n - 1) // 2, "right"))      # points that lie below the lower middle for certain
        above = int(np.searchsorted(upto, n // 2 + 1))                        # first one that the upper middle can't exceed
        lo = float(v[below - 1]) if below else -math.inf
        return pa.table({"c": pa.array([key[0].as_py()], pa.int32()), "lo": [lo], "hi": [float(v[above])],
                         "n": pa.array([n], pa.int64())})

    importable(numbers.sparkSession)
    points = numbers.mapInArrow(run, "c int, v double, cnt long, open long").groupBy("c", "v").agg(
        F.sum("cnt").alias("cnt"), F.sum("open").alias("open"))
    found = points.groupBy("c").applyInArrow(bracket, "c int, lo double, hi double, n long").collect()      # one row per column
    return {r["c"]: (r["lo"], r["hi"]) for r in found}, {r["c"]: r["n"] for r in found}


def _inside(numbers: DataFrame, brackets: dict[int, tuple[float, float]]) -> DataFrame:
    """(c, v, cnt): the values inside each bracket with their counts; v null: how many lie below it."""
    order = sorted(brackets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, held = [0] * len(order), [[] for _ in order]

        def counted(last: bool) -> pa.RecordBatch:
            columns: list[tuple] = []
            for k, c in enumerate(order):
                if held[k]:
                    v, n = np.unique(np.concatenate(held[k]), return_counts=True)
                    columns += zip([c] * len(v), v.tolist(), n.tolist())
                    held[k] = []
                if last and below[k]:
                    columns.append((c, None, below[k]))
            c, v, n = zip(*columns) if columns else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(v, pa.float64()), pa.array(n, pa.int64())],
                                              names=["c", "v", "cnt"])

        for b in batches:
            for k, c in enumerate(order):
                values = b.column(k).drop_null().to_numpy(zero_copy_only=False)
                lo, hi = brackets[c]
                below[k] += int((values < lo).sum())
                kept = values[(values >= lo) & (values <= hi)]
                if len(kept):
                    held[k].append(kept + 0.0)          # -0.0 and 0.0 are one value
            if sum(len(x) for h in held for x in h) > HELD_VALUES:
                yield counted(False)
        yield counted(True)

    importable(numbers.sparkSession)
    each = numbers.select(*[f"v{c}" for c in order]).mapInArrow(run, "c int, v double, cnt long")
    return each.groupBy("c", "v").agg(F.sum("cnt").alias("cnt"))


def _repair(numbers: DataFrame, brackets: dict[int, tuple[float, float]], sizes: dict[int, int]) -> tuple[DataFrame, list[int]]:
    """(exact medians, columns whose bracket misses the middle) from one scan."""
    spark = numbers.sparkSession
    ensure_checkpoint_dir(spark)
    counts = _inside(numbers, brackets).select("c", "v", F.col("cnt").cast("double").alias("cnt"))
    ranked = global_rank(counts, [F.col("c").asc(), F.col("v").asc_nulls_first()], rank_col="_k", sums={"cum": "cnt"})
    facts = {r["c"]: (r["m"], r["b"] or 0.0) for r in ranked.groupBy("c").agg(          # one row per column
        F.sum("cnt").alias("m"), F.sum(F.when(F.col("v").isNull(), F.col("cnt"))).alias("b")).collect()}
    offsets, missed, running = [], [], 0.0
    for c in sorted(facts):
        upto, below = facts[c]
        n = sizes[c]
        if below <= (n - 1) // 2 and n // 2 < upto:
            offsets.append((c, float(n), running))
        else:
            missed.append(c)
        running += upto
    missed += [c for c in brackets if c not in facts]
    known = spark.createDataFrame(offsets, "c int, n double, off double")
    j = ranked.where("v IS NOT NULL").join(known, "c")
    upto = F.col("cum") - F.col("off")
    prev = upto - F.col("cnt")
    p_lo, p_hi = F.floor((F.col("n") - 1) / 2), F.ceil((F.col("n") - 1) / 2)
    hit_lo, hit_hi = (prev <= p_lo) & (p_lo < upto), (prev <= p_hi) & (p_hi < upto)
    picked = j.where(hit_lo | hit_hi).groupBy("c").agg(
        F.max(F.when(hit_lo, F.col("v"))).alias("lo"), F.max(F.when(hit_hi, F.col("v"))).alias("hi"))
    return picked.select("c", ((F.col("lo") + F.col("hi")) / F.lit(2.0)).alias("median")), missed
