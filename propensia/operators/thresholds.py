"""Threshold learning and the business policy.

The reference evaluates every candidate threshold with a full pass over the
scores (quadratic).  Here every score is mapped once to the largest grid
point ``k/10000 <= score`` (exact double comparisons), giving a histogram of
at most ~10k buckets whatever the input size; suffix sums over that bounded
table answer ``score >= t`` for every on-grid candidate.  The single off-grid
anchor (the break-even rate) is one extra conditional count in the same
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..session import ensure_checkpoint_dir
from .metrics import summary_columns
from .rank import attach_scalars

GRID = 10000.0
LO, HI = S.THRESHOLD_CLIP
K_LO = int(round(LO * GRID))  # 10
K_HI = int(round(HI * GRID))  # 9990
OFF_GRID = [a for a in S.THRESHOLD_ANCHORS if float(round(a * GRID)) / GRID != a]


def rounded4(s: Column) -> Column:
    """numpy ``round(s, 4)``: half-even after scaling by 10^4."""
    return F.rint(s * F.lit(GRID)) / F.lit(GRID)


def grid_floor(s: Column) -> Column:
    """Largest k with k/10000 <= s, exact (naive floor(s*1e4) misses edges)."""
    k = F.floor(s * F.lit(GRID))
    k = F.when(k / F.lit(GRID) > s, k - 1).otherwise(k)
    return F.when((k + 1) / F.lit(GRID) <= s, k + 1).otherwise(k).cast("long")


def candidates(df: DataFrame, score_col: str) -> DataFrame:
    """Distinct 4-dp scores plus anchors, clipped to [0.001, 0.999], distinct."""
    return _with_anchors(df.select(rounded4(F.col(score_col)).alias("threshold")))


def _with_anchors(grid: DataFrame) -> DataFrame:
    spark = grid.sparkSession
    anchors = spark.createDataFrame([(float(a),) for a in S.THRESHOLD_ANCHORS], "threshold double")
    clipped = grid.unionByName(anchors).select(
        F.least(F.greatest(F.col("threshold"), F.lit(LO)), F.lit(HI)).alias("threshold")
    )
    return clipped.distinct()


def sweep(df: DataFrame, score_col: str, label_col: str) -> DataFrame:
    """E9 at every candidate: the scores are read once, into a bounded histogram that also holds the candidates."""
    ensure_checkpoint_dir(df.sparkSession)
    s = F.col(score_col)
    y = F.col(label_col).cast("long")
    k = F.least(F.greatest(grid_floor(s), F.lit(K_LO - 1)), F.lit(K_HI))
    off = [(s >= F.lit(a)).cast("int") for a in OFF_GRID]
    keys = [k.alias("k"), rounded4(s).alias("_t4")] + [o.alias(f"_ge{i}") for i, o in enumerate(off)]
    # at most 2 * (K_HI - K_LO + 2) * 2^len(OFF_GRID) rows for scores in [0, 1]: bounded, independent of data size
    hist = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos")).checkpoint()
    per_k = hist.groupBy("k").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    # suffix sums over the dense bucket range (<= 9,982 rows, one partition)
    suffix = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = hist.agg(F.sum("n").cast("double").alias("_n"), F.sum("pos").cast("double").alias("_P"))
    off_aggs = []
    for i in range(len(OFF_GRID)):
        ge = F.col(f"_ge{i}") == 1
        off_aggs += [
            F.sum(F.when(ge, F.col("n")).otherwise(0)).alias(f"_off_n{i}"),
            F.sum(F.when(ge, F.col("pos")).otherwise(0)).alias(f"_off_pos{i}"),
        ]
    off_tot = hist.agg(*off_aggs) if off_aggs else None

    cand = _with_anchors(hist.select(F.col("_t4").alias("threshold")))
    on_grid = cand.withColumn("k", F.rint(F.col("threshold") * F.lit(GRID)).cast("long"))
    # every bucket index exists in the dense range, so an equi-join finds it
    dense = df.sparkSession.range(K_LO - 1, K_HI + 1).select(F.col("id").alias("k"))
    cum_dense = dense.join(F.broadcast(per_k.select("k", "n", "pos")), "k", "left").select(
        "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("pos", F.lit(0)).alias("pos")
    )
    cum = cum_dense.select(
        "k",
        F.sum("n").over(suffix).alias("_ge_n"),
        F.sum("pos").over(suffix).alias("_ge_pos"),
    )
    joined = on_grid.join(F.broadcast(cum), "k", "left")
    joined = attach_scalars(joined, totals)
    if off_tot is not None:
        joined = attach_scalars(joined, off_tot)
    ge_n = F.coalesce(F.col("_ge_n"), F.lit(0))
    ge_pos = F.coalesce(F.col("_ge_pos"), F.lit(0))
    for i, a in enumerate(OFF_GRID):
        hit = F.col("threshold") == F.lit(a)
        ge_n = F.when(hit, F.col(f"_off_n{i}")).otherwise(ge_n)
        ge_pos = F.when(hit, F.col(f"_off_pos{i}")).otherwise(ge_pos)
    tp = ge_pos.cast("double")
    fp = (ge_n - ge_pos).cast("double")
    cols = summary_columns(tp, fp, F.col("_n"), F.col("_P"))
    return joined.select(F.col("threshold"), *[v.alias(name) for name, v in cols.items()])


def f_half(precision: Column, recall: Column) -> Column:
    """F0.5 as the reference writes it: 1.25*p*r / (0.25*p + r + 1e-9)."""
    return (F.lit(1.25) * precision * recall) / (F.lit(0.25) * precision + recall + F.lit(1e-9))


def pick_outreach(sweep_df: DataFrame) -> DataFrame:
    """Max (profit, precision, recall); ties -> lowest threshold."""
    return sweep_df.orderBy(
        F.col("profit").desc(), F.col("precision").desc(), F.col("recall").desc(), F.col("threshold").asc()
    ).limit(1)


def pick_high(sweep_df: DataFrame, min_precision: float = S.HIGH_PRECISION_TARGET) -> DataFrame:
    """T4 / T5: best recall among tp>0 and precision>=target, else best F0.5.

    Both branches are evaluated in one ordered pass: valid rows rank first.
    """
    valid = (F.col("true_positive") > 0) & (F.col("precision") >= F.lit(float(min_precision)))
    fh = f_half(F.col("precision"), F.col("recall"))
    any_valid = sweep_df.agg(F.max(valid.cast("int")).alias("_any_valid"))
    ranked = attach_scalars(sweep_df, any_valid).where((F.col("_any_valid") == 0) | valid)
    k1 = F.when(F.col("_any_valid") == 1, F.col("recall")).otherwise(fh)
    return ranked.orderBy(k1.desc(), F.col("precision").desc(), F.col("threshold").asc()).limit(1).drop("_any_valid")


def learn_policy(df: DataFrame, score_col: str, label_col: str,
                 min_precision: float = S.HIGH_PRECISION_TARGET) -> DataFrame:
    """Outreach and high-confidence rows; high falls back to outreach if lower."""
    sw = sweep(df, score_col, label_col).checkpoint(eager=True)     # at most about 10,000 rows, used three times
    out = pick_outreach(sw).withColumn("policy", F.lit("outreach"))
    high = pick_high(sw, min_precision).withColumn("policy", F.lit("high"))
    # T6 guard, expressed as data: take outreach's row when high < outreach
    pair = high.alias("h").crossJoin(out.alias("o"))  # one row each
    guarded = pair.select(
        *[
            F.when(F.col("h.threshold") < F.col("o.threshold"), F.col(f"o.{c}")).otherwise(F.col(f"h.{c}")).alias(c)
            for c in sw.columns
        ]
    ).withColumn("policy", F.lit("high"))
    return out.select("policy", *sw.columns).unionByName(guarded.select("policy", *sw.columns))


def break_even_rate() -> float:
    """Call cost / course price."""
    return S.CALL_COST_INR / S.COURSE_PRICE_INR
