"""Ranking and probability metrics.

Curve metrics are computed from one table with a row per *distinct* score:
``(score, pos, neg)``, then running ``tp`` / ``fp`` in descending score order
from the distributed rank skeleton.  With that table

* ROC-AUC (trapezoid, ties count one half) = sum(neg * (2*tp - pos)) / (2*P*N)
* average precision = sum(pos/P * tp/(tp+fp))
* PR-AUC (trapezoid from (recall 0, precision 1)) uses the previous point,
  which is recoverable in-row as (tp-pos, fp-neg)

so each is a single aggregate -- no lag, no single-partition window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.numeric import round_to
from .rank import attach_scalars, global_rank
from .rank_table import RankTable


RANK_BLOCK = 100_000      # distinct scores per window partition when neighbours are looked up


def score_counts(df: DataFrame, score_col: str, label_col: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Positives / negatives per distinct score (partial aggregation)."""
    y = F.col(label_col).cast("long")
    return df.groupBy(*keys, F.col(score_col).alias("score")).agg(
        F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg")
    )


def score_curve(df: DataFrame | RankTable, score_col: str, label_col: str, num_partitions: int | None = None,
                keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct scores, descending, with cumulative tp / fp and totals P / N (per ``keys``, if given).

    One pass over the input: totals and group offsets come from the ranked,
    checkpointed table of distinct scores, or from a rank table.
    """
    if isinstance(df, RankTable):
        return df.curve()
    counts = score_counts(df, score_col, label_col, keys)
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col("score").desc()]
    ranked = global_rank(counts, order, rank_col="k", sums={"tp": "pos", "fp": "neg"}, num_partitions=num_partitions)
    totals = [F.sum("pos").cast("double").alias("P"), F.sum("neg").cast("double").alias("N")]
    if not keys:
        return attach_scalars(ranked, ranked.agg(*totals))
    groups = ranked.groupBy(*keys).agg(*totals, (F.min("k") - 1).alias("_k0"), F.min(F.col("tp") - F.col("pos")).alias("_tp0"),
                                       F.min(F.col("fp") - F.col("neg")).alias("_fp0"))
    return ranked.join(groups, list(keys)).withColumns({
        "k": F.col("k") - F.col("_k0"), "tp": F.col("tp") - F.col("_tp0"), "fp": F.col("fp") - F.col("_fp0"),
    }).drop("_k0", "_tp0", "_fp0")


def ranking_metrics(df: DataFrame, score_col: str, label_col: str, num_partitions: int | None = None,
                    keys: tuple[str, ...] = ()) -> DataFrame:
    """roc_auc, average_precision, pr_auc, brier_score; one row, or one per ``keys`` in the same pass.

    A metric that is undefined (one class only, no rows) is NULL instead of an
    error.  Brier is exact from the score table: pos * (s - 1)^2 + neg * s^2.
    """
    c = score_curve(df, score_col, label_col, num_partitions, keys)
    prec = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    prev_tp = F.col("tp") - F.col("pos")
    prev_fp = F.col("fp") - F.col("neg")
    prev_prec = F.when(prev_tp + prev_fp == 0, F.lit(1.0)).otherwise(F.try_divide(prev_tp, prev_tp + prev_fp))
    s = F.col("score")
    aggs = [
        F.first("P").alias("P"),
        F.first("N").alias("N"),
        F.sum(F.col("neg") * (F.lit(2.0) * F.col("tp") - F.col("pos"))).alias("_auc_num"),
        F.sum(F.col("pos") * prec).alias("_ap_num"),
        F.sum(F.col("pos") * (prec + prev_prec) / F.lit(2.0)).alias("_pr_num"),
        F.sum(F.col("pos") * F.pow(s - F.lit(1.0), 2) + F.col("neg") * F.pow(s, 2)).alias("_sq"),
    ]
    curve = c.groupBy(*keys).agg(*aggs) if keys else c.agg(*aggs)
    return curve.select(
        *keys,
        round_to(F.try_divide(F.col("_auc_num"), F.lit(2.0) * F.col("P") * F.col("N")), 6).alias("roc_auc"),
        round_to(F.try_divide(F.col("_ap_num"), F.col("P")), 6).alias("average_precision"),
        round_to(F.try_divide(F.col("_pr_num"), F.col("P")), 6).alias("pr_auc"),
        round_to(F.try_divide(F.col("_sq"), F.col("P") + F.col("N")), 6).alias("brier_score"),
    )


def _with_next(curve: DataFrame) -> DataFrame:
    """Attach the next point's increments: a window over blocks of the rank, and the first point of the block behind."""
    block = F.floor((F.col("k") - 1) / RANK_BLOCK)
    c = curve.withColumn("_block", block)
    w = Window.partitionBy("_block").orderBy("k")
    firsts = c.where((F.col("k") - 1) % RANK_BLOCK == 0).select(
        (F.col("_block") - 1).alias("_block"), F.col("pos").alias("_first_pos"), F.col("neg").alias("_first_neg"))
    led = c.withColumns({"next_pos": F.lead("pos").over(w), "next_neg": F.lead("neg").over(w)})
    return led.join(firsts, "_block", "left").withColumns({
        "next_pos": F.coalesce("next_pos", "_first_pos"), "next_neg": F.coalesce("next_neg", "_first_neg"),
    }).drop("_block", "_first_pos", "_first_neg")


def roc_points(df: DataFrame, score_col: str, label_col: str, num_partitions: int | None = None) -> DataFrame:
    """E5: ROC points from (0, 0), dropping points whose increments repeat.

    A middle point is kept when its (neg, pos) increment differs from the next
    one (a nonzero second difference); the first and last are always kept.
    The origin carries a NULL threshold; with one class only the rate of the
    other is NULL.
    """
    c = _with_next(score_curve(df, score_col, label_col, num_partitions))
    keep = (
        (F.col("k") == 1)
        | F.col("next_pos").isNull()
        | (F.col("next_pos") != F.col("pos"))
        | (F.col("next_neg") != F.col("neg"))
    )
    pts = c.where(keep).select(
        F.col("k").alias("point"),
        F.col("score").alias("threshold"),
        round_to(F.try_divide(F.col("fp"), F.col("N")), 6).alias("fpr"),
        round_to(F.try_divide(F.col("tp"), F.col("P")), 6).alias("tpr"),
    )
    origin = df.sparkSession.createDataFrame(
        [(0, None, 0.0, 0.0)], "point long, threshold double, fpr double, tpr double"
    )
    return origin.unionByName(pts)


def pr_points(df: DataFrame, score_col: str, label_col: str, num_partitions: int | None = None) -> DataFrame:
    """Precision / recall at every distinct score, then the (recall 0, precision 1) end."""
    c = score_curve(df, score_col, label_col, num_partitions)
    tot = F.col("tp") + F.col("fp")
    pts = c.select(
        F.col("k").alias("point"),
        F.col("score").alias("threshold"),
        round_to(F.when(tot > 0, F.try_divide(F.col("tp"), tot)).otherwise(F.lit(0.0)), 6).alias("precision"),
        round_to(F.when(F.col("P") > 0, F.try_divide(F.col("tp"), F.col("P"))).otherwise(F.lit(1.0)), 6).alias("recall"),
    )
    end = c.agg((F.coalesce(F.max("k"), F.lit(0)) + 1).alias("point")).select(
        "point",
        F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    return pts.unionByName(end)


def calibration_edges(n_bins: int = 10) -> list[float]:
    """Interior uniform edges exactly as ``i * (1/n)`` in double precision."""
    step = 1.0 / n_bins
    return [i * step for i in range(1, n_bins)]


def calibration_bins(df: DataFrame, score_col: str, label_col: str, n_bins: int = 10) -> DataFrame:
    """Right-closed uniform bins; observed rate and mean score of non-empty bins."""
    s = F.col(score_col)
    bin_id = sum((s > F.lit(e)).cast("int") for e in calibration_edges(n_bins))
    return (
        df.groupBy(bin_id.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("students"),
            F.avg(F.col(label_col).cast("double")).alias("prob_true"),
            F.avg(s).alias("prob_pred"),
        )
        .select("bin", "students", round_to("prob_true", 6).alias("prob_true"), round_to("prob_pred", 6).alias("prob_pred"))
    )


def confusion(df: DataFrame, score_col: str, label_col: str, threshold: float) -> DataFrame:
    """The 2x2 matrix at ``threshold`` (always four cells)."""
    y = F.col(label_col).cast("int")
    p = (F.col(score_col) >= F.lit(float(threshold))).cast("int")
    agg = df.agg(
        F.count_if((y == 0) & (p == 0)).alias("c00"),
        F.count_if((y == 0) & (p == 1)).alias("c01"),
        F.count_if((y == 1) & (p == 0)).alias("c10"),
        F.count_if((y == 1) & (p == 1)).alias("c11"),
    )
    cells = [
        F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(f"c{a}{b}").alias("students"))
        for a in (0, 1)
        for b in (0, 1)
    ]
    return agg.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def summary_columns(tp, fp, n, P):
    """E9 columns from counts (shared with the threshold sweep)."""
    fn = P - tp
    return {
        "precision": tp / (tp + fp + F.lit(1e-9)),
        "recall": tp / (tp + fn + F.lit(1e-9)),
        "coverage": F.try_divide(tp + fp, n),
        "profit": (F.lit(S.COURSE_PRICE_INR) * tp - F.lit(S.CALL_COST_INR) * (tp + fp)).cast("long"),
        "true_positive": tp.cast("long"),
        "false_positive": fp.cast("long"),
        "false_negative": fn.cast("long"),
    }


def threshold_summary(df: DataFrame, score_col: str, label_col: str, thresholds: list[float]) -> DataFrame:
    """E9 at each given threshold; predicate ``score >= t``; one scan for all."""
    s = F.col(score_col)
    y = F.col(label_col).cast("long")
    aggs = [F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_P")]
    for i, t in enumerate(thresholds):
        aggs.append(F.count_if((s >= F.lit(float(t))) & (y == 1)).alias(f"_tp{i}"))
        aggs.append(F.count_if((s >= F.lit(float(t))) & (y == 0)).alias(f"_fp{i}"))
    one = df.agg(*aggs)
    rows = [
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_tp{i}").alias("tp"), F.col(f"_fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)
    ]
    long = one.select("_n", "_P", F.explode(F.array(*rows)).alias("r")).select("_n", "_P", "r.*")
    cols = summary_columns(F.col("tp"), F.col("fp"), F.col("_n"), F.col("_P"))
    return long.select(
        "threshold",
        *[(round_to(v, 6) if k in ("precision", "recall", "coverage") else v).alias(k) for k, v in cols.items()],
    )


def fold_summary(fold_metrics: DataFrame) -> DataFrame:
    """Mean of each metric per candidate over its folds."""
    metric_cols = [c for c in fold_metrics.columns if c not in ("candidate", "fold")]
    return fold_metrics.groupBy("candidate").agg(*[F.avg(c).alias(c) for c in metric_cols])
