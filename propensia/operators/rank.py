"""Global order operators: rank, running sums, deciles, lift.

A global ``row_number()`` or running ``sum`` with an un-partitioned window
moves every row into one task.  Here the order is computed the way a sort is:

1. ``repartitionByRange`` on a *total* order (the caller appends a unique key,
   so a hot score value -- even a third of all rows -- is split across many
   range partitions by the key);
2. inside each partition rows are sorted; the position inside the partition
   comes from ``monotonically_increasing_id`` (JVM only) or, when running sums
   are wanted, from one Arrow-batched ``mapInPandas`` pass;
3. the tagged rows are written with a reliable ``checkpoint()`` so that the
   per-partition totals and the final rows come from the same bytes even if
   an executor is lost and stages are recomputed;
4. per-partition totals (one row per range partition -- a bound set by the
   caller, never by the data) are prefix-summed and broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .rank_table import RankTable

_PID = "_rk_pid"
_LOCAL = "_rk_local"


def _range_partitions(df: DataFrame, num_partitions: int | None) -> int:
    if num_partitions:
        return int(num_partitions)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def _local_running_sums(sum_cols: Sequence[str]):
    """mapInPandas body: position and running sums inside one sorted partition."""

    def run(batches):
        position = 0
        carry = {c: 0.0 for c in sum_cols}
        for pdf in batches:
            n = len(pdf)
            pdf[_LOCAL] = pd.RangeIndex(position, position + n).to_numpy(dtype="int64")
            position += n
            for c in sum_cols:
                vals = pdf[c].fillna(0).astype("float64")
                cs = vals.cumsum() + carry[c]
                if n:
                    carry[c] = float(cs.iloc[-1])
                pdf[f"_rk_cum_{c}"] = cs
            yield pdf

    return run


def global_rank(
    df: DataFrame,
    order: Sequence[Column],
    rank_col: str = "rank",
    sums: dict[str, str] | None = None,
    num_partitions: int | None = None,
) -> DataFrame:
    """1-based row number of every row under ``order`` (which must be total).

    ``sums`` maps an output column to an input column; each output is the
    inclusive running sum of the input in rank order.  Result rows come back
    globally sorted (range partitions in order, sorted inside).
    """
    sums = dict(sums or {})
    ensure_checkpoint_dir(df.sparkSession)
    n = _range_partitions(df, num_partitions)
    ordered = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ordered = ordered.withColumn(_PID, F.spark_partition_id())
    if sums:
        src_cols = sorted(set(sums.values()))
        schema = T.StructType(
            list(ordered.schema.fields)
            + [T.StructField(_LOCAL, T.LongType(), False)]
            + [T.StructField(f"_rk_cum_{c}", T.DoubleType(), True) for c in src_cols]
        )
        tagged = ordered.mapInPandas(_local_running_sums(src_cols), schema)
    else:
        src_cols = []
        tagged = ordered.withColumn(
            _LOCAL,
            F.monotonically_increasing_id()
            - F.shiftleft(F.col(_PID).cast("long"), 33),
        )
    tagged = tagged.checkpoint(eager=True)

    totals = tagged.groupBy(_PID).agg(
        F.count(F.lit(1)).alias("_rk_n"),
        *[F.sum(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(f"_rk_tot_{c}") for c in src_cols],
    )
    before = Window.orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _PID,
        F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).alias("_rk_off"),
        *[
            F.coalesce(F.sum(f"_rk_tot_{c}").over(before), F.lit(0.0)).alias(f"_rk_offsum_{c}")
            for c in src_cols
        ],
    )
    # one row per range partition: bounded by ``n``, not by the data
    out = tagged.join(F.broadcast(offsets), _PID, "inner")
    out = out.withColumn(rank_col, (F.col("_rk_off") + F.col(_LOCAL) + 1).cast("long"))
    for out_col, c in sums.items():
        out = out.withColumn(out_col, F.col(f"_rk_offsum_{c}") + F.col(f"_rk_cum_{c}"))
    drop = [_PID, _LOCAL, "_rk_off"] + [f"_rk_offsum_{c}" for c in src_cols] + [
        f"_rk_cum_{c}" for c in src_cols
    ]
    return out.drop(*drop)


def score_order(score_col: str, key_col: str) -> list[Column]:
    """The repo-wide order: score descending, then key ascending."""
    return [F.col(score_col).desc(), F.col(key_col).asc()]


def attach_scalars(df: DataFrame, scalars: DataFrame) -> DataFrame:
    """Attach the columns of a global (un-grouped) aggregate to every row.

    ``scalars`` must be an aggregate without grouping keys, which has exactly
    one row, so the broadcast is bounded and the join multiplies nothing.
    """
    return df.crossJoin(F.broadcast(scalars))


def decile_index(rank: Column, n: Column) -> Column:
    """0-based decile under floor boundaries [int(d*n/10), int((d+1)*n/10)).

    For a 1-based rank this is floor((10*rank - 1) / n); it differs from
    ``ntile`` whenever n is not a multiple of 10.
    """
    return F.floor((F.lit(10) * rank - 1) / n).cast("int")


def _ranked_rows(df: DataFrame | RankTable, score_col: str, label_col: str, key_col: str, num_partitions: int | None) -> DataFrame:
    """key, score, label and rank of every row: sorted now, or read from a rank table that was."""
    if isinstance(df, RankTable):
        return df.rows().drop("_y", "cum_buyers")
    return global_rank(df.select(key_col, score_col, label_col), score_order(score_col, key_col), num_partitions=num_partitions)


def decile_table(
    df: DataFrame | RankTable, score_col: str, label_col: str, key_col: str, num_partitions: int | None = None
) -> DataFrame:
    """Students, buyers, conversion, mean score and lift per score decile."""
    ranked = _ranked_rows(df, score_col, label_col, key_col, num_partitions)
    totals = ranked.agg(F.count(F.lit(1)).alias("_n"), F.avg(F.col(label_col).cast("double")).alias("_base"))
    tagged = attach_scalars(ranked, totals).withColumn(
        "decile", decile_index(F.col("rank"), F.col("_n")) + 1
    )
    agg = tagged.groupBy("decile").agg(
        F.count(F.lit(1)).alias("students"),
        F.sum(F.col(label_col).cast("long")).alias("actual_buyers"),
        F.avg(F.col(label_col).cast("double")).alias("conversion_rate"),
        F.avg(F.col(score_col)).alias("avg_probability"),
    )
    spark = df.sparkSession
    all_deciles = spark.range(1, 11).select(F.col("id").cast("int").alias("decile"))
    joined = attach_scalars(all_deciles.join(F.broadcast(agg), "decile", "left"), totals)
    return joined.select(
        "decile",
        F.coalesce(F.col("students"), F.lit(0)).cast("long").alias("students"),
        F.coalesce(F.col("actual_buyers"), F.lit(0)).cast("long").alias("actual_buyers"),
        round_to("conversion_rate", 6).alias("conversion_rate"),
        round_to("avg_probability", 6).alias("avg_probability"),
        round_to(F.col("conversion_rate") / (F.col("_base") + F.lit(1e-9)), 6).alias("lift"),
    )


def lift_at(
    df: DataFrame | RankTable,
    score_col: str,
    label_col: str,
    key_col: str,
    fractions: Sequence[float] = (0.10, 0.20),
    num_partitions: int | None = None,
) -> DataFrame:
    """Capture and lift in the top fraction, n_top = max(1, ceil(n * f)).

    One pass over the ranked rows: every fraction is a conditional sum.
    """
    ranked = _ranked_rows(df, score_col, label_col, key_col, num_partitions)
    totals = ranked.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label_col).cast("double")).alias("_pos"))
    y = F.col(label_col).cast("double")
    ntop = {
        i: F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_n") * F.lit(float(f))).cast("long"))
        for i, f in enumerate(fractions)
    }
    agg = attach_scalars(ranked, totals).agg(
        F.first("_n").alias("_n"),
        F.first("_pos").alias("_pos"),
        *[F.sum(F.when(F.col("rank") <= ntop[i], y).otherwise(0.0)).alias(f"_top{i}") for i in ntop],
    )
    rows = [
        F.struct(
            F.lit(float(f)).alias("fraction"),
            F.greatest(F.lit(1).cast("long"), F.ceil(F.col("_n") * F.lit(float(f))).cast("long")).alias("n_top"),
            F.col(f"_top{i}").alias("_top_pos"),
        )
        for i, f in enumerate(fractions)
    ]
    long = agg.select("_n", "_pos", F.explode(F.array(*rows)).alias("r")).select("_n", "_pos", "r.*")
    return long.select(
        "fraction",
        "n_top",
        round_to(F.col("_top_pos") / (F.col("_pos") + F.lit(1e-9)), 6).alias("buyers_captured"),
        round_to(
            (F.col("_top_pos") / F.col("n_top")) / (F.col("_pos") / F.col("_n") + F.lit(1e-9)), 6
        ).alias("lift"),
        round_to(F.col("_top_pos") / F.col("n_top"), 6).alias("top_conversion_rate"),
    )


def gains_curve(
    df: DataFrame | RankTable, score_col: str, label_col: str, key_col: str, num_partitions: int | None = None
) -> DataFrame:
    """Per-row cumulative capture: % contacted vs % buyers captured (R2)."""
    ranked = df.rows() if isinstance(df, RankTable) else global_rank(
        df.select(key_col, score_col, F.col(label_col).cast("double").alias("_y")),
        score_order(score_col, key_col),
        sums={"cum_buyers": "_y"},
        num_partitions=num_partitions,
    )
    totals = ranked.agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_pos"))
    return attach_scalars(ranked, totals).select(
        F.col(key_col),
        F.col("rank"),
        F.col("cum_buyers").cast("long").alias("cum_buyers"),
        round_to(F.col("rank") / F.col("_n") * 100, 6).alias("pct_contacted"),
        round_to(F.col("cum_buyers") / (F.col("_pos") + F.lit(1e-9)) * 100, 6).alias("pct_captured"),
    )


def rank_within_groups(
    df: DataFrame,
    group_col: str,
    order: Sequence[Column],
    rank_col: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """1-based rank inside each group, without a per-group window.

    One global rank over ``(group, order...)``; the rank of a group's first
    row is then subtracted.  The join with the groups' first ranks is left to
    the engine: it is broadcast only if the groups are few.
    """
    ranked = global_rank(df, [F.col(group_col).asc_nulls_first(), *order], rank_col="_g_rank",
                         num_partitions=num_partitions)
    starts = ranked.groupBy(group_col).agg(
        F.min("_g_rank").alias("_g_start"), F.count(F.lit(1)).alias("_g_n")
    )
    out = ranked.join(starts, group_col, "inner")
    return out.withColumn(rank_col, F.col("_g_rank") - F.col("_g_start") + 1).drop("_g_rank", "_g_start")
