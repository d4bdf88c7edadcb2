"""Skew: a key holding a third of all rows must not land in one task."""

from pyspark.sql import functions as F

from propensia.operators.rank import global_rank, score_order
from propensia.operators.validate import validation_report


def test_hot_score_is_split_across_range_partitions(spark):
    n = 6000
    df = spark.range(n).select(
        F.format_string("id%06d", F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.rand(7)).alias("s"),
    )
    parts = 8
    ranked = global_rank(df, score_order("s", "k"), num_partitions=parts)
    sizes = [r["c"] for r in ranked.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("c")).collect()]
    # the hot value (2000 rows) spans several partitions; none is far above n/parts
    assert max(sizes) < 2.5 * n / parts
    ranks = sorted(r["rank"] for r in ranked.select("rank").collect())
    assert ranks == list(range(1, n + 1))


def test_hot_duplicate_id_counted_with_partial_aggregation(spark):
    n = 3000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.col("id").cast("string")).alias("student_id"),
        F.lit(1).alias("purchased_paid_course"),
    )
    rep = {r["rule"]: r["bad_rows"] for r in validation_report(df, True).collect()}
    assert rep["V4"] == n // 3
