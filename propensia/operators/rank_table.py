"""A persisted rank table: one sort that every curve and ranking query reads.

Rows are range-partitioned by (score descending, id) and written sorted, one
folder per range, with their place, buyers so far and distinct scores so far
inside the range.  The manifest has one row per range: what it holds, and what
lies before it.  A global rank or running sum is then an addition; the top k
reads only the folders that the manifest says hold them; the curve over
distinct scores is one partial aggregation.  Nothing is sorted or checkpointed
again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import importable


def _places(score: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, buyers, distinct, last = 0, 0.0, 0, None
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            s = pdf[score].to_numpy(dtype="float64", na_value=np.nan)
            before = np.concatenate([[np.nan if last is None else last], s[:-1]])
            new = ~((s == before) | (np.isnan(s) & np.isnan(before)))
            new[0] = new[0] or rows == 0
            pdf["_place"] = np.arange(rows + 1, rows + n + 1)
            pdf["_buyers"] = buyers + pdf["_y"].fillna(0).cumsum()
            pdf["_distinct"] = distinct + np.cumsum(new)
            rows, buyers, distinct, last = rows + n, float(pdf["_buyers"].iloc[-1]), int(pdf["_distinct"].iloc[-1]), s[-1]
            yield pdf

    return run


@dataclass
class RankTable:
    """An opened rank table; ``label_col`` is 0/1."""

    spark: SparkSession
    path: str
    score_col: str
    label_col: str
    key_col: str

    @property
    def sparkSession(self) -> SparkSession:      # as a DataFrame has it
        return self.spark

    @property
    def manifest(self) -> DataFrame:
        """One row per range: part, rows, buyers, and rows_before, buyers_before, distinct_before."""
        return self.spark.read.parquet(f"{self.path}/manifest")

    def _with_offsets(self, rows: DataFrame) -> DataFrame:
        # one row per range partition: a bound set by the writer, not by the data
        return rows.join(F.broadcast(self.manifest.select("part", "rows_before", "buyers_before", "distinct_before")), "part")

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """Every row with its ``rank`` and ``cum_buyers``; of some ranges only, if given (their folders alone are read)."""
        df = self.spark.read.parquet(f"{self.path}/rows")
        df = self._with_offsets(df if parts is None else df.where(F.col("part").isin(parts)))
        return df.select(
            self.key_col, self.score_col, self.label_col, F.col(self.label_col).cast("double").alias("_y"),
            (F.col("rows_before") + F.col("_place")).alias("rank"), (F.col("buyers_before") + F.col("_buyers")).alias("cum_buyers"))

    def totals(self) -> DataFrame:
        """One row: students, buyers, from the manifest alone."""
        return self.manifest.agg(F.sum("rows").alias("students"), F.sum("buyers").alias("buyers"))

    def top(self, k: int) -> DataFrame:
        """The rows of rank 1 to ``k``, from the ranges that hold them."""
        parts = [r["part"] for r in self.manifest.where(F.col("rows_before") < k).select("part").collect()]
        return self.rows(parts).where(F.col("rank") <= k)

    def curve(self) -> DataFrame:
        """Distinct scores with pos, neg, cumulative tp / fp, place k and totals P / N: what ``metrics.score_curve`` gives."""
        rows = self._with_offsets(self.spark.read.parquet(f"{self.path}/rows"))
        y = F.col(self.label_col).cast("long")
        points = rows.groupBy(F.col(self.score_col).alias("score")).agg(
            F.sum(y).alias("pos"), F.sum(F.lit(1) - y).alias("neg"),
            F.max(F.col("buyers_before") + F.col("_buyers")).alias("tp"), F.max(F.col("rows_before") + F.col("_place")).alias("_n"),
            F.max(F.col("distinct_before") + F.col("_distinct")).alias("k"))
        t = self.totals()
        ends = t.select(F.col("buyers").cast("double").alias("P"), (F.col("students") - F.col("buyers")).cast("double").alias("N"))
        return points.select("score", "pos", "neg", "k", "tp", (F.col("_n") - F.col("tp")).alias("fp")).crossJoin(F.broadcast(ends))


def write_rank_table(df: DataFrame, score_col: str, label_col: str, key_col: str, path: str,
                     num_partitions: int | None = None) -> RankTable:
    """Sort once, write rows and manifest under ``path`` (the manifest last), and open the table."""
    spark = df.sparkSession
    importable(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    order = [F.col(score_col).desc(), F.col(key_col).asc()]
    ordered = df.select(key_col, score_col, label_col, F.col(label_col).cast("double").alias("_y")).repartitionByRange(
        n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ordered.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_buyers", T.DoubleType()),
                           T.StructField("_distinct", T.LongType())])
    ordered.mapInPandas(_places(score_col), schema).drop("_y").write.partitionBy("part").mode("overwrite").parquet(f"{path}/rows")

    held = spark.read.schema(T.StructType([f for f in schema.fields if f.name != "_y"])).parquet(f"{path}/rows").groupBy("part").agg(
        F.max("_place").alias("rows"), F.max_by("_buyers", "_place").alias("buyers"), F.max("_distinct").alias("distinct"),
        F.min_by(score_col, "_place").alias("first"), F.max_by(score_col, "_place").alias("last"))
    by_part = Window.orderBy("part")                       # one row per range
    shared = F.coalesce(F.col("first").eqNullSafe(F.lag("last").over(by_part)) & (F.lag("rows").over(by_part) > 0), F.lit(False)).cast("long")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    held.withColumn("shared", shared).select(
        "part", "rows", "buyers", zero(F.sum("rows").over(before)).alias("rows_before"),
        zero(F.sum("buyers").over(before)).cast("double").alias("buyers_before"),
        (zero(F.sum("distinct").over(before)) - F.sum("shared").over(upto)).alias("distinct_before")).coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/manifest")
    return RankTable(spark, path, score_col, label_col, key_col)
