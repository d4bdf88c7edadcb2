"""Sums of whole doubles without a decimal per value, and the assembled features that use them."""

from pyspark.sql import functions as F

from propensia.functions.numeric import exact_sum
from propensia.plans import catalog


def test_equals_the_sum_of_decimals(spark):
    big = float(1 << 53)
    groups = {"mixed": [1.0, -3.0, 0.0, None], "large": [big, big, -5.0, 1e20, 7e18], "none": [None], "negative": [-big, -1.0, -67108865.0]}
    rows = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double")
    old = F.sum(F.col("x").cast("decimal(38,0)"))
    got = rows.groupBy("k").agg(exact_sum(F.col("x")).alias("new"), old.alias("old")).collect()
    assert len(got) == 4 and all(r["new"] == r["old"] for r in got)


def test_training_rows_are_derived_once(spark, monkeypatch):
    """The three tables were joined again for every reading of the training rows."""
    kept, real = [], catalog._training_rows
    monkeypatch.setattr(catalog, "_training_rows", lambda *a: kept.append(real(*a)) or kept[-1])
    out = catalog.q_assembled_features(spark, "/root/testdata/sf0.001")
    assert "orders.parquet" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[-1]
    assert out.where("students <= 0").count() == 0
