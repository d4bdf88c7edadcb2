"""What a boosting job ships and how many tasks it has (F1, F2)."""

from propensia.operators import gbt
from propensia.plans import training


def test_fit_rows_are_few_tasks_with_a_short_lineage(spark):
    rows = spark.range(400).selectExpr("cast(id % 3 as string) AS kind", "cast(id AS double) AS x",
                                       "cast(id % 2 as int) AS purchased_paid_course").repartition(7)
    enc = training._fit_encoder(rows, ["kind", "x"])
    fit = training._fit_rows(enc, rows)
    assert fit.count() == 400 and fit.agg({"label": "sum"}).first()[0] == 200
    assert fit.rdd.getNumPartitions() == 1                        # 7 before: each a task of every job
    assert "Exchange" not in fit._jdf.queryExecution().toString()  # nothing but the checkpoint is shipped


def test_tasks_grow_with_the_rows_alone():
    assert [gbt.n_tasks(n) for n in (0, 1, gbt.ROWS_PER_TASK, gbt.ROWS_PER_TASK + 1, 60 * gbt.ROWS_PER_TASK)] == [1, 1, 1, 2, 60]


def test_longest_fits_start_first(monkeypatch):
    started = []
    monkeypatch.setattr(gbt, "fit_all", lambda spark, fits, in_flight: started.extend(fits) or {})
    short = {"name": "short", "params": {"n_estimators": 10, "max_depth": 2}}
    long = {"name": "long", "params": {"n_estimators": 10, "max_depth": 6}}
    gbt.fit_grid(None, {0: None, 1: None}, [short, long], 1)
    assert started == [("long", 0), ("long", 1), ("short", 0), ("short", 1)]
