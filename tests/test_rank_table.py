"""The persisted rank table against sorted lists and the one-off operators."""

import random
import tempfile

import pytest

from propensia.operators import metrics as M
from propensia.operators import rank as R
from propensia.operators.rank_table import RankTable, write_rank_table

KIND = "id string, s double, y int"


def built(spark, rows, n=6):
    path = tempfile.mkdtemp(prefix="rank-", dir="/tmp")
    return write_rank_table(spark.createDataFrame(rows, KIND).repartition(4), "s", "y", "id", path, n)


def scores(n, grid, seed=0):
    rng = random.Random(seed)
    return [(f"{i:05d}", round(rng.random() * grid) / grid, int(rng.random() < 0.3)) for i in range(n)]


@pytest.mark.parametrize("grid", [1, 5, 10**9])
def test_ranks_sums_and_distinct_scores(spark, grid):
    rows = scores(900, grid)                 # with a grid of 1 and 5, ties run over range borders
    t = built(spark, rows)
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    got = {r["id"]: (r["rank"], r["cum_buyers"]) for r in t.rows().collect()}
    buyers = 0
    for k, (i, _, y) in enumerate(order, 1):
        buyers += y
        assert got[i] == (k, buyers)
    assert tuple(t.totals().first()) == (900, buyers) and t.manifest.count() > 1
    df = spark.createDataFrame(rows, KIND)
    plain = {tuple(r) for r in M.score_curve(df, "s", "y").select("score", "pos", "neg", "tp", "fp", "k", "P", "N").collect()}
    assert {tuple(r) for r in t.curve().select("score", "pos", "neg", "tp", "fp", "k", "P", "N").collect()} == plain


def test_operators_read_either(spark):
    rows = scores(400, 40, seed=3)
    df, t = spark.createDataFrame(rows, KIND), built(spark, rows)
    for run in (lambda x: R.decile_table(x, "s", "y", "id"), lambda x: R.lift_at(x, "s", "y", "id", (0.1, 0.25)),
                lambda x: R.gains_curve(x, "s", "y", "id"), lambda x: M.ranking_metrics(x, "s", "y"),
                lambda x: M.roc_points(x, "s", "y"), lambda x: M.pr_points(x, "s", "y")):
        assert sorted(map(str, run(t).collect())) == sorted(map(str, run(df).collect()))


def test_no_query_sorts_again_and_top_reads_few_folders(spark, capsys):
    t = built(spark, scores(2000, 10**9), n=10)
    R.gains_curve(t, "s", "y", "id").explain()
    assert "rangepartitioning" not in capsys.readouterr().out
    top = t.top(20)
    top.explain("formatted")
    assert sorted(r["rank"] for r in top.collect()) == list(range(1, 21))
    parts = [r["part"] for r in t.manifest.where("rows_before < 20").collect()]
    assert len(parts) < t.manifest.count()
    assert "PartitionFilters" in capsys.readouterr().out


def test_opened_again_and_empty(spark):
    rows = scores(50, 7)
    t = built(spark, rows)
    again = RankTable(spark, t.path, "s", "y", "id")
    assert sorted(map(str, again.rows().collect())) == sorted(map(str, t.rows().collect()))
    null = built(spark, rows + [("x", None, 0), ("y", None, 1)])
    assert null.rows().where("id = 'x'").first()["rank"] == 51 and null.totals().first()["students"] == 52
