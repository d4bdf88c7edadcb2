"""Distributed rank / running sums / deciles / lift against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from propensia.operators.rank import decile_table, gains_curve, global_rank, lift_at, rank_within_groups, score_order


def make(spark, n, hot_fraction=0.34, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = 0.5 if rnd.random() < hot_fraction else round(rnd.random(), 2)  # one hot value + ties
        rows.append((f"id{i:05d}", s, int(rnd.random() < 0.3)))
    return rows, spark.createDataFrame(rows, "k string, s double, y int")


def brute_order(rows):
    return sorted(rows, key=lambda r: (-r[1], r[0]))


@pytest.mark.parametrize("n,parts", [(1, 4), (7, 4), (500, 8), (2000, 16)])
def test_global_rank_and_running_sum(spark, n, parts):
    rows, df = make(spark, n)
    out = global_rank(df, score_order("s", "k"), sums={"cum": "y"}, num_partitions=parts).collect()
    got = {r["k"]: (r["rank"], r["cum"]) for r in out}
    cum = 0
    for i, r in enumerate(brute_order(rows), start=1):
        cum += r[2]
        assert got[r[0]] == (i, cum)


def test_rank_without_sums_uses_jvm_path(spark):
    rows, df = make(spark, 300)
    out = global_rank(df, score_order("s", "k"), num_partitions=6).collect()
    expect = {r[0]: i for i, r in enumerate(brute_order(rows), start=1)}
    assert {r["k"]: r["rank"] for r in out} == expect


def test_rank_within_groups(spark):
    rows, df = make(spark, 400)
    out = rank_within_groups(df, "y", [F.col("s").desc(), F.col("k")], num_partitions=5).collect()
    for label in (0, 1):
        sub = brute_order([r for r in rows if r[2] == label])
        expect = {r[0]: i for i, r in enumerate(sub, start=1)}
        assert {r["k"]: r["rank"] for r in out if r["y"] == label} == expect


@pytest.mark.parametrize("n", [1, 3, 9, 10, 15, 101])
def test_decile_boundaries(spark, n):
    rows, df = make(spark, n, seed=n)
    got = {r["decile"]: r for r in decile_table(df, "s", "y", "k").collect()}
    order = brute_order(rows)
    base = sum(r[2] for r in rows) / n
    for d in range(10):
        part = order[int(d * n / 10): int((d + 1) * n / 10)]
        r = got[d + 1]
        assert r["students"] == len(part)
        assert r["actual_buyers"] == sum(p[2] for p in part)
        if part:
            rate = sum(p[2] for p in part) / len(part)
            assert r["conversion_rate"] == pytest.approx(rate, abs=1e-6)
            assert r["lift"] == pytest.approx(rate / (base + 1e-9), abs=1e-6)
        else:
            assert r["conversion_rate"] is None


@pytest.mark.parametrize("n", [5, 30, 333])
def test_lift(spark, n):
    rows, df = make(spark, n, seed=7)
    order = brute_order(rows)
    pos = sum(r[2] for r in rows)
    for r in lift_at(df, "s", "y", "k", (0.1, 0.2)).collect():
        n_top = max(1, int(math.ceil(n * r["fraction"])))
        top = sum(p[2] for p in order[:n_top])
        assert r["n_top"] == n_top
        assert r["buyers_captured"] == pytest.approx(top / (pos + 1e-9), abs=1e-6)
        assert r["lift"] == pytest.approx((top / n_top) / (pos / n + 1e-9), abs=1e-6)


def test_gains_curve(spark):
    rows, df = make(spark, 250)
    out = {r["k"]: r for r in gains_curve(df, "s", "y", "k").collect()}
    cum = 0
    pos = sum(r[2] for r in rows)
    for i, r in enumerate(brute_order(rows), start=1):
        cum += r[2]
        assert out[r[0]]["cum_buyers"] == cum
        assert out[r[0]]["pct_contacted"] == pytest.approx(i / 250 * 100, abs=1e-6)
        assert out[r[0]]["pct_captured"] == pytest.approx(cum / (pos + 1e-9) * 100, abs=1e-6)
