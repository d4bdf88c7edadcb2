"""Pooling, medians and hybrid encoding against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensia.operators import medians as ME
from propensia.operators import prep as P
from propensia.operators.model import calibrate, fit_calibrator
from propensia.operators.pooling import pool, pooled_blocks


def plain_pool(points):
    """Blocks of the increasing fit by repeated passes over a list."""
    blocks = [[s, s, t, w] for s, t, w in points]
    again = True
    while again:
        again = False
        for i in range(len(blocks) - 1):
            if blocks[i][2] / blocks[i][3] >= blocks[i + 1][2] / blocks[i + 1][3]:
                a, b = blocks[i], blocks.pop(i + 1)
                blocks[i] = [a[0], b[1], a[2] + b[2], a[3] + b[3]]
                again = True
                break
    return [tuple(b) for b in blocks]


def points_of(rows):
    by = {}
    for s, y in rows:
        t, w = by.get(s, (0.0, 0.0))
        by[s] = (t + y, w + 1)
    return [(s, *by[s]) for s in sorted(by)]


@pytest.mark.parametrize("seed", range(4))
def test_blocks_equal_a_plain_pooling(spark, seed):
    rng = random.Random(seed)
    rows = [(round(rng.random(), rng.choice([1, 2, 6])), int(rng.random() < 0.3)) for _ in range(600)]
    df = spark.createDataFrame(rows + [(None, 1), (0.5, None)], "s double, y int").repartition(7)
    got = sorted((r["lo"], r["hi"], r["mean"], r["weight"]) for r in pooled_blocks(df, "s", "y", fan_in=2).collect())
    want = plain_pool(points_of(rows))
    assert [(a, b, w) for a, b, _, w in got] == [(a, b, w) for a, b, _, w in want]
    assert [m for _, _, m, _ in got] == pytest.approx([t / w for _, _, t, w in want])


def test_stacks_merge_in_any_grouping():
    rng = random.Random(9)
    points = [(float(i), float(i), float(rng.random() < i / 300), 1.0) for i in range(300)]
    whole = pool(points)
    for cuts in ([100, 200], [1, 2, 3, 299], [150]):
        parts = [pool(points[a:b]) for a, b in zip([0, *cuts], [*cuts, 300])]
        assert pool(b for p in parts for b in p) == whole
        left = parts[0]
        for p in parts[1:]:
            left = pool([*left, *p])
        assert left == whole


def test_few_blocks_reach_the_root(spark):
    n = 40_000
    df = spark.range(n).select((F.col("id") / n).alias("s"), (F.rand(3) < F.col("id") / n).cast("int").alias("y"))
    assert pooled_blocks(df, "s", "y").count() < n ** (2 / 3)


def test_calibration_is_monotone_and_clamped(spark):
    rng = random.Random(2)
    rows = [(rng.random(), int(rng.random() < 0.4)) for _ in range(400)]
    model = fit_calibrator(spark.createDataFrame(rows, "raw_score double, label int"))
    blocks = plain_pool(points_of(rows))
    xs = [x for lo, hi, _, _ in blocks for x in ((lo, hi) if lo < hi else (lo,))]
    ys = [t / w for lo, hi, t, w in blocks for _ in ((lo, hi) if lo < hi else (lo,))]
    probe = [-1.0, 2.0, *(rng.random() for _ in range(100))]
    got = {r["raw_score"]: r["score"] for r in calibrate(spark.createDataFrame([(x,) for x in probe], "raw_score double"), model).collect()}
    assert [got[x] for x in probe] == pytest.approx(np.interp(probe, xs, ys).tolist())
    assert pooled_blocks(spark.createDataFrame([], "s double, y int"), "s", "y").count() == 0


# ------------------------------------------------------------------ medians
def test_medians_of_odd_columns(spark):
    rng = random.Random(5)
    cols = {
        "even": [1.0, 2.0, 3.0, 4.0] * 50, "gone": [None] * 200, "nan": [float("nan"), 7.0] * 100,
        "hot": [0.0] * 150 + [float(i) for i in range(50)], "inf": [float("inf")] * 120 + [1.0] * 80,
        "signed": [rng.choice([-0.0, 0.0, -5.0, 5.0]) for _ in range(200)], "wide": [rng.gauss(0, 1e9) for _ in range(200)]}
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(5)
    want = {}
    for i, (c, v) in enumerate(cols.items()):
        live = [x for x in v if x is not None and not math.isnan(x)]
        if live:
            want[i] = float(np.median(live))
    got = {r["c"]: r["median"] for r in ME.exact_medians(df, list(cols)).collect()}
    assert got == want
    near = {r["c"]: r["median"] for r in ME.approx_medians(df, list(cols)).collect()}
    assert set(near) == set(want) and near[3] == 0.0


def test_a_missed_bracket_is_opened(spark):
    values = [float(i) for i in range(1001)]
    numbers = spark.createDataFrame([(v,) for v in values], "v0 double")
    found, missed = ME._repair(numbers, {0: (900.0, 950.0)}, {0: 1001})
    assert missed == [0] and found.count() == 0
    found, missed = ME._repair(numbers, {0: (-math.inf, math.inf)}, {0: 1001})
    assert missed == [] and found.first()["median"] == 500.0


def test_values_are_handed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(ME, "HELD_VALUES", 10)
    df = spark.range(5000).select((F.col("id") % 977).cast("double").alias("a"))
    assert ME.exact_medians(df, ["a"]).first()["median"] == float(np.median([i % 977 for i in range(5000)]))


def test_points_of_chunks_bracket_the_middle(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for most in (2, 7, 30):
        for values in (rng.normal(size=501), rng.integers(0, 20, 400).astype(float), np.array([4.0])):
            v, n, left = ME._points(values, most)
            assert len(v) <= most or len(v) == len(set(values)) <= most
            upto, true = np.cumsum(n), np.searchsorted(np.sort(values), v, "right")
            assert (upto == true).all() and upto[-1] == len(values)
            between = np.searchsorted(np.sort(values), values, "right") - np.r_[0, upto][np.searchsorted(v, values, "right")]
            assert 0 <= between.min() and between.max() <= left
    columns = [rng.normal(size=3000), rng.integers(0, 9, 3000).astype(float), np.full(3000, np.inf), np.full(3000, np.nan)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*columns)], "a double, b double, c double, d double").repartition(4)
    numbers = ME._numbers(df, df.columns)
    brackets, sizes = ME._brackets(numbers, 4, chunk_rows=200, most=16)
    assert sizes == {0: 3000, 1: 3000, 2: 3000}
    for c, (lo, hi) in brackets.items():
        middle = np.sort(columns[c])[[1499, 1500]]
        assert lo <= middle[0] and middle[1] <= hi
    lo, hi = brackets[0]
    assert ((columns[0] >= lo) & (columns[0] <= hi)).sum() < 3000 * 4 / 16      # a narrow part is read again
    monkeypatch.setattr(ME, "CHUNK_ROWS", 100)
    monkeypatch.setattr(ME, "CHUNK_POINTS", 5)
    got = {r["c"]: r["median"] for r in ME.exact_medians(df, df.columns).collect()}
    assert got == {c: float(np.median(columns[c])) for c in range(3)}


def test_no_task_merges_the_points_of_all_columns(spark, monkeypatch):
    sizes = []
    plain = type(spark.range(0)).collect
    monkeypatch.setattr(type(spark.range(0)), "first", lambda self: pytest.fail("one row of all columns"))
    monkeypatch.setattr(type(spark.range(0)), "collect", lambda self: sizes.append(len(out := plain(self))) or out)
    df = spark.range(60).select(*[(F.col("id") * i).cast("double").alias(f"x{i}") for i in range(5)])
    ME._brackets(ME._numbers(df, df.columns), 5)
    assert sizes == [5]                                # a row per column, each column's points ranked by itself


# ------------------------------------------------------------------ encoding
def plain_codes(train, rows):
    out = []
    for r in rows:
        line = []
        for c in range(len(r)):
            seen = sorted({t[c] for t in train if t[c] is not None})
            counts = {v: sum(t[c] == v for t in train) for v in seen}
            mode = min(seen, key=lambda v: (-counts[v], v))
            v = mode if r[c] is None else r[c]
            line.append(float(seen.index(v)) if v in seen else -1.0)
        out.append(tuple(line))
    return sorted(out)


def test_hot_and_cold_values_of_several_columns(spark, capsys):
    rng = random.Random(7)
    value = lambda n: rng.choice(["hot"] * n + [None, 'quo"te', "é,", *(f"v{k}" for k in range(3 * n))])
    train = [(value(120), value(1), rng.choice("ab"), f"u{i}") for i in range(600)]
    rows = [(value(120), value(1), rng.choice("abz"), rng.choice([f"u{i}" for i in range(900)])) for _ in range(300)]
    kind = "a string, b string, c string, d string"
    enc = P.LeadEncoder(["a", "b", "c", "d"], []).fit(spark.createDataFrame(train, kind))
    assert "hot" in enc.hot["a"] and "d" not in enc.hot and set(enc.hot["c"]) == {"a", "b"} and not enc.all_hot
    df = enc.encoded(spark.createDataFrame(rows, kind), [])
    assert sorted(tuple(r) for r in df.collect()) == plain_codes(train, rows)
    again = P.LeadEncoderModel.from_json(enc.to_json(), enc.codes)
    assert sorted(tuple(r) for r in again.encoded(spark.createDataFrame(rows, kind), []).collect()) == plain_codes(train, rows)


def test_only_hot_values_need_no_exchange(spark, capsys):
    train = [(c, d) for c in "abc" for d in ("x", None)] * 5
    enc = P.LeadEncoder(["c", "d"], []).fit(spark.createDataFrame(train, "c string, d string"))
    out = enc.encoded(spark.createDataFrame([("b", None), ("q", "x"), (None, "y")], "c string, d string"), [])
    out.explain()
    assert enc.all_hot and "Exchange" not in capsys.readouterr().out
    assert sorted(tuple(r) for r in out.collect()) == [(-1.0, 0.0), (0.0, -1.0), (1.0, 0.0)]


def test_one_melted_join_whatever_the_columns(spark, capsys):
    train = [tuple(f"{c}{i}" for c in "abcd") for i in range(500)]
    enc = P.LeadEncoder(list("abcd"), []).fit(spark.createDataFrame(train, ", ".join(f"{c} string" for c in "abcd")))
    out = enc.encoded(spark.createDataFrame(train, ", ".join(f"{c} string" for c in "abcd")), [])
    out.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[0]
    assert plan.count("Join") == 2                     # values to codes, codes to rows
    assert sorted(tuple(r) for r in out.collect()) == plain_codes(train, train)
