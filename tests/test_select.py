"""Selection without a sort, and the split expression built on it, against sorted lists."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from propensia.operators import split as SP
from propensia.operators.select import at_most, kth_keys

KIND = "y int, h string, i string"


def rows_of(n, digits=32, groups=(0, 1, None), seed=0):
    rng = random.Random(seed)
    return [(rng.choice(groups), "".join(rng.choice("0123456789abcdef") for _ in range(digits)), str(k)) for k in range(n)]


def in_order(rows, g):
    return sorted(((h, i) for y, h, i in rows if y == g), key=lambda x: (x[0], x[1] is not None, x[1] or ""))


@pytest.mark.parametrize("few", [1, 5, 1024])
def test_kth_keys_equal_a_sort(spark, few):
    rows = rows_of(400) + [(0, "abc" + r[1][3:], "p" + r[2]) for r in rows_of(200, seed=1)]     # a crowded prefix
    df = spark.createDataFrame(rows, KIND)
    ranks = {g: [0, 1, 2, len(in_order(rows, g)) // 2, len(in_order(rows, g)), 10_000] for g in (0, 1, None)}
    got = kth_keys(df, "y", "h", "i", ranks, few=few)
    for g, ks in ranks.items():
        want = in_order(rows, g)
        for k in ks:
            assert got.get((g, k)) == (want[k - 1] if 0 < k <= len(want) else None)


def test_equal_and_missing_keys(spark):
    rows = [(0, "", None)] * 40 + [(0, "f" * 32, "same")] * 60 + rows_of(10, groups=(0,))
    df = spark.createDataFrame(rows, KIND)
    got = kth_keys(df, "y", "h", "i", {0: [20, 90]}, few=8)
    assert got == {(0, 20): ("", None), (0, 90): ("f" * 32, "same")}
    for key, want in ((got[0, 20], 40), (got[0, 90], 110), (None, 0)):
        assert df.where(at_most(F.col("h"), F.col("i"), key)).count() == want


def test_split_expression_equals_ranks(spark, capsys):
    rng = random.Random(4)
    rows = [(str(i), rng.choice([0, 0, 0, 1])) for i in range(1500)]
    df = spark.createDataFrame(rows, "student_id string, purchased_paid_course int")
    tagged = SP.with_split(df)
    tagged.explain()
    assert "Exchange" not in capsys.readouterr().out
    got = {r[0]: r["split"] for r in tagged.collect()}
    folds = {r["student_id"]: r["fold"] for r in SP.split_table(df).collect()}
    for y in (0, 1):
        ids = sorted((hashlib.md5(f"42|split|{i}".encode()).hexdigest(), i) for i, c in rows if c == y)
        hold = int(0.15 * len(ids) + 0.5)
        cal = hold + int(0.18 * (len(ids) - hold) + 0.5)
        for k, (_, i) in enumerate(ids):
            assert got[i] == ("holdout" if k < hold else "calibration" if k < cal else "train")
            assert folds[i] == ((k - cal) % 3 if k >= cal else None)
    assert {r["fold"] for r in SP.split_table(df, folds=None).collect()} == {None}


def test_tiny_and_empty_classes(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "student_id string, purchased_paid_course int")
    assert {r["split"] for r in SP.with_split(df).collect()} == {"train"}
    assert SP.with_split(df.limit(0)).count() == 0 and SP.split_table(df.limit(0)).count() == 0
