"""Splits, encoder statistics and CSV ingest."""

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensia.operators.prep import LeadEncoder, category_counts, exact_medians, most_frequent
from propensia.operators.split import assign_splits, select_ids
from propensia.sources.files import read_students_csv


def test_splits_disjoint_exhaustive_stratified(spark):
    rnd = random.Random(0)
    rows = [(f"s{i}", int(rnd.random() < 0.3)) for i in range(1000)]
    df = spark.createDataFrame(rows, "student_id string, purchased_paid_course int")
    out = assign_splits(df, num_partitions=6).collect()
    assert len(out) == 1000 and len({r["student_id"] for r in out}) == 1000
    for label in (0, 1):
        sub = [r for r in out if r["purchased_paid_course"] == label]
        n = len(sub)
        hold = sum(r["split"] == "holdout" for r in sub)
        cal = sum(r["split"] == "calibration" for r in sub)
        assert hold == int(np.floor(n * 0.15 + 0.5))
        assert cal == int(np.floor((n - hold) * 0.18 + 0.5))
        folds = [r["fold"] for r in sub if r["split"] == "train"]
        assert max(folds.count(f) for f in range(3)) - min(folds.count(f) for f in range(3)) <= 1
    assert all((r["fold"] is None) == (r["split"] != "train") for r in out)
    again = {r["student_id"]: r["split"] for r in assign_splits(df, num_partitions=3).collect()}
    assert again == {r["student_id"]: r["split"] for r in out}


def test_select_ids_requires_every_id(spark):
    df = spark.createDataFrame([("1", 0), ("2", 1), ("3", 1)], "student_id string, y int")
    ids = spark.createDataFrame([("3", 0), ("2", 1)], "student_id string, position int")
    assert [r["student_id"] for r in select_ids(df, ids).orderBy("position").collect()] == ["3", "2"]
    with pytest.raises(ValueError):
        select_ids(df, spark.createDataFrame([("9", 0)], "student_id string, position int"))


def test_medians_and_modes(spark):
    rnd = random.Random(3)
    a = [float(rnd.randint(0, 20)) for _ in range(501)]
    b = [float(rnd.random()) for _ in range(500)] + [None]
    rows = list(zip(a, b, [rnd.choice(["x", "y", "z"]) for _ in a], [None] * 501))
    df = spark.createDataFrame(rows, "a double, b double, c string, d double")
    med = {r["c"]: r["median"] for r in exact_medians(df, ["a", "b", "d"]).collect()}
    assert med[0] == float(np.median(a))
    assert med[1] == pytest.approx(float(np.median([x for x in b if x is not None])), abs=0)
    assert 2 not in med  # all-NULL column has no median
    tie = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert most_frequent(category_counts(tie, ["c"])).first()["mode"] == "a"


def test_encoder_unseen_and_null(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", None), ("b", 3.0)], "c string, x double")
    enc = LeadEncoder(["c"], ["x"]).fit(train)
    assert sorted((r["v"], r["code"]) for r in enc.codes.collect()) == [("a", 0.0), ("b", 1.0)]
    assert enc.medians == {"x": 2.0} and enc.modes == {"c": "b"}
    test = spark.createDataFrame([("zz", None), (None, 5.0), ("a", 1.0)], "c string, x double")
    vecs = sorted(r["features"].toArray().tolist() for r in enc.transform(test).collect())
    assert vecs == [[-1.0, 2.0], [0.0, 1.0], [1.0, 5.0]]
    assert enc.feature_names() == ["cat__c", "num__x"]


def test_csv_ingest_na_tokens(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    path = os.path.join(d, "s.csv")
    with open(path, "w") as f:
        f.write("student_id,session_depth,ai_mentor_topic,coupon_code_applied\n")
        f.write("1,12,none,1\n2,NA,NA,0\n3, 12 ,,\n4,1e3,N/A,1.0\n5,1_000,null,NaN\n")
    df = read_students_csv(spark, path).orderBy("student_id").collect()
    assert [r["session_depth"] for r in df] == [12.0, None, 12.0, 1000.0, None]
    assert [r["ai_mentor_topic"] for r in df] == ["none", None, None, None, None]
    assert [r["coupon_code_applied"] for r in df] == [1, 0, None, 1, None]


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [7.0] * 9, [1.0] * 500 + [2.0] * 501, [1.0] * 500 + [2.0] * 500,
                                    [float(i * i % 9973) for i in range(6000)], [0.1 * i for i in range(4001)] + [float("nan")]])
def test_medians_are_exact_on_any_shape(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "a double").repartition(3)
    got = exact_medians(df, ["a"]).first()["median"]
    assert got == float(np.median([v for v in values if v == v]))


def test_encoder_takes_any_number_of_values(spark):
    n = 120_000
    df = spark.range(n).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("c"))
    enc = LeadEncoder(["c"], []).fit(df)
    out = enc.encoded(df.unionByName(spark.createDataFrame([("new",), (None,)], "c string")), [])
    row = out.agg(F.min("cat__c").alias("lo"), F.max("cat__c").alias("hi"), F.count_distinct("cat__c").alias("n")).first()
    assert (row["lo"], row["hi"], row["n"]) == (-1.0, n - 1.0, n + 1)


def test_csv_quotes_line_breaks_and_ragged_lines(spark):
    from propensia.operators.validate import validation_report
    from propensia.sources.files import BAD_LINE, read_csv_raw

    path = os.path.join(tempfile.mkdtemp(prefix="csv-", dir="/tmp"), "s.csv")
    with open(path, "w") as f:
        f.write('student_id,ai_mentor_topic,session_depth,target_gate\n1,"a ""b"", c",12d,True\n2,"two\nlines",5,False\n')
        f.write("3,short\n4,too,many,1,fields\n5,x,0x1p3,2\n")
    raw = read_csv_raw(spark, path)
    rows = {r["student_id"]: r for r in raw.collect()}
    assert rows["1"]["ai_mentor_topic"] == 'a "b", c' and rows["2"]["ai_mentor_topic"] == "two\nlines"
    assert [i for i in sorted(rows) if rows[i][BAD_LINE] is not None] == ["3", "4"]
    typed = {r["student_id"]: r for r in read_students_csv(spark, path).collect()}
    assert [typed[i]["target_gate"] for i in "125"] == [1, 0, 2] and typed["1"]["session_depth"] is None
    report = {(r["rule"], r["column"]): r["bad_rows"] for r in validation_report(raw, require_target=False).collect()}
    assert report["S1", BAD_LINE] == 2 and report["V8", "target_gate"] == 1 and report["V16", "session_depth"] >= 2
