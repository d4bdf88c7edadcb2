"""The upload ledger: replayed files, lost batches, good and bad uploads."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from propensia.streaming import uploads as U

REQUIRED = ["student_id", "session_depth"]


def scorer(df):
    return df.select("student_id", (F.col("session_depth") * 2).alias("twice"))


@pytest.fixture
def place():
    base = tempfile.mkdtemp(prefix="ledger-", dir="/tmp")
    os.makedirs(f"{base}/inbox")
    return base


def put(base, name, text):
    path = f"{base}/inbox/{name}.csv"
    with open(path, "w") as f:
        f.write(text)
    time.sleep(1.1)                      # the stream goes by modification time
    return path


def run(spark, base):
    U.start_with(spark, f"{base}/inbox", f"{base}/out", f"{base}/offsets", REQUIRED, scorer).awaitTermination(200)
    return {os.path.basename(r["path"])[:-4]: (r["outcome"], r["rows"]) for r in U.read_ledger(spark, f"{base}/out").collect()}


def test_outcomes_of_good_bad_and_replayed_files(spark, place):
    put(place, "good", "student_id,session_depth\na,1\nb,2\n")
    put(place, "again", "student_id,session_depth\nb,2\na,1\n")           # the same lines in another order
    put(place, "negative", "student_id,session_depth\nc,-1\n")
    put(place, "missing", "student_id\nd\n")
    want = {"good": ("scored", 2), "again": ("replayed", 0), "negative": ("rejected", 1), "missing": ("rejected", 1)}
    assert run(spark, place) == want
    put(place, "later", "student_id,session_depth\na,1\nb,2\n")           # a later run of the stream knows it, too
    put(place, "bad_again", "student_id,session_depth\nc,-1\n")
    assert run(spark, place) == {**want, "later": ("replayed", 0), "bad_again": ("replayed", 0)}
    sheets = spark.read.option("header", True).csv(f"{place}/out/scored")
    assert sorted((r["student_id"], r["twice"]) for r in sheets.collect()) == [("a", "2.0"), ("b", "4.0")]


def test_a_lost_batch_is_done_once(spark, place):
    path = put(place, "x", "student_id,session_depth\na,1\n")
    out, calls = f"{place}/out", []
    spark.createDataFrame([], U.LEDGER).write.mode("ignore").parquet(f"{out}/ledger/batch_id=-1")

    def dies(df):
        calls.append("dies")
        df.write.mode("overwrite").csv(f"{out}/scored/batch_id=0")       # part of the output is there
        raise RuntimeError("executor lost")

    def counts(df):
        calls.append("counts")
        return scorer(df)

    with pytest.raises(RuntimeError):
        U.process_upload(spark, path, 0, REQUIRED, dies, out)
    assert U.read_ledger(spark, out).count() == 0
    assert U.process_upload(spark, path, 0, REQUIRED, counts, out) == "scored"
    assert U.process_upload(spark, path, 0, REQUIRED, counts, out) == "scored"        # the batch comes again
    assert U.process_upload(spark, path, 1, REQUIRED, counts, out) == "replayed"
    assert calls == ["dies", "counts"] and U.read_ledger(spark, out).count() == 2
    assert spark.read.option("header", True).csv(f"{out}/scored").count() == 1


def test_identity_goes_by_lines(spark, place):
    a, b, c = (U.upload_identity(spark, put(place, n, t)) for n, t in (("a", "x\ny\n"), ("b", "y\nx"), ("c", "x\ny\ny\n")))
    assert a == b != c
