"""An upload of a few megabytes is parsed and checked by several tasks."""

import tempfile

from pyspark.sql import functions as F

from propensia.streaming import uploads as U


def test_a_middling_upload_is_read_by_several_tasks(spark, monkeypatch):
    base, tasks, real = tempfile.mkdtemp(prefix="ranges-", dir="/tmp"), [], U.read_csv_raw

    def spy(*args, **kwargs):
        raw = real(*args, **kwargs)
        tasks.append(raw.select(F.spark_partition_id().alias("p")).distinct().count())
        return raw

    monkeypatch.setattr(U, "read_csv_raw", spy)
    spark.createDataFrame([], U.LEDGER).write.parquet(f"{base}/ledger/batch_id=-1")
    with open(f"{base}/up.csv", "w") as f:
        f.write("student_id,session_depth\n" + "".join(f"student-{i:060d},{i % 7}\n" for i in range(140_000)))      # 10 MB
    outcome = U.process_upload(spark, f"{base}/up.csv", 0, ["student_id", "session_depth"], lambda df: df, base)
    assert outcome == "scored" and tasks[0] >= 3                 # 1 before
    row = U.read_ledger(spark, base).where("batch_id = 0").first()
    assert row["rows"] == 140_000
