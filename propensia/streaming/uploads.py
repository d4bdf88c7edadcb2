"""Upload scoring as a Structured Streaming job (lifecycle C, continuous).

The application's "new data upload" page validates one uploaded CSV and, if
it passes, scores it.  Here a folder is the upload inbox: the stream only
discovers files (``maxFilesPerTrigger=1``, so one micro-batch is one upload, as
on the page), and ``foreachBatch`` reads each file by its own header, so columns
may come in any order and a missing one is seen as missing.  It

* validates the upload without a target (the same one-scan rule set),
* writes the validation messages of a rejected upload to ``rejected/``,
* or scores it and writes the tiered sheet to ``scored/``.

Outputs are written under ``batch_id=N`` with overwrite; the last thing a batch
writes is its row of the outcome ledger, one committed table write.  So

* a batch that was lost before its ledger row is done again over its own
  partial files, and one that was lost behind it is not done twice;
* an upload whose content the ledger already has under another batch is
  entered as ``replayed`` and not scored again, whatever its name is now.

An upload's identity is a sum over its lines (order does not matter), computed
where the lines are read, so files of any size have one.  No watermark: each
upload is independent, as in the application.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.validate import validate
from ..plans.training import Artifacts, score_batch
from ..sources.files import normalise, read_csv_raw, write_csv

LEDGER = "identity string, path string, outcome string, rows long, messages array<string>"

#: Bytes of an upload that one task parses and checks; every number of a line goes through the number grammar.
RANGE_BYTES = 4 << 20

Scorer = Callable[[DataFrame], DataFrame]


def upload_identity(spark: SparkSession, path: str) -> str:
    """What the content of a file is known by: line count, and two sums of line hashes."""
    total = lambda seed: F.coalesce(F.sum(F.xxhash64(F.lit(seed), "value").cast("decimal(38,0)")), F.lit(0)).cast("string")
    row = spark.read.text(path, lineSep="\n").agg(F.count(F.lit(1)).cast("string").alias("n"), total(1).alias("a"), total(2).alias("b")).first()
    return f"{row['n']}:{row['a']}:{row['b']}"


def read_ledger(spark: SparkSession, out_dir: str) -> DataFrame:
    """(identity, path, outcome, rows, messages, batch_id) of every upload so far."""
    return spark.read.schema(f"{LEDGER}, batch_id long").parquet(f"{out_dir}/ledger")


def process_upload(spark: SparkSession, path: str, batch_id: int, required: list[str], scorer: Scorer, out_dir: str) -> str:
    """Validate one uploaded file; write its scored sheet or its rejection messages, then its ledger row."""
    identity = upload_identity(spark, path)
    known = read_ledger(spark, out_dir).where((F.col("identity") == identity) | (F.col("batch_id") == batch_id)).collect()
    mine = [r["outcome"] for r in known if r["batch_id"] == batch_id]
    if mine:                                  # the batch was committed before it was lost
        return mine[0]
    rows, messages = 0, []
    if any(r["outcome"] != "replayed" for r in known):
        outcome = "replayed"
    else:
        raw = read_csv_raw(spark, path, range_bytes=RANGE_BYTES).persist()
        try:
            rows = raw.count()
            messages = validate(raw, required, require_target=False).errors
            if messages:
                outcome = "rejected"
                msgs = spark.createDataFrame([(int(batch_id), m) for m in messages], "batch_id long, message string")
                msgs.write.mode("overwrite").json(f"{out_dir}/rejected/batch_id={batch_id}")
            else:
                outcome = "scored"
                write_csv(scorer(normalise(raw)), f"{out_dir}/scored/batch_id={batch_id}")
        finally:
            raw.unpersist()
    spark.createDataFrame([(identity, path, outcome, rows, messages)], LEDGER).coalesce(1).write.mode("overwrite").parquet(
        f"{out_dir}/ledger/batch_id={batch_id}")
    return outcome


def start(spark: SparkSession, inbox: str, out_dir: str, checkpoint: str, art: Artifacts,
          available_now: bool = True):
    """Start the stream that scores uploads with a trained model."""
    required = [S.ID_COLUMN, *art.config.get("raw_feature_columns", [])]
    return start_with(spark, inbox, out_dir, checkpoint, required, lambda df: score_batch(spark, df, art), available_now)


def start_with(spark: SparkSession, inbox: str, out_dir: str, checkpoint: str, required: list[str], scorer: Scorer,
               available_now: bool = True):
    """Start the stream; ``available_now`` processes what is there and stops."""
    spark.createDataFrame([], LEDGER).write.mode("ignore").parquet(f"{out_dir}/ledger/batch_id=-1")
    stream = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", 1)
        .option("pathGlobFilter", "*.csv")
        .load(inbox)
        .select("path")
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        for row in batch.collect():            # one path per micro-batch
            process_upload(batch.sparkSession, row["path"], batch_id, required, scorer, out_dir)

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
