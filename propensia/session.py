"""SparkSession construction and the reliable checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # fits of a model grid run side by side, each in a pool of its own
    "spark.scheduler.mode": "FAIR",
    "spark.ui.showConsoleProgress": "false",
    # Call-site capture costs several py4j round-trips per Column call while
    # plans are built; error messages still name the failing expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Checkpoint files go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Broadcast only tables under 32 MB; every explicit broadcast in the
    # library is on a side with a proven bound (partition offsets, code tables).
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}

#: Bytes of a method above which the JVM never compiles it but interprets it for good.
JIT_METHOD_BYTES = 8_000


def get_session(
    master: str | None = None,
    app_name: str = "propensia",
    shuffle_partitions: int | None = None,
    extra_conf: dict | None = None,
) -> SparkSession:
    """Build (or reuse) a session with AQE on, UI off and UTC time."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package where the driver's checkout is visible to them."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)


def short_methods(spark: SparkSession) -> None:
    """Let Spark generate a wide projection in parts where one method of it would be too long for the JVM to compile.

    Rows of some ninety columns come close to Spark's own limit of 65,535
    bytes; the interpreter then takes about five times as long for each.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key)) > JIT_METHOD_BYTES:
        spark.conf.set(key, str(JIT_METHOD_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it only if unset.

    On a cluster the directory must be the shared folder named by
    ``spark.checkpoint.dir``; it is read from the session.  Only a local
    master (tests, single-node benches) falls back to a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder "
            "(HDFS/S3/ABFS) so checkpoints survive executor loss"
        )
    base = os.environ.get("PROPENSIA_SCRATCH", "/tmp")
    path = tempfile.mkdtemp(prefix="propensia-ckpt-", dir=base)
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A sub-path of the checkpoint folder for written intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    return f"{root.rstrip('/')}/tables/{name}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder and read it back (cuts the lineage)."""
    spark = df.sparkSession
    path = shared_scratch(spark, f"{label}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
