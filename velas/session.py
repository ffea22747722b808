"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on: UTC so dates never shift, ANSI kept on (all
# ratios go through try_divide), AQE for runtime coalescing / skew splitting /
# broadcast conversion based on measured sizes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "velas", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the engine's defaults.

    On a cluster the master and sizes come from spark-submit; the local
    defaults here are for tests and the bench.
    """
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if master is not None and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("VELAS_DRIVER_MEMORY", "16g")
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster sets it; only in local mode (tests, local bench) and only
    when it is unset do we create a private scratch folder.  On a cluster an
    unset value is an error: a machine-local folder would not survive the
    loss of an executor.  Lineage is cut with ``checkpoint()`` or written
    tables under this folder, never with local checkpoints.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS/S3)")
        path = tempfile.mkdtemp(prefix="velas-ckpt-", dir=os.environ.get("VELAS_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df):
    """Cut lineage: write ``df`` to the shared checkpoint folder and continue
    from the written copy (reliable checkpoint; survives executor loss).

    The rows are persisted only while the checkpoint is written, so the plan
    runs once (a bare checkpoint computes it twice: for the action and for
    the write).  The checkpoint keeps the output partitioning, so later
    operators on the same keys do not shuffle again."""
    from pyspark import StorageLevel
    checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return held.checkpoint(eager=True)
    finally:
        held.unpersist()
