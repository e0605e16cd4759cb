"""Session settings the operators rely on, and lineage cutting for iterative jobs."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution splits skewed join partitions at run time; nothing in this package hints a
# broadcast, so a side is only broadcast when Spark has checked its size against the threshold.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app_name: str = "leadloom", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{key.replace("__", "."): value for key, value in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named in ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; on a cluster a missing
    setting is an error, because executors on other machines could not read it back.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can read")
        configured = tempfile.mkdtemp(prefix="leadloom-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python at most a thousand or 4 MB at a time, so a worker's memory does not depend on how many a task has; a session that asks for less keeps it."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        asked = re.match(r"-?\d+", spark.conf.get(name, None) or "0")
        if not (asked and 0 < int(asked[0]) <= most and asked[0] == spark.conf.get(name).rstrip("bB")):
            spark.conf.set(name, str(most))


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so a lost executor never replays earlier rounds."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
