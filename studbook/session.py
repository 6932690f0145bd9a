"""Session settings and the durable scratch area shared by every executor."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# State of streams on disk, with logs of changes instead of whole snapshots after each batch.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
SETTINGS = {
    **STATE_STORE,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Deep pages fall back to a distributed sort instead of a heap of offset + limit rows.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "studbook", **extra: str) -> SparkSession:
    """A session with the settings above; `extra` uses `__` for dots in setting names."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a single machine."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not configured:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        configured = tempfile.mkdtemp(prefix="studbook-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(configured)
    return configured


def new_folder(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


def at_least_cores(spark: SparkSession) -> int:
    """Partitions for rows that are few bytes and much work, which sizes alone would leave in a few tasks."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def unsent(df: DataFrame) -> DataFrame:
    """The rows for a join that shuffles them: a table that grows with the input is not collected by the driver to be broadcast.

    Written tables are packed, so their size on disk can pass for small where their rows are not.
    """
    return df.hint("merge")


# Shuffle files go when the query that made them ends, not when the driver happens to collect garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, lean: bool = False) -> DataFrame:
    """Write the rows below the shared folder and go on from the written table.

    A lost executor then replays only the rounds after the write, and later joins see the true size
    when they choose between broadcasting and shuffling. With `lean` the shuffle files of the write are removed when it ends.
    """
    spark = df.sparkSession
    path = new_folder(spark, "settled")
    held = spark.conf.get(SHUFFLE_CLEANUP, None)
    if lean:
        spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if lean:
            spark.conf.unset(SHUFFLE_CLEANUP) if held is None else spark.conf.set(SHUFFLE_CLEANUP, held)
    return spark.read.schema(df.schema).parquet(path)
