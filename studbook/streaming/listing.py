"""Listing snapshots that arrive as files.

The latest row of each animal is state of the stream, held in RocksDB and stored with the stream's progress, so a micro-batch
reads and writes the animals it brings, however many batches came before, and a restart goes on from the last one. The
listing is read out of that state. What a batch changed is stored as a folder of its own, named by the batch id, so a
replayed batch rewrites the same folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..session import STATE_STORE

# Numbers are moved into the positive range and padded, so that their texts sort as they do.
SHIFT = 5 * 10**18
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """A stream keeps the settings of its start."""
    held = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in held.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def file_stream(spark: SparkSession, folder: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def _sortable(value: Column) -> Column:
    return F.lpad((value.cast("decimal(20,0)") + F.lit(SHIFT).cast("decimal(20,0)")).cast("string"), 20, "0")


def _order(modified: Column, kind: T.DataType, tie: Column) -> Column:
    """A text that sorts by the modification, null first, then by the tie."""
    number = F.unix_micros(modified.cast("timestamp")) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else modified.cast("bigint")
    return F.concat(F.when(number.isNull(), "0").otherwise(F.concat(F.lit("1"), _sortable(number))), F.lit("/"), _sortable(tie.cast("bigint")))


def _keep_latest(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The animal's row with the highest order, given on if it is later than the one held."""
    held = state.get if state.exists else None
    best = held
    for frame in frames:
        at = frame["sort"].idxmax()
        if best is None or frame["sort"][at] > best[0]:
            best = (frame["sort"][at], frame["body"][at])
    if best != held:
        state.update(best)
        yield pd.DataFrame({"body": [best[1]]})


def stream_listing(listing: DataFrame, root: str, modified: Column, tie: str, key: str = "uuid") -> None:
    """Take in everything that has arrived and stop. Rows without a key are one animal's, as everywhere else."""
    spark = listing.sparkSession
    kind = listing.select(modified.alias("at")).schema["at"].dataType
    rows = listing.select(F.col(key).alias("key"), _order(modified, kind, F.col(tie)).alias("sort"), F.to_json(F.struct(*listing.columns), JSON).alias("body"))
    changed = rows.groupBy("key").applyInPandasWithState(_keep_latest, "body string", "sort string, body string", "update", "NoTimeout")
    typed = changed.select(F.from_json("body", listing.schema, JSON).alias("row")).select("row.*")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id:012d}")

    with _state_in_rocksdb(spark):
        query = typed.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()


def current_listing(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """Latest row per animal, out of the stream's state after its last batch; `schema` is that of the listing."""
    state = spark.read.format("statestore").load(f"{root}/progress")
    return state.select(F.from_json("value.groupState.body", schema, JSON).alias("row")).select("row.*")


def listing_changes(spark: SparkSession, root: str) -> DataFrame:
    """What each batch changed: the listing's columns and the batch's number."""
    return spark.read.parquet(f"{root}/changes")


def upsert_from_listing(registry: DataFrame, latest: DataFrame, columns: list[str], key: str = "uuid") -> DataFrame:
    """Registry rows with the listing's columns laid over them where the animal was listed."""
    new = latest.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    held = {c: F.col(c) if c in registry.columns else F.lit(None) for c in columns}
    joined = registry.join(new, key, "left")
    return joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(held[c]) for c in columns}).drop(
        "_hit", *[f"_new_{c}" for c in columns])


def stream_distinct(listing: DataFrame, root: str, key: str, within: str | None = None, event_time: str | None = None) -> None:
    """Each key once over all batches, appended to `root`/rows.

    Without `within` the seen-set is exact and grows with distinct keys, on disk in RocksDB;
    with it, repeats further apart than the watermark may pass again and the state stays bounded.
    """
    if within:
        seen = listing.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])
    else:
        seen = listing.dropDuplicates([key])
    with _state_in_rocksdb(listing.sparkSession):
        query = seen.writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
