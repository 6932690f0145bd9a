"""Writers: JSON documents and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def json_documents(df: DataFrame, column: str = "document") -> DataFrame:
    """One JSON text per row, nulls kept and dates in ISO form."""
    options = {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    whole: Column = F.to_json(F.struct(*df.columns), options)
    return df.select(*[c for c in ("id",) if c in df.columns], whole.alias(column))


def write_json_documents(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


def publish_snapshot(df: DataFrame, root: str, version: int) -> None:
    """Write a table's new state beside the old ones and name it current.

    The folder being read is never overwritten. A version becomes visible only with its manifest row,
    which is written after the data; a repeated call with the same version rewrites that version alone.
    """
    target = f"{root}/v={version:012d}"
    df.write.mode("overwrite").parquet(target)
    manifest = df.sparkSession.range(1).select(F.lit(version).cast("bigint").alias("version"), F.lit(target).alias("path"))
    manifest.coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def current_version(spark: SparkSession, root: str) -> int:
    """The highest published version. The manifest holds one row per publication."""
    return spark.read.schema("version bigint, path string").parquet(f"{root}/manifest").agg(F.max("version")).first()[0]


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    wanted = current_version(spark, root) if version is None else version
    return spark.read.parquet(f"{root}/v={wanted:012d}")
