"""Tables stored by buckets of their key, so that a batch reads and writes the buckets it touches.

A row lies in the partition of the hash of its key columns. A batch is reduced to the buckets it hits (numbers, at most as
many as there are buckets), those partitions are read, the new rows are written beside the table and then put in place with a
dynamic partition overwrite. Should the job end in between, some buckets are new and some old; the same batch, given again,
leads to the same table. The highest id is kept in a table of one row, so giving out ids reads nothing else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import settle

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketedTable:
    """`buckets` should leave a bucket some hundred megabytes; it is fixed for a table."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    buckets: int = 256
    id_column: str = "id"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _put(self, rows: DataFrame) -> None:
        """Rows are dealt by bucket; Spark splits a bucket that one key has filled over several tasks and files."""
        rows.hint("rebalance", F.col(BUCKET)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{self.root}/rows")

    def create(self, table: DataFrame) -> None:
        self._put(table.select("*", self._bucket()))
        self._set_top(table)

    def _set_top(self, table: DataFrame) -> None:
        settle(table.agg(F.coalesce(F.max(self.id_column), F.lit(0)).cast("bigint").alias(self.id_column))).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/top")

    def _stored(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rows")

    def read(self) -> DataFrame:
        return self._stored().drop(BUCKET)

    def top(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/top")

    def hit(self, batch: DataFrame) -> DataFrame:
        """The rows of the buckets that hold keys of the batch; other partitions are not read."""
        numbers = [r[0] for r in batch.select(self._bucket()).distinct().collect()]
        return self._stored().where(F.col(BUCKET).isin(numbers)) if numbers else self._stored().limit(0)

    def apply(self, batch: DataFrame, upsert: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
        """Put `upsert(rows, batch, top)` in the place of the rows it was given; rows must keep their keys."""
        held, top = self.hit(batch).drop(BUCKET), settle(self.top())
        new = settle(upsert(held, batch, top).select("*", self._bucket()))
        if new.isEmpty():
            return
        self._put(new)
        self._set_top(new.select(self.id_column).unionByName(top))
