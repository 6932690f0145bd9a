"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are counted by their number of ids; suffix sums over the counted lengths give, for a limit, how many documents
are longer and how many ids are left when every document is cut there. Null text counts as empty (0 ids). Repeated rows
count each time; an empty table gives no rows.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .columns import slices
from .tokens import encoder

BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """One row per document: `n_tokens`, its number of ids under the ranks file at `path`."""
    def measure(batches):
        found = encoder(path, pattern)
        for batch in slices(batches, "text"):
            yield pa.record_batch({"n_tokens": pa.array(found.lengths(batch.column(0)), pa.int64())})
    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(measure, "n_tokens bigint")


def histogram(lengths: DataFrame) -> DataFrame:
    """(n_tokens, documents): how many documents have that many ids."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("documents"))


def limits(counts: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit: the documents of just that length, those longer, the ids of
    all documents, the ids kept and lost when documents are cut at the limit, and the share of documents that fit.

    Sums run within blocks of lengths and over the blocks, so no task holds all lengths.
    """
    placed = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    ids = F.col("documents") * F.col("n_tokens")
    blocks = placed.groupBy("block").agg(F.sum("documents").alias("block_documents"), F.sum(ids).alias("block_ids"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("block_documents").over(above), F.lit(0)).alias("later_documents"), F.coalesce(F.sum("block_ids").over(above), F.lit(0)).alias("later_ids"),
        F.sum("block_documents").over(everything).alias("all_documents"), F.sum("block_ids").over(everything).alias("total_tokens"))
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.join(blocks, "block").select(
        "n_tokens", "documents", "total_tokens", "all_documents",
        (F.col("later_documents") + F.coalesce(F.sum("documents").over(longer), F.lit(0))).alias("documents_longer"),
        (F.col("later_ids") + F.coalesce(F.sum(ids).over(longer), F.lit(0))).alias("longer_ids"))
    lost = F.col("longer_ids") - F.col("documents_longer") * F.col("n_tokens")
    return summed.select(
        "n_tokens", "documents", "documents_longer", "total_tokens", (F.col("total_tokens") - lost).alias("tokens_kept"), lost.alias("tokens_lost"),
        ((F.col("all_documents") - F.col("documents_longer")) / F.col("all_documents")).alias("share_fitting"))


def kept_at(summary: DataFrame, limit: int | Column) -> DataFrame:
    """One row: the ids kept when every document is cut at any limit, also one that no document has as its length."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    return summary.agg(F.coalesce(F.sum(F.col("documents") * F.least(F.col("n_tokens"), limit)), F.lit(0)).alias("tokens_kept"))


def quantile(summary: DataFrame, share: float) -> DataFrame:
    """One row: the smallest length that at least `share` of the documents do not exceed."""
    return summary.where(F.col("share_fitting") >= share).agg(F.min("n_tokens").alias("n_tokens"))
