"""The registered queries of these operators: whole tables, production parameters, digest columns."""

from __future__ import annotations

import os
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settle
from . import bagminhash, conversation_sql, dimscan, lengths, packing, passages, prefixtrie, secrets, sketch, suffix, toxicity, turnrepair, warc, winnow

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
CAPACITY, END_ID = 1024, 2
TOXIC_FROM = 0.7
# Bounds on what moves to a Python worker at once; a longer text is a batch of its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def on_workers(spark: SparkSession) -> None:
    """Bound the batches of Python workers, and let those on this machine import the package where it is not installed."""
    for setting, bound in BATCHES.items():
        spark.conf.set(setting, bound)
    place, held = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if place not in held.get("PYTHONPATH", "").split(os.pathsep):
        held["PYTHONPATH"] = os.pathsep.join(x for x in (place, held.get("PYTHONPATH")) if x)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"), use=~held_out())
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.digest_columns(*suffix.without_repeats(_table(spark, folder, "documents")))


def op3_warc_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_round(_table(spark, folder, "pages"), min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lengths.limits(settle(lengths.histogram(lengths.encoded_lengths(_table(spark, folder, "documents"), RANKS, PATTERN))))


def op5_near_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.near_passages(_table(spark, folder, "documents"))


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.digest_columns(secrets.scan(_table(spark, folder, "documents"), RANKS, PATTERN))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = settle(packing.cut_pieces(_table(spark, folder, "documents"), RANKS, PATTERN, CAPACITY, END_ID))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(digests, CAPACITY)


def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return winnow.digest_columns(winnow.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")))


def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.edited_likeness(_table(spark, folder, "documents"))


def op10_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, folder, "documents"))


def op11_adaptive_scan(spark: SparkSession, folder: str) -> DataFrame:
    return dimscan.search(_table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def trie_heads():
    """Whose first turns a conversation takes over, and how many."""
    return F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = settle(prefixtrie.turn_digests(_table(spark, folder, "conversations")))
    return prefixtrie.trie(prefixtrie.with_shared_heads(turns, *trie_heads(), most=3))


def damage():
    """The number that decides how a turn is damaged."""
    def written(column):
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))
    return F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20


def op13_structure_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turnrepair.repaired(turnrepair.damaged(_table(spark, folder, "conversations"), damage()))


QUERIES = {run.__name__: run for run in [op1_toxicity, op2_suffix_dedup, op3_warc_revisits, op4_token_counts, op5_near_passages, op6_secret_scan, op7_packing, op8_decontamination, op9_fingerprints, op10_near_duplicates, op11_adaptive_scan, op12_prefix_trie, op13_structure_repair]}
ORACLES: dict[str, str] = {"op12_prefix_trie": conversation_sql.TRIE, "op13_structure_repair": conversation_sql.REPAIR}
