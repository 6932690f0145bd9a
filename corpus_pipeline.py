"""A corpus from raw documents to packed sequences: each stage reads what the one before has written.

Toxic documents go, of near copies one stays, benchmark items are kept out, secrets are replaced, and what is left is packed
into token sequences. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from studbook.llm import bagminhash, packing, secrets, toxicity, winnow
from studbook.llm.queries import CAPACITY, END_ID, PATTERN, RANKS, TOXIC_FROM, held_out, on_workers
from studbook.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the bound. The model is fitted on labelled rows of this stage's input."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), use=~held_out())
    return toxicity.with_score(docs.select(*COLUMNS), model, "toxic_score").where(F.col("toxic_score") < TOXIC_FROM).select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the smallest doc_id of each class of near copies (one of them where several rows have it)."""
    docs = docs.select(*COLUMNS)
    found = bagminhash.near_duplicates(docs)
    kept = settle(found.where(F.col("doc_id") == F.col("class_id")).select("doc_id").distinct())
    with_id = docs.join(kept, "doc_id", "left_semi")
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    # Ids should be unique; where they aren't, equal ids with different texts keep the least text.
    single = with_id.join(twice, "doc_id", "left_anti")
    several = with_id.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row")).select("doc_id", "row.*")
    return single.unionByName(several).unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return winnow.without_hits(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with each secret replaced by a mark; n_chars follows the text."""
    clean = secrets.redacted(docs.select(*COLUMNS), RANKS, PATTERN)
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    pieces = settle(packing.cut_pieces(docs, RANKS, PATTERN, CAPACITY, END_ID))
    return packing.place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), CAPACITY)


def _ready(stage):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        on_workers(spark)
        return stage(spark, docs, sf_dir)
    return run_stage


STAGES = [(name, _ready(stage)) for name, stage in [
    ("toxicity", drop_toxic), ("near_duplicates", keep_one_of_near_copies), ("decontamination", drop_contaminated), ("secrets", replace_secrets), ("packing", pack)]]
# The classifier, the signatures and the token ids can't be written in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
