"""Raw inputs: listing batches, nested ancestor documents and page corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.rows import stack_rows
from ..session import settle


def listing_feed(raw: DataFrame, column: str = "body") -> DataFrame:
    """One row per animal of listing batches: the batch's JSON text holds an `animals` array.

    The animals stay JSON text, so a key that only some of them carry is not lost.
    """
    animals = F.from_json(F.get_json_object(column, "$.animals"), "array<string>")
    kept = [c for c in raw.columns if c != column]
    return raw.select(*kept, F.posexplode(animals).alias("position", "animal"))


def nested_ancestor_docs(docs: DataFrame, column: str = "body", depth: int | None = None) -> DataFrame:
    """Documents with nested `dam` and `sire` documents, flattened to (root, path, animal).

    Levels are taken off one by one, without a shuffle, until a level is empty or `depth` levels are read.
    `animal` is the JSON text of that ancestor's document.
    """
    level = docs.select("root", F.lit("").alias("path"), F.get_json_object(column, "$").alias("animal")).filter("animal is not null")
    levels = [level]
    while depth is None or len(levels) < depth:
        parents = [(F.lit(letter), F.get_json_object("animal", f"$.{name}")) for letter, name in (("S", "sire"), ("D", "dam"))]
        up = level.select("root", "path", stack_rows(["letter", "parent"], *parents)).filter("parent is not null")
        level = settle(up.select("root", F.concat("path", "letter").alias("path"), F.col("parent").alias("animal")))
        if level.isEmpty():
            break
        levels.append(level)
    return reduce(DataFrame.unionByName, levels)


def raw_pages(spark: SparkSession, path: str, schema: str = "page_id bigint, url string, html string") -> DataFrame:
    """A stored page corpus as (page_id, url, html)."""
    return spark.read.schema(schema).parquet(path)


def raw_page_files(spark: SparkSession, path: str) -> DataFrame:
    """A folder of page files as (url, html), one row per file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("html"))
