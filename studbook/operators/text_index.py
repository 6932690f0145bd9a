"""Text search over stored grams: which rows hold every gram of a term, and the exact test on those rows only.

The index is a table of (gram, field, id), one row for each three neighbouring characters of each text column, in lower case
and in order of gram and id. A search asks it for a few grams, so sorted files and row groups without them aren't read, and a
gram that every row holds is spread over files by id. Rows that hold the asked grams in one column are tested as
`filter_search_text` tests them, so both give the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import new_folder
from .search import SEARCH_COLUMNS, contains_pattern

GRAM = 3
# Of a long term's grams only the rarest are asked for; what they let through is tested exactly anyway.
ASKED = 8


@dataclass
class TextIndex:
    """Where the grams and their numbers of rows are stored, and the columns they were made of."""

    folder: str
    columns: list[str]

    def grams(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/grams")

    def counts(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/counts")


def _grams_of(text: Column) -> Column:
    # Overlapping grams in one pass, so a text costs what it is long.
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1)))


def build_index(table: DataFrame, columns: list[str] = SEARCH_COLUMNS, folder: str | None = None) -> TextIndex:
    """Store the grams of the given columns that `table` has. Null and shorter texts have none; ids may repeat or be null."""
    present = [c for c in columns if c in table.columns]
    folder = folder or new_folder(table.sparkSession, "grams")
    fields = F.array(*[F.struct(F.lit(place).alias("field"), F.col(c).cast("string").alias("text")) for place, c in enumerate(present)])
    long = table.select("id", F.inline(fields)).select("id", "field", F.explode(_grams_of(F.col("text"))).alias("gram"))
    long.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{folder}/grams")
    index = TextIndex(folder, present)
    index.grams(table.sparkSession).groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{folder}/counts")
    return index


def literal_runs(pattern: str) -> list[str]:
    """The texts between the wildcards of a pattern; a backslash takes the next character as it is."""
    runs, at = [""], 0
    while at < len(pattern):
        if pattern[at] in "%_":
            runs.append("")
        else:
            at += pattern[at] == "\\"
            runs[-1] += pattern[at: at + 1]
        at += 1
    return [run for run in runs if run]


def term_grams(spark: SparkSession, term: str) -> list[str]:
    """The distinct grams that every match of a term holds, lowered by Spark as the texts are."""
    low = spark.range(1).select(F.lower(F.lit(contains_pattern(term)))).first()[0]
    return sorted({run[at: at + GRAM] for run in literal_runs(low) for at in range(len(run) - GRAM + 1)})


def candidates(spark: SparkSession, index: TextIndex, term: str) -> DataFrame | None:
    """Ids of rows that hold the asked grams of a term in one column, each once; None for a term without grams."""
    grams = term_grams(spark, term)
    if not grams:
        return None
    # As many rows as the term has grams at most.
    counted = {r["gram"]: r["rows"] for r in index.counts(spark).where(F.col("gram").isin(grams)).collect()}
    asked = sorted(grams, key=lambda g: (counted.get(g, 0), g))[:ASKED]
    bit = reduce(lambda other, g: F.when(F.col("gram") == g[1], 1 << g[0]).otherwise(other), enumerate(asked), F.lit(0))
    held = index.grams(spark).where(F.col("gram").isin(asked)).groupBy("id", "field").agg(F.bit_or(bit).alias("held"))
    return held.where(F.col("held") == (1 << len(asked)) - 1).select("id").distinct()


def search_text(table: DataFrame, index: TextIndex, term: str | None) -> DataFrame:
    """The rows of `table` that hold the term in one of the index's columns; `index` is made of the same rows.

    No term leaves the table as it is. A term without three neighbouring literal characters is tested on every row.
    """
    if not term:
        return table
    exact = reduce(Column.__or__, [F.col(c).ilike(contains_pattern(term)) for c in index.columns], F.lit(False))
    found = candidates(table.sparkSession, index, term)
    if found is not None:
        asked = found.withColumnRenamed("id", "_asked")
        table = table.join(asked, F.col("id").eqNullSafe(F.col("_asked")), "left_semi")
    return table.where(exact)
