"""Threshold-scaled sketches of documents: every shingle hash below a fixed fraction of the range is retained.

A sketch grows with its document, so two sketches compare documents of very unequal size: the share of the smaller sketch
that the larger one holds estimates containment. Sketches of parts merge by union. A text whose hashes all lie above the
threshold keeps its least one, so only a text without words has an empty sketch. Built-in functions only.

Shingles are five words (all words of a shorter text). Null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SHINGLE = 5
FRACTION = 1 / 8
BINS = 1 << 16
RUN_BYTES = 16 << 20


def _let(value: Column, body) -> Column:
    """`body` applied to `value`, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sketch(text: Column, size: int = SHINGLE, fraction: float = FRACTION) -> Column:
    """The retained hashes, ascending and distinct."""
    limit = int(fraction * 2**64) - 2**63
    words = F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda word: word != "")

    def hashes(found: Column) -> Column:
        places = F.when(F.size(found) > 0, F.sequence(F.lit(1), F.greatest(F.size(found) - (size - 1), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.xxhash64(F.slice(found, at, size)))

    def retained(all_hashes: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(all_hashes, lambda h: h < F.lit(limit))))
        return F.when((F.size(low) > 0) | (F.size(all_hashes) == 0), low).otherwise(F.array(F.array_min(all_hashes)))
    return _let(_let(words, hashes), retained)


def merged(left: Column, right: Column) -> Column:
    """The sketch of two parts together (shingles across the seam are not in it)."""
    return F.array_sort(F.array_union(left, right))


def likeness(left: Column, right: Column) -> Column:
    """Estimated containment of the smaller document in the larger one, 0 to 1; two empty sketches are alike."""
    least = F.least(F.size(left), F.size(right))
    return F.when(F.greatest(F.size(left), F.size(right)) == 0, 1.0).when(least == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / least)


def written(hashes: Column) -> Column:
    """A sketch as text: hexadecimal hashes with commas between."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), ",")


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Adds next_text and next_sketch of the following row by `key` (after the last: the first); needs a `sketch` column.

    Keys are counted in BINS equal ranges; neighbouring ranges make runs of about RUN_BYTES, and each run also gets the
    first row of the next one. So texts move once and no task sees more than a run. Rows of one key follow each other by
    text, null keys come last.
    """
    bounds = docs.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    low, high = bounds["low"] or 0, bounds["high"] or 0
    step = (high - low) // BINS + 1
    own_bin = F.coalesce(F.floor((F.col(key) - F.lit(low)) / F.lit(step)), F.lit(BINS))
    # At most BINS + 1 rows from here on, whatever the size of the table.
    counted = docs.groupBy(own_bin.alias("bin")).agg(F.sum(F.octet_length(text) + 64).alias("bytes"), F.min(key).alias("first_key"))
    ordered = Window.orderBy("bin")
    counted = counted.withColumn("run", F.floor((F.sum("bytes").over(ordered) - F.col("bytes")) / RUN_BYTES))
    runs = counted.groupBy("run").agg(F.min("bin").alias("bin"))
    everything = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.select("bin", F.coalesce(F.lag("run").over(Window.orderBy("run")), F.max("run").over(everything)).alias("before"))
    bins = counted.join(runs, "bin", "left").select("bin", "run", "first_key", "before")
    placed = docs.withColumn("bin", own_bin).join(F.broadcast(bins), "bin")
    first = F.col("before").isNotNull() & F.col(key).eqNullSafe(F.col("first_key"))
    here = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("guest")))
    both = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("guest")), F.struct(F.col("before").alias("run"), F.lit(True).alias("guest")))
    copied = placed.withColumn("at", F.explode(F.when(first, both).otherwise(here))).select(*docs.columns, F.col("at.run").alias("run"), F.col("at.guest").alias("guest"))
    following = Window.partitionBy("run").orderBy("guest", F.col(key).asc_nulls_last(), text)
    return copied.withColumns({"next_text": F.lead(text).over(following), "next_sketch": F.lead("sketch").over(following)}).where(~F.col("guest")).drop("run", "guest")


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document and of its text with the last half replaced by the beginning of the next document's."""
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", sketch(F.col("text"))), "doc_id", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited_text", edited)
    rows = rows.withColumn("edited_sketch", sketch(F.col("edited_text")))
    return rows.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"), written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"), likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
