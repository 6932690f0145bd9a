"""Benchmark decontamination by winnowing.

Of the hashes of all k-word grams, the least one of each window of width - k + 1 grams is kept on both sides. Two texts that
share `width` words in a row share such a window and therefore a kept hash, so only windows of a document around a kept hash
that some item keeps too can occur in an item. These are looked up among the windows of the items; neighbouring and
overlapping hits extend each other to the shared span. Items shorter than `width` words are windows themselves.

Each place of a document is looked up once, whatever the ties: periodic texts and items cost what others do. A window names the
list of items that hold it, each list is held once, and a document unfolds each of its lists once, so repeated windows and
copies of items don't multiply.

Items are taken in blocks of at most BLOCK_BYTES of text. Each block's fingerprints go to the executors once, so the size
of what is sent is bounded however many items there are; with several blocks their spans are merged by document.
Null text has no words; items without words or without an id are never found; a repeated item id counts once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .columns import grams, mix, ragged, slices, words

GRAM = 5
BLOCK_BYTES = 16 << 20
SPANS = "array<struct<first:int,last:int>>"
FOUND = f"doc_id bigint, n_words bigint, spans {SPANS}, items array<string>"


def kept(hashes: np.ndarray, window: int) -> np.ndarray:
    """Which hashes are the least of some `window` consecutive ones; ties are all kept."""
    least = hashes.copy()
    steps = range(1, min(window, len(hashes)))
    for step in steps:
        np.minimum(least[: len(least) - step], hashes[step:], out=least[: len(least) - step])
    most = least.copy()
    for step in steps:
        np.maximum(most[step:], least[: len(least) - step], out=most[step:])
    return most == hashes


@dataclass
class Windows:
    """Distinct window hashes of one size in order, the list of items of each, and the lists one after the other."""

    hashes: np.ndarray
    lists: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """The items of a block: their ids, their kept fingerprints in order, and their windows by size."""

    item_ids: list[str]
    prints: np.ndarray
    windows: dict[int, Windows]


def _by_window(hashes: np.ndarray, items: np.ndarray) -> Windows:
    order = np.lexsort((items, hashes))
    hashes, items = hashes[order], items[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
    hashes, items = hashes[fresh], items[fresh]
    distinct, first, counts = np.unique(hashes, return_index=True, return_counts=True)
    # Windows held by the same items share one list, told by the sum of the items' scrambled numbers.
    names = np.add.reduceat(mix(items.astype(np.uint64) + np.uint64(1)), first) if len(first) else np.zeros(0, np.uint64)
    _, sample, lists = np.unique(names, return_index=True, return_inverse=True)
    return Windows(distinct, lists, np.concatenate(([0], np.cumsum(counts[sample]))), items[ragged(first[sample], counts[sample])])


def build_index(item_ids: list[str], texts: list[str | None], width: int, gram: int) -> Index:
    found = words(pa.array(texts, pa.large_string()))
    sizes = np.diff(found.first)
    hashes, inside = grams(found, gram)
    owner = found.text_of()
    hashes = np.where(inside, hashes, np.iinfo(np.uint64).max)
    prints = np.unique(hashes[kept(hashes, width - gram + 1) & inside & (sizes[owner] >= width)]) if len(owner) else hashes
    windows = {}
    for size in sorted(set(np.minimum(sizes[sizes > 0], width).tolist())):
        hashes, inside = grams(found, size)
        places = np.flatnonzero(inside & (np.minimum(sizes[owner], width) == size))
        windows[size] = _by_window(hashes[places], owner[places])
    return Index(item_ids, prints, windows)


def _find(ordered: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among ordered distinct ones, -1 where it is none of them."""
    if not len(ordered):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(ordered, keys), len(ordered) - 1)
    return np.where(ordered[at] == keys, at, -1)


def _near_prints(hashes: np.ndarray, inside: np.ndarray, index: Index, width: int, gram: int) -> np.ndarray:
    """Whether the window of `width` words at each place holds a kept gram that an item keeps too."""
    hashes = np.where(inside, hashes, np.iinfo(np.uint64).max)
    places = np.flatnonzero(kept(hashes, width - gram + 1) & inside)
    places = places[_find(index.prints, hashes[places]) >= 0]
    change = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(change, np.maximum(places - (width - gram), 0), 1)
    np.add.at(change, places + 1, -1)
    return np.cumsum(change[:-1]) > 0


def find_spans(column: pa.Array, index: Index, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per text; text, first and last word (within the text) of each window that occurs; and distinct pairs of text and item."""
    found = words(column)
    text_of = found.text_of()
    first, last, pairs = [], [], []
    for size, windows in index.windows.items():
        hashes, inside = grams(found, size)
        spots = np.flatnonzero(inside & _near_prints(*grams(found, gram), index, width, gram) if size == width else inside)
        at = _find(windows.hashes, hashes[spots])
        spots, at = spots[at >= 0], at[at >= 0]
        first.append(spots)
        last.append(spots + size - 1)
        lists = np.unique(np.stack([text_of[spots], windows.lists[at]]), axis=1)
        counts = np.diff(windows.first)[lists[1]]
        pairs.append(np.unique(np.stack([np.repeat(lists[0], counts), windows.items[ragged(windows.first[lists[1]], counts)]]), axis=1))
    none = np.zeros(0, np.int64)
    first, last = np.concatenate([none, *first]), np.concatenate([none, *last])
    pairs = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
    text = text_of[first]
    return np.diff(found.first), text, first - found.first[text], last - found.first[text], pairs[0], pairs[1]


def _nested(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def _blocks(items: DataFrame, item: str, item_text: str, width: int, gram: int):
    """An index for each block of items, each sent to the executors."""
    spark = items.sparkSession
    items = items.select(F.col(item).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, -(-size // BLOCK_BYTES))
    for block in range(count):
        rows = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == block) if count > 1 else items
        rows = sorted({(row["item"], row["text"]) for row in rows.collect()})
        yield spark.sparkContext.broadcast(build_index([r[0] for r in rows], [r[1] for r in rows], width, gram))


def without_hits(docs: DataFrame, items: DataFrame, width: int = 10, gram: int = GRAM, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, in whose text no window of an item occurs."""
    place = docs.columns.index(text)
    # Which item it was doesn't matter, so one without an id counts too.
    items = items.withColumn(item, F.coalesce(F.col(item).cast("string"), F.lit("")))
    for shared in _blocks(items, item, item_text, width, gram):
        docs = docs.mapInArrow(_keeper(shared, place, width, gram), docs.schema)
    return docs


def _keeper(shared, place: int, width: int, gram: int):
    def keep(batches):
        for batch in batches:
            if batch.num_rows:
                clean = np.ones(batch.num_rows, bool)
                clean[find_spans(batch.column(place), shared.value, width, gram)[1]] = False
                yield batch.filter(pa.array(clean))
    return keep


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, gram: int = GRAM, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, the maximal spans of hit words (positions, ends inclusive) and the items found, sorted as strings."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = [_one_block(docs, shared, width, gram) for shared in _blocks(items, item, item_text, width, gram)]
    if len(parts) == 1:
        return parts[0].drop("text_key")
    everything = parts[0]
    for part in parts[1:]:
        everything = everything.unionByName(settle(part.where(F.size("items") > 0)))
    # Rows of equal id and text have equal spans; `copies` brings them back.
    merged = everything.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"), F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    copies = docs.groupBy("doc_id", F.md5("text").alias("text_key")).agg(F.count(F.lit(1)).cast("int").alias("copies"))
    together = copies.alias("c").join(merged.alias("m"), F.col("c.doc_id").eqNullSafe(F.col("m.doc_id")) & F.col("c.text_key").eqNullSafe(F.col("m.text_key")))
    return together.select("c.doc_id", "n_words", _union(F.array_sort("spans")).alias("spans"), "items", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")


def _union(spans):
    """Sorted spans with overlapping and touching ones joined."""
    def last(done):
        return F.element_at(done, -1)

    def add(done, span):
        joined = F.array_append(F.slice(done, 1, F.size(done) - 1), F.named_struct(F.lit("first"), last(done)["first"], F.lit("last"), F.greatest(last(done)["last"], span["last"])))
        return F.when(F.size(done) == 0, F.array(span)).when(last(done)["last"] + 1 >= span["first"], joined).otherwise(F.array_append(done, span))
    return F.aggregate(spans, F.array().cast(SPANS), add)


def _one_block(docs: DataFrame, shared, width: int, gram: int) -> DataFrame:
    def search(batches):
        index = shared.value
        for batch in slices(batches, "text"):
            sizes, text, first, last, held_by, item = find_spans(batch.column(1), index, width, gram)
            count = batch.num_rows
            order = np.lexsort((first, text))
            t, a, b = text[order], first[order], last[order]
            # Spans of one text are joined where they overlap or touch: a text's running end tells where a new one begins.
            shift = t * (int(sizes.max(initial=0)) + 2)
            reach = np.maximum.accumulate(b + shift) if len(b) else b
            fresh = np.ones(len(a), bool)
            fresh[1:] = (a + shift)[1:] > reach[:-1] + 1
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], len(a)) - 1 if len(heads) else heads
            spans = pa.StructArray.from_arrays([pa.array(a[heads], pa.int32()), pa.array((reach - shift)[tails] if len(heads) else heads, pa.int32())], ["first", "last"])
            names = sorted({(x, index.item_ids[y]) for x, y in zip(held_by.tolist(), item.tolist())})
            yield pa.record_batch({
                "doc_id": batch.column(0), "text_key": batch.column(2), "n_words": pa.array(sizes, pa.int64()),
                "spans": _nested(np.bincount(t[heads].astype(int), minlength=count), spans),
                "items": _nested(np.bincount(np.array([x for x, _ in names], int), minlength=count), pa.array([y for _, y in names], pa.string()))})
    return docs.withColumn("text_key", F.md5("text")).mapInArrow(search, FOUND.replace("n_words", "text_key string, n_words", 1))


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts and the digest of the item list instead of spans and items."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, span: total + span["last"] - span["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
