"""Near copies by BagMinHash signatures of weighted word shingles.

A text is the multiset of its five-word shingles. Each shingle has Poisson processes over discretised weights, one for each
doubling [0,1), [1,2), [2,4), ...; a point of a process falls on one component of the signature at a time and at a height,
and counts for every text in which the shingle's weight lies above the height. A component is the earliest point that
counts, so two texts agree in it with the probability of their weighted Jaccard similarity, sum of minima over sum of
maxima. Points come in order of time, so a process is left once it can't undercut the text's latest component; heights thin
the one doubling that a weight ends in, and the doublings below it count whole.

Signatures are cut into bands. Texts that share a band are compared with its most central
text first, the one that shares most bands with others: in a group of copies made from one text nearly all are linked with
it. Linked texts form classes. Texts of bands that still hold several classes are compared across classes wherever they
share one of their rarest shingles, which no pair that is near enough can miss and texts around a common passage rarely
do. Every link is verified on the whole multisets. Copies of a text are one node throughout.

Null text counts as empty. Texts without words are near copies only of equal texts. Rows without an id belong to the class
of their text; a class whose rows have no id at all has a null class id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import settle
from .columns import constants, counted, mix, shingles, slices, words
from .graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 4
_GOLDEN, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def signatures(hashes: np.ndarray, texts: np.ndarray, weights: np.ndarray, count: int, size: int) -> np.ndarray:
    """A row of `size` components for each of `count` texts, from distinct shingles with whole-number weights."""
    best = np.full(count * size, np.inf)
    if not len(hashes):
        return best.reshape(count, size)
    # One row for each doubling that a weight reaches into: its least level and its width.
    doublings = 1 + np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64)
    owner = np.repeat(np.arange(len(hashes)), doublings)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(doublings) - doublings, doublings)
    width = np.where(level == 0, 1.0, 2.0 ** (level - 1))
    low = np.where(level == 0, 0.0, width)
    seed = mix(hashes[owner] + level.astype(np.uint64) * constants(1, 11)[0])
    text, over, time = texts[owner], weights[owner], np.zeros(len(owner))
    step = 0
    while len(seed):
        step += 1
        drawn = mix(seed + np.uint64(step * _GOLDEN & _MASK))
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (width * size)
        drawn = mix(drawn ^ np.uint64(0xD1B54A32D192ED03))
        height = low + np.floor((drawn >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width)
        counts = height < over
        np.minimum.at(best, text[counts] * size + (drawn[counts] & np.uint64(0xFFFFFFFF)).astype(np.int64) % size, time[counts])
        latest = best.reshape(count, size).max(axis=1)
        live = time < latest[text]
        seed, text, over, time, width, low = seed[live], text[live], over[live], time[live], width[live], low[live]
    return best.reshape(count, size)


def bands_of(signature: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each band of each row."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    return mix((bits * constants(ROWS, 12)).sum(axis=2) + constants(BANDS, 13)).view(np.int64)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values, pa.int64()))


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, items, bands): the size of each multiset and the band keys, none for a text without words."""
    def sign(batches):
        for batch in slices(batches, "text"):
            hashes, texts, fresh, _ = counted(*shingles(words(batch.column(2)), SHINGLE))
            heads = np.flatnonzero(fresh)
            weights = np.diff(np.append(heads, len(hashes)))
            keys = bands_of(signatures(hashes[heads], texts[heads], weights, batch.num_rows, BANDS * ROWS))
            items = np.bincount(texts, minlength=batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column(0), "node": batch.column(1), "items": pa.array(items, pa.int64()), "bands": _lists(keys[items > 0].ravel(), np.where(items > 0, BANDS, 0))})
    return docs.select("doc_id", "node", "text").mapInArrow(sign, "doc_id bigint, node binary, items bigint, bands array<bigint>")


def multisets(rows: DataFrame) -> DataFrame:
    """(node, members): the multiset of each text as a set, equal shingles told apart by their place among them."""
    def expand(batches):
        for batch in slices(batches, "text"):
            hashes, texts, _, place = counted(*shingles(words(batch.column(1)), SHINGLE))
            members = mix(hashes + place.astype(np.uint64) * constants(1, 14)[0]).view(np.int64)
            yield pa.record_batch({"node": batch.column(0), "members": _lists(members, np.bincount(texts, minlength=batch.num_rows))})
    return rows.select("node", "text").mapInArrow(expand, "node binary, members array<bigint>")


def verified(pairs: DataFrame, sizes: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    for side in "ab":
        pairs = pairs.join(sizes.select(F.col("node").alias(side), F.col("items").alias(f"items_{side}")), side)
    pairs = settle(pairs.where(F.least("items_a", "items_b") >= similarity * F.greatest("items_a", "items_b")).select("a", "b"))
    for side in "ab":
        pairs = pairs.join(members.select(F.col("node").alias(side), F.col("members").alias(f"members_{side}")), side)
    shared = F.size(F.array_intersect("members_a", "members_b"))
    return pairs.where(shared >= similarity * (F.size("members_a") + F.size("members_b") - shared)).select("a", "b")


def _against_center(shared: DataFrame, central: DataFrame) -> DataFrame:
    """Pairs of each band's texts with the most central of them."""
    rows = settle(shared.join(central, "node").select("key", "node", "central"))
    centers = settle(rows.groupBy("key").agg(F.min(F.struct((-F.col("central")).alias("central"), "node")).alias("center")).select("key", F.col("center.node").alias("center")))
    return rows.join(centers, "key").where(F.col("node") != F.col("center")).select(F.col("node").alias("a"), F.col("center").alias("b"))


def open_nodes(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the texts in bands that hold several classes."""
    labelled = settle(shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    several = settle(labelled.groupBy("key").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one != other").select("key"))
    return settle(labelled.join(several, "key").select("node", "root").distinct())


def rare_pairs(nodes: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """Pairs of different classes that may overlap enough: all that do are among them.

    Two multisets of which each holds the share `similarity` of the other have a member in common among the rarest of each,
    as many as it may lack and one more. What only one text has is ranked first and joins with nothing.
    """
    listed = settle(nodes.join(members, "node").select("node", "root", F.size("members").alias("items"), F.explode("members").alias("member")))
    counts = settle(listed.groupBy("member").agg(F.count(F.lit(1)).alias("texts")))
    rarest = Window.partitionBy("node").orderBy("texts", "member")
    ranked = listed.join(counts, "member").withColumn("rank", F.row_number().over(rarest))
    some = settle(ranked.where((F.col("rank") <= F.col("items") - F.ceil(F.col("items") * similarity - 1e-9) + 1) & (F.col("texts") > 1)).select("member", "node", "root", "items", "rank"))
    x, y = (some.select("member", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "root", "items", "rank"))) for side in "ab")
    # What two sizes must have in common at least bounds how far down either list their first common member stands.
    common = F.ceil((F.col("items_a") + F.col("items_b")) * (similarity / (1 + similarity)) - 1e-9)
    near = (F.col("rank_a") <= F.col("items_a") - common + 1) & (F.col("rank_b") <= F.col("items_b") - common + 1)
    return x.join(y, "member").where((F.col("node_a") < F.col("node_b")) & (F.col("root_a") != F.col("root_b")) & near).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def near_links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Signed rows (doc_id, node) and (node, root) for the nodes that are linked; `docs` has doc_id, node and text."""
    rows = settle(signed(docs))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("lead"), F.max("items").alias("items"), F.first("bands").alias("bands")))
    named = nodes.select("node", F.explode("bands").alias("key"))
    shared = settle(named.join(settle(named.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")), "key"))
    # A text that shares many large bands lies in the middle of its near copies and is linked with most of them.
    central = settle(shared.groupBy("node").agg(F.sum("rows").alias("central")))
    wanted = settle(central.join(nodes.select("node", "lead"), "node").select("node", "lead"))
    # One row of each wanted text: its copies are told apart by the id, so that they don't meet in one task.
    texts = docs.join(wanted.hint("shuffle_hash"), (docs["node"] == wanted["node"]) & docs["doc_id"].eqNullSafe(wanted["lead"])).select(docs["node"], docs["text"])
    members = settle(multisets(texts))
    sizes = nodes.select("node", "items")
    roots = components(verified(_against_center(shared, central), sizes, members, similarity))
    left = open_nodes(shared, roots)
    if not left.isEmpty():
        links = verified(rare_pairs(left, members, similarity), sizes, members, similarity)
        roots = components(links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return rows, roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, and class_id, the least id among its near copies and itself, directly or over others."""
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("node", F.unhex(F.md5("text")))
    rows, roots = near_links(own, similarity)
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("lead")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = settle(nodes)
    classes = settle(nodes.groupBy("root").agg(F.min("lead").alias("class_id")))
    named = settle(nodes.join(classes, "root").select("node", "class_id"))
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "class_id")
