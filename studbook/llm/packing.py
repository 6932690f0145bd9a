"""Packing token pieces into sequences: large-item matching, then best fit for the small ones.

Pieces above a third of the capacity fit at most twice into a sequence, so they are matched in pairs, each longest one
with the longest that still fits. The others fill the gaps, longest first, each into the tightest gap that takes it.
Both decisions depend on lengths alone, so the plan is made on the histogram of lengths (at most one row per possible
length): it is a short list of runs "the pieces of length s with ranks from r go to sequences from q on, m in each". Each
piece then finds its place from its rank among the pieces of its length. Null text is an empty document; an empty table
gives no rows; repeated rows are packed each on their own.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import settle
from .columns import slices
from .tokens import encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
RUNS = "length bigint, first_rank bigint, pieces bigint, first_sequence bigint, per_sequence bigint, first_offset bigint"
RANKED_TOGETHER = 1000


def cut_pieces(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most `capacity` ids: little-endian unsigned 32-bit ids of each document and `end_id` after them.

    Only documents with more ids are cut; all their pieces but the first are full.
    """
    def encode(batches):
        found = encoder(path, pattern)
        for batch in slices(batches, "text"):
            ids, bounds = found.encode(batch.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            sizes = np.diff(bounds) + 1
            counts = (sizes + capacity - 1) // capacity
            row = np.repeat(np.arange(len(sizes)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            heads = sizes - capacity * (counts - 1)
            start = np.where(piece == 0, 0, heads[row] + capacity * (piece - 1))
            length = np.where(piece == 0, heads[row], capacity)
            ends = np.concatenate(([0], np.cumsum(length * 4))).astype(np.int32)
            yield pa.record_batch({
                "doc_id": batch.column(0).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids": pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(ids)])})
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(encode, PIECES)


class _Plan:
    """Groups of equal sequences (first one, how many, gap left) and the runs of pieces put into them."""

    def __init__(self, capacity: int):
        self.capacity, self.next_sequence = capacity, 0
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.gaps: list[int] = []
        self.ranks: dict[int, int] = {}
        self.runs: list[tuple[int, int, int, int, int, int]] = []

    def keep(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.groups:
                bisect.insort(self.gaps, gap)
            self.groups.setdefault(gap, []).append((first, count))

    def put(self, length: int, pieces: int, first: int, each: int, gap: int) -> None:
        rank = self.ranks.get(length, 0)
        self.runs.append((length, rank, pieces, first, each, self.capacity - gap))
        self.ranks[length] = rank + pieces

    def open(self, count: int) -> int:
        first = self.next_sequence
        self.next_sequence += count
        return first

    def match(self, a: int, b: int | None, count: int) -> None:
        first = self.open(count)
        self.put(a, count, first, 1, self.capacity)
        gap = self.capacity - a
        if b is not None:
            self.put(b, count, first, 1, gap)
            gap -= b
        self.keep(gap, first, count)

    def fill(self, length: int, count: int) -> None:
        while count:
            at = bisect.bisect_left(self.gaps, length)
            if at == len(self.gaps):
                each = self.capacity // length
                opened = -(-count // each)
                self.keep(self.capacity, self.open(opened), opened)
                continue
            gap = self.gaps[at]
            first, free = self.groups[gap].pop()
            if not self.groups[gap]:
                del self.groups[gap], self.gaps[at]
            each = gap // length
            used = min(free, count // each)
            if used == 0:
                used, each = 1, count
            self.put(length, used * each, first, each, gap)
            self.keep(gap - each * length, first, used)
            self.keep(gap, first + used, free - used)
            count -= used * each


def plan_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence, first offset) for a histogram of lengths."""
    plan = _Plan(capacity)
    large = sorted(length for length, n in counts.items() if n and 3 * length > capacity)
    left = {length: counts[length] for length in large}
    while large:
        longest = large[-1]
        at = bisect.bisect_right(large, capacity - longest) - 1
        partner = large[at] if at >= 0 else None
        if partner is None or (partner == longest and left[longest] == 1):
            other = large[at - 1] if partner == longest and at > 0 else None
            if other is None:
                plan.match(longest, None, left[longest])
                large.pop()
                continue
            partner = other
        pairs = left[longest] // 2 if partner == longest else min(left[longest], left[partner])
        plan.match(longest, partner, pairs)
        for length in (longest, partner):
            left[length] -= pairs
        large = [length for length in large if left[length]] if not (left[longest] and left[partner]) else large
    for length in sorted((x for x, n in counts.items() if n and 3 * x <= capacity), reverse=True):
        plan.fill(length, counts[length])
    return plan.runs


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """The pieces with `sequence_id` and `offset` added; `pieces` is read several times and must stay the same.

    Needs doc_id, piece and length; other columns are carried along.
    """
    spark: SparkSession = pieces.sparkSession
    # At most `capacity` rows come to the driver, one per length.
    counts = {row["length"]: row["n"] for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares = spark.createDataFrame([(k, -(-n // RANKED_TOGETHER)) for k, n in counts.items()], "length bigint, shares bigint")
    runs = spark.createDataFrame(plan_runs(counts, capacity), RUNS)
    dealt = pieces.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64("doc_id", "piece"), F.col("shares"))).drop("shares")
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "share").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "share").orderBy("doc_id", "piece")
    ranked = dealt.withColumn("within", F.row_number().over(within)).join(starts, ["length", "share"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    step = F.col("rank") - F.col("first_rank")
    # The runs are bounded by the number of lengths, not by the number of pieces.
    return ranked.join(F.broadcast(runs.withColumnRenamed("length", "run_length")), (F.col("length") == F.col("run_length")) & (step >= 0) & (step < F.col("pieces"))).select(
        *pieces.columns, (F.col("first_sequence") + F.floor(step / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + step % F.col("per_sequence") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, path: str, pattern: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(settle(cut_pieces(docs, path, pattern, capacity, end_id, key, text)), capacity)
