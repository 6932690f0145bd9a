"""Removing byte strings that occur again: a sparse suffix array ordered by deep-shallow sorting.

Every string of LENGTH bytes holds an anchor, the leftmost least hash of its grams, and equal strings have their anchors at
the same place. So only suffixes that begin at anchors are ordered, and of those only the ones whose anchor gram occurs
elsewhere. The strings of one anchor form its context. Equal contexts are found by aggregation, each is then represented
once; contexts of one gram that differ are sorted together from the anchor on, and once more backwards from it: multikey
quicksort to a shallow depth, then a blind trie for each group that is still together. Neighbours' common prefixes tell
which strings occur in more than one context.

A gram with more than TOGETHER different contexts isn't sorted in one task: its strings are counted by a 128-bit key.
Null text counts as empty. Copies of a text are one node; of a text that occurs twice every byte of its strings goes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import settle
from .columns import BYTE_VALUE, POWERS, Powers, constants, mix, slices, text_bytes

LENGTH = 400
SHALLOW = 4
TOGETHER = 2_000
_BLOCK = 1 << 18
_SECOND_VALUE, _SECOND_POWERS = constants(256, 21), Powers(int(constants(1, 22)[0]))
CONTEXT = "hash bigint, node binary, first bigint, windows int, before int, digest binary, context binary"


def gram_hashes(data: np.ndarray, size: int, values: np.ndarray = BYTE_VALUE, powers: Powers = POWERS) -> np.ndarray:
    """A 64-bit hash of the `size` bytes from each place on."""
    powers.reach(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers.up[: len(data)], out=sums[1:])
    count = max(0, len(data) - size + 1)
    return mix((sums[size: size + count] - sums[:count]) * powers.down[:count])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values."""
    count = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    onward = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:count], onward[width - 1: width - 1 + count])


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor place, hash, first window, windows) for each run of windows with one anchor; places are in `data`."""
    gram = max(1, length // 4)
    width = length - gram + 1
    parts = []
    for low in range(0, max(0, len(data) - length + 1), _BLOCK):
        high = min(low + _BLOCK, len(data) - length + 1)
        hashes = gram_hashes(data[low: high + length - 1], gram)
        least = sliding_least(hashes, width)
        window = np.arange(low, high)
        text = np.searchsorted(bounds, window, side="right") - 1
        good = window + length <= bounds[text + 1]
        window, text, least = window[good], text[good], least[good]
        if not len(window):
            continue
        spots = np.flatnonzero(np.isin(hashes, np.unique(least)))
        at = np.searchsorted(spots, window - low)
        late = np.flatnonzero(hashes[spots[at]] != least)
        while len(late):
            at[late] += 1
            late = late[hashes[spots[at[late]]] != least[late]]
        place = spots[at] + low
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
        heads = np.flatnonzero(fresh)
        parts.append((text[heads], place[heads], least[heads].view(np.int64), window[heads], np.diff(np.append(heads, len(place)))))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    text, place, hashes, first, windows = (np.concatenate(x) for x in zip(*parts))
    # A run that goes on over a block's edge is one run.
    fresh = np.ones(len(place), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(fresh)
    return text[heads], place[heads], hashes[heads], first[heads], np.add.reduceat(windows, heads)


def multikey_quicksort(keys: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of `keys` within their groups, and the groups of rows that agree in all columns.

    All groups are partitioned at once: less than, equal to and greater than the group's middle element in the column it
    has come to; the equal part goes on to the next column.
    """
    order = np.argsort(groups, kind="stable")
    part = np.unique(groups[order], return_inverse=True)[1]
    depth = np.zeros(len(order), np.int64)
    while True:
        starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(part)))
        live = np.repeat((sizes > 1) & (depth[starts] < keys.shape[1]), sizes)
        if not live.any():
            return order, part
        middle = np.repeat(starts + sizes // 2, sizes)
        column = np.minimum(depth, keys.shape[1] - 1)
        own, pivot = keys[order, column], keys[order[middle], column]
        side = np.where(live, 1 + (own > pivot).astype(np.int64) - (own < pivot), 1)
        again = np.lexsort((side, part))
        order, part, side, depth, live = order[again], part[again], side[again], depth[again], live[again]
        depth = depth + (live & (side == 1))
        part = np.unique(part * 3 + side, return_inverse=True)[1]


class BlindTrie:
    """Rows of a byte matrix in order: inner nodes know only a depth and one branch for each byte there."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        self.root: list | None = None

    def insert(self, row: int) -> None:
        if self.root is None:
            self.root = [-1, {}, [row]]
            return
        own = self.rows[row]
        node = self.root
        while node[0] >= 0:
            node = node[1].get(int(own[node[0]])) or next(iter(node[1].values()))
        differs = own != self.rows[node[2][0]]
        depth = int(differs.argmax())
        if not differs[depth]:
            node[2].append(row)
            return
        other = int(self.rows[node[2][0]][depth])
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][int(own[node[0]])]
        if node[0] == depth:
            node[1][int(own[depth])] = [-1, {}, [row]]
            return
        joint = [depth, {other: node, int(own[depth]): [-1, {}, [row]]}, []]
        if above is None:
            self.root = joint
        else:
            above[1][int(own[above[0]])] = joint

    def ordered(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            out += node[2]
            stack += [node[1][byte] for byte in sorted(node[1], reverse=True)]
        return out


def deep_shallow(rows: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix within their groups, and the common prefix of each with the one before it.

    -1 stands before the first row of a group.
    """
    rows = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -rows.shape[1] % 8 or (8 if not rows.shape[1] else 0)))))
    keys = rows.view(">u8").astype(np.uint64)[:, :shallow]
    order, part = multikey_quicksort(keys, groups)
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    for start, size in zip(starts.tolist(), np.diff(np.append(starts, len(part))).tolist()):
        if size > 1:
            trie = BlindTrie(rows)
            for row in order[start: start + size].tolist():
                trie.insert(row)
            order[start: start + size] = trie.ordered()
    common = np.full(len(order), -1, np.int64)
    for low in range(1, len(order), 4096):
        here, last = order[low: low + 4096], order[low - 1: low + 4096 - 1][: len(order[low: low + 4096])]
        differs = rows[here] != rows[last]
        found = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
        common[low: low + 4096] = np.where(groups[here] == groups[last], found, -1)
    return order, common


def _padded(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(parts), max((len(p) for p in parts), default=0)), np.uint8)
    for row, part in zip(out, parts):
        row[: len(part)] = part
    return out


def repeated_windows(groups: np.ndarray, contexts: list[bytes], before: np.ndarray, windows: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context which of its windows occur in another context of its group; contexts of a group differ."""
    raw = [np.frombuffer(c, np.uint8) for c in contexts]
    sides = []
    for rows in (_padded([r[b:] for r, b in zip(raw, before)]), _padded([r[:b][::-1] for r, b in zip(raw, before)])):
        order, common = deep_shallow(rows, groups)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        sides.append((common, back))
    found = [np.zeros(n, bool) for n in windows]
    (right, right_back), (left, left_back) = sides
    for reach in range(int(before.max(initial=-1)) + 1):
        rows = np.flatnonzero((reach <= before) & (reach > before - windows))
        if len(rows) < 2:
            continue
        # Two strings that begin `reach` bytes before their anchors are equal if their suffixes agree on the rest and their reversed prefixes on `reach` bytes.
        pairs = np.cumsum(right < length - reach)[right_back[rows]] * (len(contexts) + 1) + np.cumsum(left < reach)[left_back[rows]]
        _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        for row in rows[counts[inverse] > 1].tolist():
            found[row][before[row] - reach] = True
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _emit_anchors(length: int):
    def emit(batches):
        for batch in slices(batches, "text", 1 << 20):
            data, bounds = text_bytes(batch.column(1))
            text, _, hashes, _, _ = anchors(data, bounds, length)
            order = np.lexsort((hashes, text))
            text, hashes = text[order], hashes[order]
            fresh = np.ones(len(text), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
            heads = np.flatnonzero(fresh)
            twice = np.diff(np.append(heads, len(text))) > 1
            yield pa.record_batch({"node": batch.column(0).take(pa.array(text[heads])), "hash": pa.array(hashes[heads], pa.int64()), "twice": pa.array(twice)})
    return emit


def _emit_contexts(length: int):
    def emit(batches):
        for batch in slices(batches, "text", 1 << 20):
            data, bounds = text_bytes(batch.column(1))
            text, place, hashes, first, windows = anchors(data, bounds, length)
            wanted = [np.asarray(x.as_py(), np.int64) for x in batch.column(2)]
            keep = np.zeros(len(text), bool)
            for i, some in enumerate(wanted):
                low, high = np.searchsorted(text, [i, i + 1])
                keep[low:high] = np.isin(hashes[low:high], some)
            text, place, hashes, first, windows = (x[keep] for x in (text, place, hashes, first, windows))
            contexts = [data[a: a + n + length - 1].tobytes() for a, n in zip(first.tolist(), windows.tolist())]
            yield pa.record_batch({
                "hash": pa.array(hashes, pa.int64()), "node": batch.column(0).take(pa.array(text)), "first": pa.array(first - bounds[text], pa.int64()),
                "windows": pa.array(windows, pa.int32()), "before": pa.array(place - first, pa.int32()),
                "digest": pa.array([hashlib.md5(c).digest() for c in contexts], pa.binary()), "context": pa.array(contexts, pa.binary())})
    return emit


def _sort_groups(length: int):
    """Spans of repeated windows, from rows in order of their hash; a hash's rows are taken together."""
    schema = pa.schema([("node", pa.binary()), ("first", pa.int64()), ("end", pa.int64())])

    def solve(table: pa.Table) -> pa.RecordBatch:
        groups = np.unique(table.column("hash").to_numpy(), return_inverse=True)[1]
        before, windows = table.column("before").to_numpy().astype(np.int64), table.column("windows").to_numpy().astype(np.int64)
        found = repeated_windows(groups, table.column("context").to_pylist(), before, windows, length)
        rows = [(node, first + a, first + b - 1 + length) for node, first, flags in zip(table.column("node").to_pylist(), table.column("first").to_pylist(), found) for a, b in _runs(flags)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in range(3)], schema=schema)

    def sort(batches):
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows >= TOGETHER:
                last = held.column("hash")[held.num_rows - 1].as_py()
                whole = int(np.searchsorted(held.column("hash").to_numpy(), last))
                if whole:
                    yield solve(held.slice(0, whole))
                    held = held.slice(whole)
        if held is not None and held.num_rows:
            yield solve(held)
    return sort


def _emit_keys(length: int):
    """A 128-bit key for each window of a context."""
    def emit(batches):
        for batch in batches:
            for node, first, context in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2)):
                data = np.frombuffer(context.as_py(), np.uint8)
                one, two = gram_hashes(data, length), gram_hashes(data, length, _SECOND_VALUE, _SECOND_POWERS)
                yield pa.record_batch({
                    "one": pa.array(one.view(np.int64)), "two": pa.array(two.view(np.int64)), "node": pa.array([node.as_py()] * len(one), pa.binary()), "first": pa.array(first + np.arange(len(one)))})
    return emit


def _differ(*columns: str):
    """Whether the aggregated rows come from different places, and one of the places."""
    place = F.struct(*columns)
    return F.min(place) != F.max(place)


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(node, first, end): byte ranges, possibly overlapping, that repeated strings cover, and the (node, text) they lie in.

    `docs` has doc_id, node and text. Ranges of texts that occur twice or more are given only where other texts share them.
    """
    found = settle(docs.select("node", "text").mapInArrow(_emit_anchors(length), "node binary, hash bigint, twice boolean"))
    repeated = settle(found.groupBy("hash").agg(_differ("node").alias("several"), F.max("twice").alias("twice")).where("several or twice").select("hash"))
    wanted = found.join(repeated, "hash").groupBy("node").agg(F.collect_set("hash").alias("hashes"))
    leads = docs.groupBy("node").agg(F.min("doc_id").alias("lead"))
    wanted = settle(wanted.join(leads, "node"))
    # One row of each wanted text, told from its copies by the id, so that copies don't meet in one task.
    texts = docs.join(wanted.hint("shuffle_hash"), (docs["node"] == wanted["node"]) & docs["doc_id"].eqNullSafe(wanted["lead"])).select(docs["node"], docs["text"], "hashes")
    texts = settle(texts)
    contexts = settle(texts.mapInArrow(_emit_contexts(length), CONTEXT))
    alike = settle(contexts.groupBy("hash", "digest", "before").agg(_differ("node", "first").alias("repeated"), F.min(F.struct("node", "first")).alias("place")))
    whole = contexts.select("hash", "digest", "before", "node", "first", "windows").join(alike.where("repeated").select("hash", "digest", "before"), ["hash", "digest", "before"])
    spans = whole.select("node", "first", (F.col("first") + F.col("windows") - 1 + length).alias("end"))
    # Grams with different contexts of which one at least is not yet known to be repeated.
    counts = settle(alike.groupBy("hash").agg(F.count(F.lit(1)).alias("contexts"), F.min("repeated").alias("known")).where("contexts > 1 and not known").select("hash", "contexts"))
    chosen = settle(alike.select("hash", "before", "digest", F.col("place.node").alias("node"), F.col("place.first").alias("first")).join(counts, "hash"))
    rows = contexts.join(chosen, ["hash", "before", "digest", "node", "first"])
    few = rows.where(F.col("contexts") <= TOGETHER).select("hash", "node", "first", "windows", "before", "context")
    sorted_spans = few.repartition("hash").sortWithinPartitions("hash").mapInArrow(_sort_groups(length), "node binary, first bigint, end bigint")
    many = settle(rows.where(F.col("contexts") > TOGETHER).select("node", "first", "context").mapInArrow(_emit_keys(length), "one bigint, two bigint, node binary, first bigint"))
    equal = settle(many.groupBy("one", "two").agg(_differ("node", "first").alias("repeated")).where("repeated").select("one", "two"))
    counted = many.join(equal, ["one", "two"]).select("node", "first", (F.col("first") + length).alias("end"))
    return spans.unionByName(sorted_spans).unionByName(counted), texts.select("node", "text")


def _cut(length: int):
    def cut(batches):
        for batch in slices(batches, "text"):
            out = {"n_removed": [], "n_spans": [], "kept": []}
            data, bounds = text_bytes(batch.column(1))
            for i, spans in enumerate(batch.column(2)):
                kept, at, runs, removed = [], 0, 0, 0
                own = data[bounds[i]: bounds[i + 1]]
                for first, end in sorted((s["first"], s["end"]) for s in spans.as_py()):
                    if first > at or runs == 0:
                        kept.append(own[at:first])
                        runs, at = runs + 1, first
                    removed += max(0, end - at)
                    at = max(at, end)
                kept.append(own[at:])
                out["n_removed"].append(removed)
                out["n_spans"].append(runs)
                out["kept"].append(np.concatenate(kept).tobytes())
            yield pa.record_batch({"node": batch.column(0), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept": pa.array(out["kept"], pa.binary())})
    return cut


def without_repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node, text, copies), and (node, n_removed, n_spans, kept) for the single texts that lose bytes."""
    own = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("node", F.unhex(F.md5("text")))
    spans, texts = repeated_spans(own, length)
    spans = spans.groupBy("node").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
    return own, texts.join(settle(spans), "node").select("node", "text", "spans").mapInArrow(_cut(length), "node binary, n_removed bigint, n_spans bigint, kept binary")


def digest_columns(own: DataFrame, kept: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    # Rows that repeat both id and text come twice with the same values.
    lost = settle(kept.select("node", "n_removed", "n_spans", F.sha2("kept", 256).alias("sha")).distinct())
    # Texts that occur more than once and are long enough lose everything.
    twice = settle(own.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("node", F.lit(True).alias("copied")))
    rows = own.select("doc_id", "node", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("full_sha"))
    rows = rows.join(twice, "node", "left").join(lost, "node", "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= length)
    return rows.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "full_sha")).alias("kept_sha256"))
