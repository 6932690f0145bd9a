"""The trie of conversation prefixes, by union-find over the common prefixes of sorted neighbours.

Conversations are sorted by the digests of their turns, so those that share a prefix stand together. Each range partition
takes the lengths of the prefixes that neighbours share in descending order and unites their components: a union at length l
makes, or widens, a branching node of depth l, whose children are the tops of the united components. Everything between a
node and the branching node above it is a chain of equal members, written out without further unions.

Nodes that hold the first or the last row of a partition may go on in the next one. Of these, only the two paths (first
row, last row) leave the partition, each node with the sums of what hangs at it directly. One pass over the paths of all
partitions in order, with a stack as deep as a path, unites equal nodes and closes the others. Its input is two paths a
partition, whatever the partition holds.

Turns are compared by a 128-bit digest of role and text, so texts are read once and never moved. Turns with equal (conv_id,
turn) go by role, then digest; repeated rows are turns of their own. Null role or text is the empty string. Rows without a
conv_id belong to no conversation and are left out. A conversation is one row of digests (16 bytes and a number a turn) when
it is sorted. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle
from .columns import ragged

_STATS = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FOREST = f"{_STATS}, parent_conv_id long, parent_key string, part int, side int, digest binary, words long, ends string"
_MERGED = f"{_STATS}, key string, sid string, parent_sid string"
_NO_ENDS = hashlib.sha256().hexdigest()


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, digest, words): the place of each turn in its conversation, its digest and its number of words."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    turns = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return turns.select("conv_id", F.row_number().over(order).alias("rank"), "digest", "words")


def with_shared_heads(turns: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """(conv_id, digests, words): the first `heads` (0 to `most`) turns of conversation `base`, then the own turns after as many."""
    marked = turns.withColumn("base", base).withColumn("heads", heads)
    own = marked.select("conv_id", F.when((F.col("rank") > F.col("heads")) | (F.col("base") == F.col("conv_id")), F.struct(F.lit(1).alias("part"), "rank", "digest", "words")).alias("at"))
    lent = marked.where((F.col("rank") <= most) & (F.col("base") == F.col("conv_id"))).select(F.col("conv_id").alias("base"), "rank", "digest", "words")
    takers = marked.where((F.col("rank") == 1) & (F.col("heads") > 0) & (F.col("base") != F.col("conv_id"))).select("conv_id", "base", "heads")
    taken = takers.join(lent, "base").where(F.col("rank") <= F.col("heads")).select("conv_id", F.struct(F.lit(0).alias("part"), "rank", "digest", "words").alias("at"))
    whole = own.unionByName(taken).groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).alias("turns"))
    return whole.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words"))


def neighbour_prefixes(digests: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many leading digests each row shares with the row before it; rows are digests[starts[i]:starts[i + 1]]."""
    counts = np.diff(starts)
    shared = np.minimum(counts[1:], counts[:-1])
    left, right = ragged(starts[:-2], shared), ragged(starts[1:-1], shared)
    differ = np.flatnonzero((digests[left] != digests[right]).any(axis=1))
    row = np.repeat(np.arange(len(shared)), shared)[differ]
    np.minimum.at(shared, row, right[differ] - starts[1:-1][row])
    return shared


class Forest:
    """The compressed trie of sorted rows: nodes by number, the first of them the rows themselves."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, prefixes: np.ndarray, total_words: np.ndarray, starts: np.ndarray):
        n = len(ids)
        self.words, self.starts = total_words, starts
        self.depth, self.row, self.members, self.least = counts.tolist(), list(range(n)), [1] * n, ids.tolist()
        self.children, self.leaves, self.saved = [0] * n, [0] * n, [0] * n
        self.low, self.high = list(range(n)), list(range(n))
        self.parent, self.parent_depth, self.same = [-1] * n, [-1] * n, {}
        root, top = list(range(n)), list(range(n))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for edge in np.argsort(-prefixes, kind="stable").tolist():
            length, a, b = int(prefixes[edge]), find(edge), find(edge + 1)
            left, right = top[a], top[b]
            if self.depth[left] == length:
                node = left
            elif self.depth[right] == length:
                node, left, right = right, right, left
            else:
                node = self._above(left, length)
            if self.depth[right] == length:
                self._widen(node, right)
            else:
                self._hang(right, node)
            root[b] = a
            top[a] = node

    def _above(self, child: int, depth: int) -> int:
        self.depth.append(depth)
        for values, value in ((self.row, self.row[child]), (self.members, 0), (self.least, self.least[child]), (self.children, 0), (self.leaves, 0), (self.saved, 0),
                              (self.low, self.low[child]), (self.high, self.high[child]), (self.parent, -1), (self.parent_depth, -1)):
            values.append(value)
        self._hang(child, len(self.depth) - 1)
        return len(self.depth) - 1

    def _join(self, node: int, other: int) -> None:
        self.members[node] += self.members[other]
        self.least[node] = min(self.least[node], self.least[other])
        self.low[node], self.high[node] = min(self.low[node], self.low[other]), max(self.high[node], self.high[other])

    def _hang(self, child: int, node: int) -> None:
        self.parent[child], self.parent_depth[child] = node, self.depth[node]
        self._join(node, child)
        self.children[node] += 1
        self.leaves[node] += self.leaves[child] or 1
        self.saved[node] += self.chain(child)

    def _widen(self, node: int, other: int) -> None:
        self.same[other] = node
        self._join(node, other)
        for values in (self.children, self.leaves, self.saved):
            values[node] += values[other]

    def chain(self, node: int) -> int:
        """Tokens saved in the subtree of the highest node of a chain."""
        at = self.starts[self.row[node]]
        return self.saved[node] + (self.members[node] - 1) * int(self.words[at + self.depth[node]] - self.words[at + self.parent_depth[node]])

    def real(self, node: int) -> int:
        while node in self.same:
            node = self.same[node]
        return node


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The finished nodes of a partition, and the paths of its first and last row with what hangs at them."""
    ids, counts, words, prefixes, first, last = [], [], [], [], None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        listed = batch.column("digests")
        values = np.frombuffer(listed.flatten().cast(pa.binary(16)).buffers()[1], np.uint64).reshape(-1, 2) if len(listed.flatten()) else np.zeros((0, 2), np.uint64)
        sizes = np.diff(listed.offsets.to_numpy()).astype(np.int64)
        held = values if last is None else np.concatenate([last, values])
        starts = np.concatenate([[0], np.cumsum(sizes if last is None else np.concatenate([[len(last)], sizes]))])
        prefixes.append(neighbour_prefixes(held, starts))
        ids.append(batch.column("conv_id").to_numpy())
        counts.append(sizes)
        words.append(batch.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        first = values[: sizes[0]].copy() if first is None else first
        last = held[starts[-2]:].copy()
    if last is None:
        return
    ids, counts, prefixes, words = (np.concatenate(x) for x in (ids, counts, prefixes, words))
    n, part = len(ids), TaskContext.get().partitionId()
    # Row i has the words of its first k turns at starts[i] + k, relative to starts[i].
    starts = np.concatenate([[0], np.cumsum(counts + 1)])
    total = np.zeros(starts[-1], np.int64)
    total[np.delete(np.arange(starts[-1]), starts[:-1])] = words
    total = np.cumsum(total)
    forest = Forest(ids, counts, prefixes, total, starts)

    # The deepest node on the first or the last row's path that each row belongs to.
    with_first = np.minimum.accumulate(np.concatenate([counts[:1], prefixes]))
    with_last = np.minimum.accumulate(np.concatenate([prefixes, counts[-1:]])[::-1])[::-1]
    both = int(with_first[-1])
    side = (with_last > both).astype(int)
    at = np.where(side == 1, with_last, with_first)

    nodes = [x for x in range(len(forest.depth)) if x not in forest.same and forest.low[x] > 0 and forest.high[x] < n - 1]
    yield from _finished(forest, nodes, ids, counts, side, at, part)
    yield from _paths(forest, nodes, ids, counts, side, at, both, first, last, part)


def _finished(forest: Forest, nodes: list[int], ids: np.ndarray, counts: np.ndarray, side: np.ndarray, at: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    open_nodes = {x for x in range(len(forest.depth)) if x not in forest.same} - set(nodes)
    for start in range(0, len(nodes), 4096):
        some = nodes[start: start + 4096]
        ends = []
        for x in some:
            low, high = forest.low[x], forest.high[x] + 1
            until = low + int(np.searchsorted(counts[low:high] > forest.depth[x], True)) if forest.children[x] else high
            ends.append(hashlib.sha256(_joined(ids[low:until]).encode()).hexdigest() if until > low else _NO_ENDS)
        above = [forest.real(forest.parent[x]) for x in some]
        key = [f"{part}.{side[forest.low[x]]}.{forest.parent_depth[x]}" if p in open_nodes else None for x, p in zip(some, above)]
        parent = [None if p in open_nodes else forest.least[p] for p in above]
        depth, top, members = (np.array([values[x] for x in some], np.int64) for values in (forest.depth, forest.parent_depth, forest.members))
        children, leaves, saved = (np.array([values[x] for x in some], np.int64) for values in (forest.children, forest.leaves, forest.saved))
        least, row = np.array([forest.least[x] for x in some], np.int64), forest.starts[[forest.row[x] for x in some]]
        length = depth - top
        of = np.repeat(np.arange(len(some)), length)
        level = ragged(top + 1, length)
        lowest, highest = level == depth[of], level == top[of] + 1
        count = len(of)
        for cut in range(0, count, 1 << 16):
            s = slice(cut, min(cut + (1 << 16), count))
            o, lv, lo, hi = of[s], level[s], lowest[s], highest[s]
            below = forest.words[row[o] + depth[o]] - forest.words[row[o] + lv - 1]
            m = len(o)
            texts = [ends[x] if end else _NO_ENDS for x, end in zip(o.tolist(), lo.tolist())]
            parents = [parent[x] if high else own for x, high, own in zip(o.tolist(), hi.tolist(), least[o].tolist())]
            keys = [key[x] if high else None for x, high in zip(o.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(least[o]), pa.array(lv), pa.array(members[o]), pa.array(np.where(lo, children[o], 1)), pa.array(np.maximum(leaves[o], 1)), pa.array(saved[o] + (members[o] - 1) * below),
                                              pa.array(texts, pa.string()), pa.array(parents, pa.int64()), pa.array(keys, pa.string()), *(pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.string()))],
                                             [f.split()[0] for f in _FOREST.split(", ")])


def _paths(forest: Forest, nodes: list[int], ids: np.ndarray, counts: np.ndarray, side: np.ndarray, at: np.ndarray, both: int, first: np.ndarray, last: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
    hung = [x for x in nodes if forest.low[forest.real(forest.parent[x])] == 0 or forest.high[forest.real(forest.parent[x])] == len(ids) - 1]
    for which, row, low, digests in ((0, 0, 0, first), (1, len(ids) - 1, both + 1, last)):
        depths = np.arange(low, counts[row] + 1)
        if not len(depths):
            continue
        size = len(depths)
        mine = side == which
        members, least = np.bincount(at[mine] - low, minlength=size), np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(least, at[mine] - low, ids[mine])
        sums = np.zeros((3, size), np.int64)
        for x in hung:
            if side[forest.low[x]] == which:
                sums[:, forest.parent_depth[x] - low] += (1, forest.leaves[x] or 1, forest.chain(x))
        ending = mine & (counts == at)
        # A row that ends on a path stands in order of its depth there.
        ends, ended = [""] * size, np.flatnonzero(ending)
        levels, begins = np.unique(at[ended], return_index=True)
        for d, rows in zip(levels.tolist(), np.split(ended, begins[1:])):
            ends[d - low] = _joined(ids[rows])
        start = forest.starts[row]
        words = np.where(depths > 0, forest.words[start + depths] - forest.words[start + np.maximum(depths - 1, 0)], 0)
        keys = [b"" if d == 0 else digests[d - 1].tobytes() for d in depths.tolist()]
        for cut in range(0, size, 1 << 16):
            s = slice(cut, min(cut + (1 << 16), size))
            m = len(depths[s])
            yield pa.RecordBatch.from_arrays([pa.array(least[s]), pa.array(depths[s].astype(np.int64)), pa.array(members[s].astype(np.int64)), pa.array(sums[0, s]), pa.array(sums[1, s]), pa.array(sums[2, s]), pa.nulls(m, pa.string()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string()),
                                              pa.array(np.full(m, part, np.int32)), pa.array(np.full(m, which, np.int32)), pa.array(keys[s], pa.binary()), pa.array(words[s].astype(np.int64)), pa.array(ends[s], pa.string())],
                                             [f.split()[0] for f in _FOREST.split(", ")])


class Open:
    """A node on the path that the next partition may go on with."""

    def __init__(self, row: dict, sid: str):
        self.sid, self.digest, self.words, self.depth = sid, row["digest"], row["words"], row["depth"]
        self.members = self.children = self.leaves = self.saved = 0
        self.least, self.ends, self.any_end = row["conv_id"], hashlib.sha256(), False
        self.add(row)

    def add(self, row: dict) -> None:
        self.members += row["n_convs"]
        self.least = min(self.least, row["conv_id"])
        self.children += row["n_children"]
        self.leaves += row["n_leaves"]
        self.saved += row["saved_tokens"]
        if row["ends"]:
            self.ends.update((("," if self.any_end else "") + row["ends"]).encode())
            self.any_end = True

    def close(self, above: Open | None) -> dict:
        leaves, saved = self.leaves if self.children else 1, self.saved + (self.members - 1) * self.words
        if above is not None:
            above.members += self.members
            above.least = min(above.least, self.least)
            above.children += 1
            above.leaves += leaves
            above.saved += saved
        return {"conv_id": self.least, "depth": self.depth, "n_convs": self.members, "n_children": self.children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": self.ends.hexdigest(),
                "sid": self.sid, "parent_sid": above.sid if above is not None else None}


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unite the paths of neighbouring partitions. Gives each finished node, and which node each row of a path belongs to."""
    names = [f.split()[0] for f in _MERGED.split(", ")]
    kinds = pa.schema([(n, pa.string() if n in ("ends_sha256", "key", "sid", "parent_sid") else pa.int64()) for n in names])
    stack: list[Open] = []
    was, follows = None, False

    def cut(depth: int, out: list[dict]) -> None:
        while len(stack) > depth:
            node = stack.pop()
            out.append(node.close(stack[-1] if stack else None))

    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            depth, path = row["depth"], (row["part"], row["side"])
            if path != was:
                was, follows = path, row["side"] == 0
            key = f"{row['part']}.{row['side']}.{depth}"
            if follows and depth < len(stack) and stack[depth].digest == row["digest"]:
                stack[depth].add(row)
            else:
                follows = False
                cut(depth, out)
                stack.append(Open(row, key))
            out.append({"key": key, "sid": stack[depth].sid})
        yield pa.RecordBatch.from_pylist(out, kinds)
    out = []
    cut(0, out)
    yield pa.RecordBatch.from_pylist(out, kinds)


def trie(sequences: DataFrame) -> DataFrame:
    """One row per distinct prefix of the rows (conv_id, digests, words) of `sequences`.

    conv_id is the least member; depth; parent_conv_id that of the node above (null for the root); n_convs, n_children,
    n_leaves (childless nodes of the subtree); saved_tokens, over the subtree, words of a node's last turn times its members
    but one; ends_sha256 of the comma-joined ids of the members that end there.
    """
    found = settle(settle(sequences).repartitionByRange("digests", "conv_id").sortWithinPartitions("digests", "conv_id").mapInArrow(_forest, _FOREST))
    inner, paths = found.where("part is null"), found.where("part is not null")
    merged = settle(paths.repartition(1).sortWithinPartitions("part", "side", "depth").mapInArrow(_merge, _MERGED))
    closed, member_of = merged.where("key is null").drop("key"), merged.where("key is not null").select("key", "sid")
    least = closed.select("sid", F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    outer = closed.join(least.withColumnRenamed("sid", "parent_sid"), "parent_sid", "left")
    hanging = inner.where("parent_key is not null").drop("parent_conv_id").join(member_of.join(least, "sid").select(F.col("key").alias("parent_key"), "parent_conv_id"), "parent_key")
    return outer.select(columns).unionByName(hanging.select(columns)).unionByName(inner.where("parent_key is null").select(columns))
