"""Nearest neighbours by an adaptive scan over the dimensions of rotated vectors.

Vectors are grouped into lists around centroids, rotated by a random orthogonal matrix and stored in column blocks. A query
visits its nearest lists. In a list it adds up squared distances block of columns by block of columns; after each block a
test drops the candidates whose partial distance is too large for one of the best. After a random rotation the share of a
distance that falls on the first d of D columns follows a Beta(d/2, (D-d)/2) law, so a candidate that belongs to the best is
dropped by one test with a chance of `LOSS` at most.

The largest inner product becomes the least distance with one more column, sqrt(M^2 - |x|^2) for rows and 0 for queries, M
being the largest length. What survives all columns gets its score from the original vectors in double precision.

Rows: null, empty and zero vectors, and those with a null or non-finite component, take no part. A shorter vector counts as
filled up with zeros. Repeated rows are candidates and queries each for itself; a query only leaves out its own row. Ties go
to the smaller vec_id, a null vec_id last; a null vec_id is never a query. An empty table gives no rows. Other columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..session import settle

SAMPLE = 16_384   # rows that the centroids are fitted on, about; every row is indexed
LISTS = 16
SHARE = 0.85      # of all rows, which the visited lists of a query hold at least
LOSS = 0.002
COLUMNS = 16      # of a column block
BLOCK = 4_096     # vectors of a block, about
AT_ONCE = 64      # queries that share the arrays of partial distances
PAIRS = 1 << 15   # pairs whose vectors are gathered at once

_BLOCK_SCHEMA = T.StructType([T.StructField(name, T.BinaryType()) for name in ("rows", "ids", "nulls", "vectors", "rotated", "bounds")])
_FOUND = "query_row long, query_id long, row long, vec_id long, score double"


def beta_bounds(columns: int, loss: float) -> list[tuple[int, int, float]]:
    """(first column, last column + 1, largest share of a distance after them) for each column block."""
    out = []
    grid = (np.arange(1 << 16) + 0.5) / (1 << 16)
    # The last block takes what is less than a block: there a law for one more column would leave nothing to gain.
    for start in range(0, max(columns - COLUMNS, 0) + 1, COLUMNS):
        end = start + COLUMNS if start + 2 * COLUMNS <= columns else columns
        share = 1.0
        if end < columns:
            weight = (end / 2 - 1) * np.log(grid) + ((columns - end) / 2 - 1) * np.log1p(-grid)
            mass = np.cumsum(np.exp(weight - weight.max()))
            share = float(grid[min(np.searchsorted(mass, (1 - loss) * mass[-1]) + 1, len(grid) - 1)])
        out.append((start, end, share))
    return out


def rotation(columns: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((columns, columns)))
    return q * np.sign(np.diag(r))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = values
    return out


def centroids(sample: np.ndarray, count: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Lloyd's method on a sample; lists that run empty keep their place."""
    sample = np.unique(sample, axis=0)
    centers = sample[np.random.default_rng(seed).permutation(len(sample))[:count]].copy()
    for _ in range(rounds):
        owner = nearest(sample, centers)[:, 0]
        for c in np.unique(owner):
            centers[c] = sample[owner == c].mean(axis=0)
    return centers


def nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The centers of each point, nearest first."""
    return np.argsort((centers * centers).sum(axis=1) - 2 * points @ centers.T, axis=1, kind="stable")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "embedding").where("embedding is not null").where(~bad)
    return kept.where(F.exists("embedding", lambda x: x != 0))


class Frame:
    """What turns a vector into its rotated form; small, and the same for every task."""

    def __init__(self, width: int, scale: float, radius: float):
        self.width, self.scale, self.radius = width, scale, radius
        self.turn = rotation(width + 1)
        self.centers = np.zeros((0, width + 1))

    def rotated(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        scaled = vectors / self.scale
        last = np.zeros(len(scaled)) if query else np.sqrt(np.maximum(self.radius - (scaled * scaled).sum(axis=1), 0))
        return np.column_stack([scaled, last]) @ self.turn


def _index_rows(frame: Frame, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = matrix(batch.column("embedding"), frame.width)
        turned = frame.rotated(vectors)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("vec_id"), pa.array(nearest(turned, frame.centers)[:, 0], pa.int32()), _binaries(vectors), _binaries(turned.astype(np.float32))],
                                         ["row", "vec_id", "list", "vector", "rotated"])


def _binaries(values: np.ndarray) -> pa.Array:
    """Each row of an array as one binary value."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(values.shape[1] * values.itemsize), len(values), [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def _array(column: pa.Array, kind: type) -> np.ndarray:
    """The rows of a binary column of equal lengths, below each other."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1)


def _visits(frame: Frame, sizes: np.ndarray, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each query and list it visits: lists by nearness, until they hold `least` rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        turned = frame.rotated(_array(batch.column("vector"), np.float64), query=True)
        order = nearest(turned, frame.centers)
        held = np.cumsum(sizes[order], axis=1)
        query, place = np.nonzero((held - sizes[order] < least) & (sizes[order] > 0))
        own = batch.take(pa.array(query))
        yield pa.RecordBatch.from_arrays([own.column("row"), own.column("vec_id"), pa.array(order[query, place], pa.int32()), pa.array(place, pa.int32()), own.column("vector"), _binaries(turned[query].astype(np.float32))],
                                         ["row", "vec_id", "list", "place", "vector", "rotated"])


def _pack(keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that come ordered by `keys` as blocks of at most 2 * BLOCK rows."""
    held: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        held.clear()
        ids = table.column("vec_id")
        bound = table.column("bound").to_numpy(zero_copy_only=False) if "bound" in table.schema.names else np.zeros(0)
        values = [table.column("row").to_numpy().tobytes(), ids.fill_null(0).to_numpy(zero_copy_only=False).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
                  b"".join(table.column("vector").to_pylist()), b"".join(table.column("rotated").to_pylist()), bound.astype(np.float64).tobytes()]
        return pa.RecordBatch.from_arrays([*(table.column(k).slice(0, 1) for k in keys), *(pa.array([v], pa.binary()) for v in values)], [*keys, *_BLOCK_SCHEMA.names])

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = np.stack([batch.column(k).to_numpy() for k in keys])
        cuts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            key = tuple(codes[:, start])
            if held and key != tuple(held[0].column(k)[0].as_py() for k in keys):
                yield packed()
            while start < end:
                room = 2 * BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(start, min(room, end - start)))
                start += room
                if start <= end and sum(b.num_rows for b in held) >= 2 * BLOCK:
                    yield packed()
    if held:
        yield packed()


def _blocks(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`rows`, dealt and ordered by `keys`, as blocks."""
    kinds = [rows.schema[k] for k in keys]
    columns = [*keys, *(c for c in ("row", "vec_id", "vector", "rotated", "bound") if c in rows.columns)]
    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(partial(_pack, keys), T.StructType([*kinds, *_BLOCK_SCHEMA]))


class Block:
    def __init__(self, rows: bytes, ids: bytes, nulls: bytes, vectors: bytes, rotated: bytes, bounds: bytes, columns: list[tuple[int, int, float]]):
        self.rows, self.ids, self.nulls = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool)
        count = len(self.rows)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(count, -1)
        self.bounds = np.frombuffer(bounds, np.float64)
        turned = np.frombuffer(rotated, np.float32).reshape(count, -1)
        self.parts = [np.ascontiguousarray(turned[:, a:b]) for a, b, _ in columns]
        self.lengths = [(p * p).sum(axis=1) for p in self.parts]


def survivors(queries: Block, at: slice, held: Block, limits: np.ndarray, columns: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, candidate) that no test drops; `limits` has the largest distance of interest of each query."""
    pairs = None
    for k, (_, _, share) in enumerate(columns):
        bound = limits * share
        if pairs is None:
            step = queries.lengths[k][at, None] + held.lengths[k] - 2 * queries.parts[k][at] @ held.parts[k].T
            dense = step if k == 0 else dense + step
            alive = dense <= bound[:, None]
            # Few left: go on with the pairs alone.
            if k + 1 < len(columns) and alive.mean() > 0.25:
                continue
            query, row = np.nonzero(alive)
            pairs, sums = (query, row), dense[query, row]
            continue
        query, row = pairs
        for start in range(0, len(query), PAIRS):
            gap = queries.parts[k][at][query[start: start + PAIRS]] - held.parts[k][row[start: start + PAIRS]]
            sums[start: start + PAIRS] += np.einsum("ij,ij->i", gap, gap)
        kept = sums <= bound[query]
        pairs, sums = (query[kept], row[kept]), sums[kept]
    return pairs


def scan(queries: Block, held: Block, count: int, scale: float, radius: float, columns: list[tuple[int, int, float]]) -> list[np.ndarray]:
    """The best `count` of a block for each query: query and row indices, scores."""
    out = []
    lengths = (queries.vectors / scale) ** 2 @ np.ones(queries.vectors.shape[1])
    # Rotated values are rounded to 24 bits; the slack is far above what that changes.
    limits = (np.maximum(lengths + radius - 2 * queries.bounds / scale / scale, 0) + 1e-5 * (lengths + radius)).astype(np.float32)
    for start in range(0, len(queries.rows), AT_ONCE):
        at = slice(start, min(start + AT_ONCE, len(queries.rows)))
        query, row = survivors(queries, at, held, limits[at], columns)
        query = query + start
        scores = np.empty(len(query))
        for k in range(0, len(query), PAIRS):
            scores[k: k + PAIRS] = (queries.vectors[query[k: k + PAIRS]] * held.vectors[row[k: k + PAIRS]]).sum(axis=1)
        kept = (queries.rows[query] != held.rows[row]) & ~(scores < queries.bounds[query])
        query, row, scores = query[kept], row[kept], scores[kept]
        order = np.lexsort((held.rows[row], held.ids[row], held.nulls[row], -scores, query))
        query, row, scores = query[order], row[order], scores[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        best = place < count
        out.append((query[best], row[best], scores[best]))
    return [np.concatenate(x) for x in zip(*out)]


def _scan_blocks(count: int, scale: float, radius: float, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = beta_bounds(width + 1, LOSS)
    for batch in batches:
        for r in batch.to_pylist():
            queries = Block(*(r[f"q_{c}"] for c in _BLOCK_SCHEMA.names), columns)
            held = Block(*(r[c] for c in _BLOCK_SCHEMA.names), columns)
            query, row, scores = scan(queries, held, count, scale, radius, columns)
            yield pa.RecordBatch.from_arrays([pa.array(queries.rows[query]), pa.array(queries.ids[query]), pa.array(held.rows[row]), pa.array(held.ids[row], mask=held.nulls[row]), pa.array(scores)],
                                             ["query_row", "query_id", "row", "vec_id", "score"])


def search(vectors: DataFrame, is_query: Column | str, count: int = 20, lists: int = LISTS, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest `count` rows of each row for which the condition `is_query` holds.

    Lists are dealt out in parts of about BLOCK rows and the visits of a list in parts of as many queries, so a list with
    most rows, or one that most queries visit, is many tasks. Centroids are fitted on about SAMPLE rows, drawn by hash.
    """
    spark = vectors.sparkSession
    kept = usable(vectors)
    facts = kept.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("width"), F.max(F.aggregate("embedding", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))).alias("scale")).first()
    if not facts.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    scale = facts.scale
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + (x.cast("double") / scale) * (x.cast("double") / scale))
    frame = Frame(facts.width, scale, kept.agg(F.max(squares)).first()[0])
    drawn = kept if facts.n <= SAMPLE else kept.where(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / facts.n))
    sample = matrix(drawn.limit(2 * SAMPLE).select("embedding").toArrow().column("embedding"), frame.width)
    if not len(sample):
        sample = np.zeros((1, frame.width))
    frame.centers = centroids(frame.rotated(sample), lists)

    indexed = settle(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding").mapInArrow(partial(_index_rows, frame), "row long, vec_id long, list int, vector binary, rotated binary"))
    sizes = np.zeros(len(frame.centers), np.int64)
    for r in indexed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    parts = F.element_at(F.array(*(F.lit(int(-(-s // BLOCK))) for s in sizes)), F.col("list") + 1)
    held = _blocks(indexed.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int")), ["list", "part"])

    least = max(share * facts.n, min(facts.n, count + 1))
    chosen = indexed.where("vec_id is not null").where(is_query).select("row", "vec_id", "vector")
    visits = settle(chosen.mapInArrow(partial(_visits, frame, sizes, least), "row long, vec_id long, list int, place int, vector binary, rotated binary"))

    def scanned(some: DataFrame) -> DataFrame:
        counted = some.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("query_parts"))
        dealt = some.join(F.broadcast(counted), "list").withColumn("query_part", F.pmod(F.xxhash64("row"), "query_parts").cast("int"))
        blocks = _blocks(dealt, ["list", "query_part"]).withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
        pairs = blocks.select("list", "part", *(F.col(c).alias(f"q_{c}") for c in _BLOCK_SCHEMA.names)).join(held, ["list", "part"])
        return pairs.drop("list", "part").mapInArrow(partial(_scan_blocks, count, scale, frame.radius, frame.width), _FOUND)

    # The nearest list gives each query the score that a candidate of its other lists has to reach.
    first = settle(scanned(visits.where("place = 0").withColumn("bound", F.lit(float("-inf")))))
    reached = first.groupBy(F.col("query_row").alias("row")).agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least"))
    bound = F.when(F.col("found") >= count, F.col("least")).otherwise(float("-inf"))
    others = visits.where("place > 0").join(reached, "row", "left").withColumn("bound", F.coalesce(bound, F.lit(float("-inf")))).drop("found", "least")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    ranked = first.unionByName(scanned(others)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.select("query_id", "rank", "vec_id", "score")
