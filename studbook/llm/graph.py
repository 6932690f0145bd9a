"""Connected components of an edge list, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import settle


def _least_neighbour(both: DataFrame) -> DataFrame:
    return settle(both.groupBy("u").agg(F.min("v").alias("least")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, the root being the least node of its component.

    `edges` has columns a and b of one ordered type. Each half round is an aggregation and a join dealt by plain exchanges,
    so the many edges of one node can be split over tasks. Rounds go on until an edge list repeats.
    """
    edges = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _least_neighbour(both)
        # Large star: the larger neighbours of a node are tied to the least of it and its neighbours.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "least").alias("v")).distinct()
        large = settle(large)
        # Small star: a node and its smaller neighbours are tied to the least of them.
        least = _least_neighbour(large)
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("least").alias("v")).where("u != v").unionByName(least.select("u", F.col("least").alias("v"))).distinct()
        edges = settle(small)
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")).first()
        if state == seen:
            break
        state = seen
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return settle(roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
