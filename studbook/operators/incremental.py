"""Refresh by modification time. Every instant is passed in; nothing reads the wall clock."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import parse_datetime_listing


def cutoff(as_of: Column, days: int) -> Column:
    if not 1 <= days <= 30:
        raise ValueError("days lies in 1..30")
    return as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))


def incr_recent_window(feed: DataFrame, as_of: Column, days: int = 1, text: str = "modified_text") -> DataFrame:
    """Rows modified within `days` of `as_of`; a row whose date does not parse is kept."""
    modified = parse_datetime_listing(F.col(text))
    return feed.filter(modified.isNull() | (modified >= cutoff(as_of, days)))


def incr_take_until_cutoff(feed: DataFrame, as_of: Column, days: int = 1, text: str = "modified_text", position: str = "pos") -> DataFrame:
    """Rows in listing order up to, and without, the first one older than the cutoff.

    The first older row is one minimum over the feed, so no ordered window over the whole feed is needed.
    """
    older = F.coalesce(parse_datetime_listing(F.col(text)) < cutoff(as_of, days), F.lit(False))
    stop = feed.agg(F.min(F.when(older, F.col(position))).alias("_stop"))
    return feed.crossJoin(F.broadcast(stop)).filter(F.col("_stop").isNull() | (F.col(position) < F.col("_stop"))).drop("_stop")


def incr_capped_refresh(sources: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """Full refresh that stops at each source's row cap, in id order."""
    parts = [frame.orderBy("id").limit(cap).withColumn("feed", F.lit(name)) for name, (frame, cap) in sources.items()]
    return reduce(DataFrame.unionByName, parts)


def latest_per_key(rows: DataFrame, key: str, modified: Column, tie: str) -> DataFrame:
    """The most recently modified row per key; undated rows count as oldest, the highest `tie` decides among equals."""
    others = [c for c in rows.columns if c != key]
    order = F.struct(modified.isNotNull().alias("dated"), modified.alias("at"), F.col(tie).alias("tie"))
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")
