"""Wide to long without a self-union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def stack_rows(names: list[str], *rows: tuple[Column, ...]) -> Column:
    """A generator that turns one row into several, each with the given column names."""
    return F.inline(F.array(*[F.struct(*[v.alias(n) for n, v in zip(names, row)]) for row in rows]))


def one_per_id(rows: DataFrame, key: str = "id", position: str | None = None) -> DataFrame:
    """One row per key: the one of the highest position, or the greatest row where no position is given."""
    others = [c for c in rows.columns if c not in (key, position)]
    if not others:
        return rows.select(key).distinct()
    order = [position] if position else []
    last = rows.groupBy(key).agg(F.max(F.struct(*order, *others)).alias("_last"))
    return last.select(key, *[f"_last.{c}" for c in others])
