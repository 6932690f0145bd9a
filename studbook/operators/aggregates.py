"""Group counts and batch outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def agg_litters_by_birth(children: DataFrame) -> DataFrame:
    """Counts per parent and birth date; a child of unknown birth date belongs to no litter.

    The puppies themselves are the input rows under the same key (see litter_puppies), so a parent
    with very many children needs no list in one row.
    """
    sex = F.coalesce(F.col("sex"), F.lit(0))
    return (
        children.filter("date_of_birth is not null")
        .groupBy("parent_id", "date_of_birth")
        .agg(
            F.count_if(sex == 1).alias("male_count"),
            F.count_if(sex == 2).alias("female_count"),
            F.count_if(~sex.isin(1, 2)).alias("undefined_count"),
            F.count("*").alias("puppy_count"),
        )
    )


def litter_puppies(children: DataFrame) -> DataFrame:
    """Membership rows (parent, birth date, puppy) that go with agg_litters_by_birth."""
    return children.filter("date_of_birth is not null").select("parent_id", "date_of_birth", F.col("child_id").alias("puppy_id"))


def agg_litter_first_per_date(litters: DataFrame, position: str = "position") -> DataFrame:
    """One litter per parent and birth date: the one listed first."""
    others = [c for c in litters.columns if c not in ("parent_id", "date_of_birth")]
    first = F.min_by(F.struct(*others), F.col(position)).alias("first")
    return litters.groupBy("parent_id", "date_of_birth").agg(first).select("parent_id", "date_of_birth", "first.*")


def agg_batch_outcome(items: DataFrame, succeeded: Column) -> DataFrame:
    return items.agg(
        F.count("*").alias("attempted"),
        F.count_if(succeeded).alias("succeeded"),
        F.count_if(~F.coalesce(succeeded, F.lit(False))).alias("failed"),
    )


def agg_success_rate(outcome: DataFrame) -> DataFrame:
    """`done / attempted * 100` to one decimal with a percent sign, `0%` when nothing was attempted."""
    share = F.format_string("%.1f%%", F.col("succeeded") / F.nullif(F.col("attempted"), F.lit(0)) * 100)
    return outcome.withColumn("success_rate", F.when(F.col("attempted") > 0, share).otherwise("0%"))


def agg_join_text(values: Column, separator: str = ";") -> Column:
    """Non-blank parts of one record's list as one text, in their stored order; null when none is left."""
    kept = F.filter(values, lambda v: F.coalesce(v, F.lit("")) != "")
    return F.when(F.size(kept) > 0, F.array_join(kept, separator))
