"""Conjunctive registry search: predicates, stable sorting and paging.

A predicate whose argument is None or empty leaves the table unchanged.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import settle

# Columns searched by free text, and the named sort orders.
SEARCH_COLUMNS = ["registered_name", "registration_number", "call_name", "sire_name", "dam_name"]
SORT_PRESETS = {
    "name_asc": ("registered_name", "asc"),
    "name_desc": ("registered_name", "desc"),
    "date_added_asc": ("modified_at", "asc"),
    "date_added_desc": ("modified_at", "desc"),
    "birth_date_asc": ("date_of_birth", "asc"),
    "birth_date_desc": ("date_of_birth", "desc"),
}
DEFAULT_PRESET = "name_asc"
FLAG_COLUMNS = ["neutered", "approved_for_breeding", "frozen_semen", "artificial_insemination", "is_new"]
MAX_PER_PAGE = 100


def contains_pattern(term: str) -> str:
    # A backslash before an ordinary character means that character; Spark would reject it.
    return "%" + re.sub(r"\\(.)", lambda pair: pair[0] if pair[1] in "%_\\" else pair[1], term, flags=re.DOTALL) + "%"


def filter_search_text(dogs: DataFrame, term: str | None) -> DataFrame:
    if not term:
        return dogs
    present = [c for c in SEARCH_COLUMNS if c in dogs.columns]
    hit = F.lit(False)
    for name in present:
        hit = hit | F.col(name).ilike(contains_pattern(term))
    return dogs.filter(hit)


def filter_contains(dogs: DataFrame, column: str, term: str | None) -> DataFrame:
    return dogs.filter(F.col(column).ilike(contains_pattern(term))) if term else dogs


def filter_color(dogs: DataFrame, term: str | None) -> DataFrame:
    return filter_contains(dogs, "color", term)


def filter_equal(dogs: DataFrame, column: str, value: Any) -> DataFrame:
    return dogs if value is None or value == "" else dogs.filter(F.col(column) == F.lit(value))


def filter_flags(dogs: DataFrame, **flags: bool | None) -> DataFrame:
    """Tri-state flags: None is no predicate, and a null row matches neither true nor false."""
    for name, value in flags.items():
        dogs = filter_equal(dogs, name, value)
    return dogs


def filter_has_photo(dogs: DataFrame, wanted: bool | None) -> DataFrame:
    return dogs.filter(F.col("photo_url").isNotNull()) if wanted else dogs


def filter_range(dogs: DataFrame, column: str, low: Any = None, high: Any = None) -> DataFrame:
    """Closed interval with either end optional."""
    if low is not None:
        dogs = dogs.filter(F.col(column) >= F.lit(low))
    if high is not None:
        dogs = dogs.filter(F.col(column) <= F.lit(high))
    return dogs


def filter_incomplete_identity(records: DataFrame) -> DataFrame:
    """Keep records with an identifier; an absent slug counts as present, an empty one does not."""
    slug = F.coalesce(F.col("link_name"), F.lit("unknown")) if "link_name" in records.columns else F.lit("unknown")
    return records.filter((F.coalesce(F.col("uuid"), F.lit("")) != "") & (slug != ""))


def filter_by_person(
    dogs: DataFrame, links: DataFrame, people: DataFrame, person_key: str, name: str | None
) -> DataFrame:
    """Animals linked to a person whose name contains `name`."""
    if not name:
        return dogs
    matching = people.filter(F.col("name").ilike(contains_pattern(name))).select(F.col("id").alias(person_key))
    linked = links.join(matching, person_key, "left_semi").select(F.col("dog_id").alias("id"))
    return dogs.join(linked, "id", "left_semi")


def sort_dynamic(dogs: DataFrame, column: str | None, order: str = "asc") -> DataFrame:
    """Nulls sort as the highest value; `id` breaks ties. An unknown column means no sort."""
    if not column or column not in dogs.columns:
        return dogs
    return dogs.orderBy(*_sort_keys(column, order))


def _sort_keys(column: str, order: str) -> list[Column]:
    first = F.col(column).desc_nulls_first() if order.lower() == "desc" else F.col(column).asc_nulls_last()
    return [first] if column == "id" else [first, F.col("id").asc()]


def with_position(ordered: DataFrame) -> DataFrame:
    """A sorted frame with `position`, counted from 1 over all rows.

    Rows are numbered inside each sorted partition, and each partition starts where those before it end, so the only
    window without a key is over one row for each partition.
    """
    rows = settle(ordered.withColumn("_row", F.monotonically_increasing_id()))
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_size"), F.min("_row").alias("_first"))
    starts = sizes.select("_part", "_first", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start"))
    placed = rows.join(F.broadcast(starts), "_part")
    return placed.withColumn("position", F.col("_start") + F.col("_row") - F.col("_first") + 1).drop("_part", "_row", "_first", "_start")


def sort_presets(dogs: DataFrame, preset: str) -> DataFrame:
    return sort_dynamic(dogs, *SORT_PRESETS.get(preset, SORT_PRESETS[DEFAULT_PRESET]))


def page_offset(dogs: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    if page < 1 or not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"page starts at 1 and per_page lies in 1..{MAX_PER_PAGE}")
    return dogs.offset((page - 1) * per_page).limit(per_page)


def page_meta(dogs: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    total_pages = F.ceil(F.col("total") / per_page).cast("bigint")
    return (
        agg_total_count(dogs)
        .select(F.lit(page).alias("page"), F.lit(per_page).alias("per_page"), "total", total_pages.alias("total_pages"))
        .withColumn("has_more", F.col("page") < F.col("total_pages"))
    )


def agg_total_count(dogs: DataFrame) -> DataFrame:
    return dogs.agg(F.count("id").alias("total"))


def page_medical(records: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit lies in 1..1000 and offset is not negative")
    return records.orderBy("id").offset(offset).limit(limit)


def apply_filters(
    dogs: DataFrame,
    *,
    search: str | None = None,
    color: str | None = None,
    land_of_birth: str | None = None,
    land_of_standing: str | None = None,
    sex: int | None = None,
    has_photo: bool | None = None,
    has_conflicts: bool | None = None,
    flags: dict[str, bool | None] | None = None,
    year: tuple[Any, Any] = (None, None),
    born: tuple[Any, Any] = (None, None),
    died: tuple[Any, Any] = (None, None),
    modified: tuple[Any, Any] = (None, None),
    owner: tuple[DataFrame, DataFrame, str] | None = None,
    breeder: tuple[DataFrame, DataFrame, str] | None = None,
) -> DataFrame:
    """All predicates together. Column predicates come first, so they reach the scan before the semi joins."""
    for column, value in [
        ("land_of_birth", land_of_birth), ("land_of_standing", land_of_standing),
        ("sex", sex), ("has_conflicts", has_conflicts),
    ]:
        dogs = filter_equal(dogs, column, value)
    for column, bounds in [
        ("year_of_birth", year), ("date_of_birth", born), ("date_of_death", died), ("modified_at", modified),
    ]:
        dogs = filter_range(dogs, column, *bounds)
    dogs = filter_flags(dogs, **(flags or {}))
    dogs = filter_has_photo(dogs, has_photo)
    dogs = filter_color(dogs, color)
    dogs = filter_search_text(dogs, search)
    if owner:
        dogs = filter_by_person(dogs, owner[0], owner[1], "owner_id", owner[2])
    if breeder:
        dogs = filter_by_person(dogs, breeder[0], breeder[1], "breeder_id", breeder[2])
    return dogs


def registry_search(
    dogs: DataFrame, *, sort_by: str = "registered_name", sort_order: str = "asc", page: int = 1,
    per_page: int = 20, **filters: Any,
) -> DataFrame:
    """One page of matching animals in a stable order."""
    return page_offset(sort_dynamic(apply_filters(dogs, **filters), sort_by, sort_order), page, per_page)
