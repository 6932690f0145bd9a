"""Text normalisation, slugs, urls and surrogate keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The spellings the feeds use.
UUID_PATTERN = "[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
PATH_UUID_PATTERN = "-([a-f0-9-]{36})$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """A capture group of the first match, null when nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def strip(c: Column) -> Column:
    """Drop every kind of leading and trailing whitespace, not only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def strip_reg_number(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def to_snake_case(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))


def extract_call_name(c: Column) -> Column:
    return first_group(c, r"\(([^)]+)\)")


def extract_year(c: Column) -> Column:
    return first_group(c, r"(\d{4})").cast("int")


def extract_uuid(c: Column) -> Column:
    return first_group(c, f"({UUID_PATTERN})")


def path_uuid(c: Column) -> Column:
    """The 36-character identifier that ends a profile path."""
    return first_group(c, PATH_UUID_PATTERN)


def path_slug(c: Column) -> Column:
    """The last path segment without its identifier, null when it carries none."""
    segment = F.element_at(F.split(c, "/"), -1)
    return F.when(path_uuid(c).isNotNull(), F.replace(segment, F.concat(F.lit("-"), path_uuid(c)), F.lit("")))


def slug_from_query(c: Column) -> Column:
    """Text after the last `name=`, null when the url has none."""
    return F.when(F.contains(c, F.lit("name=")), F.element_at(F.split(c, "name="), -1))


def next_page_url(c: Column, page_size: int) -> Column:
    """Move the `start` parameter on by one page; blank parameters are dropped, `start` keeps its place."""
    base = F.element_at(F.split(c, r"\?"), 1)
    query = F.coalesce(first_group(c, r"\?([^#]*)"), F.lit(""))
    pairs = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=.+"))
    starts = F.filter(pairs, lambda p: p.startswith("start="))
    current = F.coalesce(F.substring_index(F.try_element_at(starts, F.lit(-1)), "=", -1), F.lit("0"))
    moved = F.concat(F.lit("start="), (current.try_cast("bigint") + page_size).cast("string"))
    first_start = F.array_position(F.transform(pairs, lambda p: p.startswith("start=")), True)
    kept = F.filter(pairs, lambda p, i: ~p.startswith("start=") | (i + 1 == first_start))
    placed = F.transform(kept, lambda p: F.when(p.startswith("start="), moved).otherwise(p))
    full = F.when(F.size(starts) > 0, placed).otherwise(F.concat(kept, F.array(moved)))
    return F.when(moved.isNotNull(), F.concat(base, F.lit("?"), F.array_join(full, "&")))


def surrogate_uuid(c: Column, prefix: str = "") -> Column:
    """Stable key for a record without one: md5 of its url or name, optionally prefixed per feed."""
    return F.md5(F.concat(F.lit(prefix), c))


def photo_url_from_path(c: Column, base_url: str) -> Column:
    return F.when(blank_to_null(c).isNotNull(), F.concat(F.lit(base_url), c))


def photo_urls(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ";"), strip)
    return F.filter(parts, lambda p: p != "")


def photo_thumbnail(c: Column) -> Column:
    """First entry as stored; null when that entry is blank, so the caller shows its placeholder."""
    return blank_to_null(F.element_at(F.split(c, ";"), 1))


def photo_medium_size(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"_s\.jpg$", "_m.jpg")


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^a-zA-Z0-9]", "_")


def absolute_url(href: Column, base_url: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base_url), href))
