"""Reading stored pages with regular expressions that run inside the JVM, over the whole text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import first_group, strip

# The entities the pages use; the ampersand comes last so that nothing is decoded twice.
ENTITIES = {"&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def node_text(c: Column) -> Column:
    """Text of a fragment, each piece between tags stripped."""
    text = F.when(c.contains("<"), F.regexp_replace(c, r"(?U)\s*<[^>]*>\s*", "")).otherwise(c)
    decoded = text
    for entity, character in ENTITIES.items():
        decoded = F.replace(decoded, F.lit(entity), F.lit(character))
    return strip(F.when(text.contains("&"), decoded).otherwise(text))


def all_groups(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def bodies(c: Column, tag: str) -> Column:
    """Inner texts of every `tag` element."""
    return all_groups(c, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>")


def body_with(c: Column, tag: str, attribute: str, value: str) -> Column:
    """Inner text of the first `tag` element with this attribute value."""
    return first_group(c, rf"(?is)<{tag}\b[^>]*\b{attribute}\s*=\s*[\"']{value}[\"'][^>]*>(.*?)</{tag}>")


def attribute(c: Column, name: str) -> Column:
    return first_group(c, rf"(?is)\b{name}\s*=\s*[\"']([^\"']*)[\"']")


def links(c: Column) -> Column:
    """Array of (href, text) for every anchor with a target."""
    pattern = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"
    zipped = F.arrays_zip(all_groups(c, pattern, 1).alias("href"), all_groups(c, pattern, 2).alias("body"))
    return F.transform(zipped, lambda z: F.struct(z["href"].alias("href"), node_text(z["body"]).alias("text")))


def last_wins(entries: Column) -> Column:
    """Map from (key, value) structs; of a repeated key the last entry stays."""
    n = F.size(entries)
    kept = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, n), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(kept)
