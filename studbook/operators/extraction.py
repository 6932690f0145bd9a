"""Typed rows out of stored pages: (page_id, html) in, one row per extracted item out.

Class and label names are fixed values of the page formats and can be passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates as d, html as h, numbers as num, text as tx
from ..session import settle, unsent
from .elements import CELL, Search, find, find_each

# Script variables with the shape of their literal.
SCRIPT_VARIABLES = {"animal": r"\{.*?\}", "health_screenings": r"\[.*?\]", "animal_healthinfos": r"\[.*?\]", "siblings": r"\[.*?\]", "litters": r"\{.*?\}"}
NAME_JUNK = r"^[0-9/?…]+$"


def extract_script_json(pages: DataFrame) -> DataFrame:
    """JSON texts of the known variables in the first script that sets `animal`; an absent list is empty."""
    script = F.try_element_at(F.filter(h.bodies(F.col("html"), "script"), lambda s: s.contains("var animal =")), F.lit(1))
    scripts = pages.select("page_id", script.alias("script"))
    found = {v: tx.first_group(F.col("script"), rf"(?s)var {v}\s*=\s*({shape});") for v, shape in SCRIPT_VARIABLES.items()}
    found["litters"] = F.get_json_object(found["litters"], "$.litters")
    return scripts.select("page_id", *[
        F.coalesce(value, F.lit("{}" if name == "animal" else "[]")).alias(name) for name, value in found.items()])


LABELS = Search("div.textLabel", parts=(("value", "+div.textDescription"),))
HEADING = Search("h1[itemprop=name]", within="div.titlename")


def page_facts(pages: DataFrame, sections: tuple[str, ...] = ()) -> DataFrame:
    """Labels, headings and the links of these sections, each page parsed once; `label_table` and `section_links` read them."""
    searches = {"label": LABELS, "heading": HEADING} | {f"links {section}": _section_search(section) for section in sections}
    return find_each(pages.select("page_id", "html"), searches, columns=("position", *CELL.names, "parts"))


def label_table(pages: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(page_id, heading, position, label, value): labels with a description beside them, numbered among these, and the page's heading.

    `facts` is the written `page_facts` of the same pages, where several functions read it.
    """
    found = (page_facts(pages) if facts is None else facts).filter(F.col("search").isin("label", "heading"))
    heading = F.col("search") == "heading"
    rows = found.select("page_id", heading.alias("heading"), "position", F.when(heading, "name").otherwise(_label(F.col("text"))).alias("label"),
                        F.when(heading, F.struct("text", "attributes", "links", "images")).otherwise(F.try_element_at("parts", F.lit("value"))).alias("value"))
    return rows.filter("value is not null and (not heading or position = 0)")


def _label(c: Column) -> Column:
    return F.regexp_replace(F.lower(tx.strip(c)), ":+$", "")


def extract_label_values(pages: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(page_id, position, label, value) for every labelled row; the page's heading has the label `name`.

    `table` is the written `label_table` of the same pages, where several functions read it.
    """
    rows = label_table(pages) if table is None else table
    return rows.select("page_id", F.when(F.col("heading"), -1).otherwise(F.col("position")).alias("position"), "label", F.col("value.text").alias("value"))


def extract_label_links(pages: DataFrame, base_url: str, all_links_label: str = "владелец", table: DataFrame | None = None) -> DataFrame:
    """(page_id, label, link_no, text, url): every link of the owner row, the first link of any other."""
    rows = (label_table(pages) if table is None else table).filter("not heading")
    linked = rows.select("page_id", "label", F.posexplode("value.links").alias("link_no", "link"))
    kept = linked.filter((F.col("link_no") == 0) | (F.col("label") == all_links_label))
    return kept.select("page_id", "label", "link_no", F.col("link.text").alias("text"), tx.absolute_url(F.col("link.href"), base_url).alias("url"))


def label_info(pages: DataFrame, base_url: str) -> DataFrame:
    """One `info` map per page, of values and links read out of one pass over the pages."""
    table = settle(label_table(pages))
    return label_map(extract_label_values(pages, table), extract_label_links(pages, base_url, table=table))


def label_map(values: DataFrame, links: DataFrame) -> DataFrame:
    """One `info` map per page from label values and `<label>_url` links; a page has a few dozen labels."""
    urls = links.filter("link_no = 0").select("page_id", F.lit(0).alias("position"), F.concat("label", F.lit("_url")).alias("key"), F.col("url").alias("value"))
    entries = values.select("page_id", "position", F.col("label").alias("key"), "value").unionByName(urls)
    last = entries.groupBy("page_id", "key").agg(F.max_by("value", "position").alias("value"))
    return last.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("info"))


def extract_labelled_table(pages: DataFrame, table_class: str = "podaci", heading_class: str = "sadrzaj") -> DataFrame:
    """(page_id, registered_name, info): two-cell rows as a map by lower-case label."""
    found = find_each(pages.select("page_id", "html"), {"heading": Search("h2", within=f"div.{heading_class}"), "row": Search("tr", within=f"table.{table_class}", cells=2)}, columns=("position", "text", "cells"))
    entry = F.struct("position", _label(F.get("cells", F.lit(0))["text"]).alias("key"), F.get("cells", F.lit(1))["text"].alias("value"))
    rows = found.select("page_id", F.when(F.col("search") == "row", entry).alias("entry"), F.when((F.col("search") == "heading") & (F.col("position") == 0), F.struct("text")).alias("heading"))
    by_page = rows.groupBy("page_id").agg(F.array_sort(F.collect_list("entry")).alias("entries"), F.collect_list("heading").alias("headings"))
    # A page id that comes several times has each of its headings.
    listed = pages.select("page_id").join(unsent(by_page), "page_id", "left").withColumn("heading", F.explode_outer("headings")).withColumn("registered_name", F.col("heading.text"))
    none = F.array().cast("array<struct<position:int,key:string,value:string>>")
    pairs = F.transform(F.coalesce("entries", none), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    return listed.select("page_id", "registered_name", h.last_wins(pairs).alias("info"))


def extract_photo_ids(pages: DataFrame, base_url: str, cell_class: str = "right") -> DataFrame:
    """Image urls behind `photo(a, b,` handlers, joined by `;`; null when the page has none."""
    calls = find(pages.select("page_id", "html"), Search("[onclick*=photo]", within=f"td.{cell_class}"), columns=("position", "attributes"))
    asked = calls.select("page_id", "position", tx.first_group(F.col("attributes")["onclick"], r"photo\(\d+,\s*(\d+),").alias("photo")).filter("photo is not null")
    url = F.concat(F.lit(f"{base_url}/slike/"), F.col("photo"), F.lit("/"), F.col("page_id").cast("string"), F.lit(".jpg"))
    urls = asked.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", url.alias("url")))).alias("urls"))
    return pages.select("page_id").join(urls, "page_id", "left").select("page_id", F.array_join("urls.url", ";").alias("photo_url"))


def extract_parents_by_rowspan(pages: DataFrame, generations: int = 3, table_class: str = "pedigre") -> DataFrame:
    """Sire and dam from an ancestry table: per row the first cell spanning half of it; the first is the sire."""
    span = str(2 ** (generations - 1))
    rows = find(pages.select("page_id", "html"), Search("tr", within=f"table.{table_class}"), columns=("position", "cells"))
    wide = F.try_element_at(F.filter("cells", lambda c: c["attributes"]["rowspan"] == span), F.lit(1))
    linked = rows.select("page_id", "position", F.try_element_at(wide["links"], F.lit(1)).alias("link")).filter(F.col("link.href").rlike(r"id=\d+"))
    listed = linked.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("position", "link"))).alias("parents"))
    columns = []
    for position, role in enumerate(("sire", "dam"), 1):
        parent = F.try_element_at(F.col("parents.link"), F.lit(position))
        columns += [tx.first_group(parent["href"], r"id=(\d+)").alias(f"{role}_uuid"), parent["text"].alias(f"{role}_name")]
    return pages.select("page_id").join(listed, "page_id", "left").select("page_id", *columns)


def _has_class(attributes: Column, token: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attributes["class"], F.lit("")), r"\s+"), token)


def _first_link(position: int) -> Column:
    return F.try_element_at(F.get("cells", F.lit(position))["links"], F.lit(1))


def _cell_text(position: int) -> Column:
    return F.get("cells", F.lit(position))["text"]


def extract_offspring_rows(pages: DataFrame, skip_class: str = "legenda") -> DataFrame:
    """One row per puppy in the table after the offspring heading; rows without link, id or birth date are dropped."""
    rows = find(pages.select("page_id", "html"), Search("tr", within="table", after="h3", saying="offspring", skip=skip_class, cells=6), columns=("cells",))
    image = F.try_element_at(F.get("cells", F.lit(3))["images"], F.lit(1))
    color = F.try_element_at(F.filter(F.get("cells", F.lit(4))["images"], lambda i: _has_class(i, "boja")), F.lit(1))
    link, sire = _first_link(2), _first_link(9)
    return rows.select(
        "page_id", _cell_text(0).alias("registration_number"), tx.first_group(link["href"], r"id=(\d+)").alias("uuid"), link["text"].alias("registered_name"),
        F.when(image["src"].contains("sp1"), 1).otherwise(2).alias("sex"), F.coalesce(color["alt"], F.lit("")).alias("color"),
        d.parse_date_dotted(_cell_text(5)).alias("date_of_birth"), sire["text"].alias("sire_name"), tx.first_group(sire["href"], r"id=(\d+)").alias("sire_uuid"),
    ).filter("uuid is not null and date_of_birth is not null")


def _first_per(rows: DataFrame, key: str) -> DataFrame:
    """The first listed row per key, by page and position; aggregated on the map side before the shuffle."""
    others = [c for c in rows.columns if c != key]
    first = F.min_by(F.struct(*others), F.struct("page_id", "position"))
    return rows.groupBy(key).agg(first.alias("first")).select(key, "first.*")


def extract_listing_rows(pages: DataFrame, base_url: str) -> DataFrame:
    """Registry listing: rows of six or more cells with a link, a real name and some birth or parent data; one per link."""
    rows = find(pages.select("page_id", "html"), Search("tr", within="table#doglist"), columns=("position", "cells")).filter("position > 0 and size(cells) >= 6")
    link = _first_link(0)
    fields = rows.select(
        "page_id", "position", link["text"].alias("name"), tx.absolute_url(link["href"], base_url).alias("link"),
        *[_cell_text(i).alias(n) for i, n in [(1, "sex"), (2, "sire"), (3, "dam"), (5, "birth_date")]])
    kept = fields.filter(F.col("link").isNotNull() & ~F.col("name").rlike(NAME_JUNK) & (F.concat("birth_date", "sire", "dam") != ""))
    return _first_per(kept, "link")


def extract_listing_rows_wide(pages: DataFrame, skip_class: str = "legenda") -> DataFrame:
    """Wide listing: rows of eleven or more cells, id from the third cell's link, non-empty name; one per id."""
    rows = find(pages.select("page_id", "html"), Search("tr", skip=skip_class, cells=11), columns=("position", "cells"))
    link = _first_link(2)
    fields = rows.select("page_id", "position", tx.first_group(link["href"], r"id=(\d+)").alias("dog_id"), link["text"].alias("name"))
    return _first_per(fields.filter("dog_id is not null and name <> ''"), "dog_id")


CARDS = Search("div.itemBox", parts=(
    ("photo", "a.profilePhoto"), ("registered_name", "span[data-bind*=text: registered_name]"), ("prefix_titles", "span.prefixTitles"), ("suffix_titles", "span.suffixTitles"),
    ("male", ".icon-male"), ("female", ".icon-female"), ("sire_name", "div.italic >> span@0"), ("dam_name", "div.italic >> span@2"), ("color", "span[data-bind*=text: color]"),
    ("land_of_birth", "span[data-bind*=text: land_of_birth]"), ("year_of_birth", "span[data-bind*=year_of_birth]"), ("modified_at", "span.dateModified"), ("ribbon", ".ribbon")))


def extract_listing_cards(pages: DataFrame) -> DataFrame:
    """Card listing, one row per card; cards without an identifier in their link are dropped."""
    one = find(pages.select("page_id", "html"), CARDS, columns=("position", "parts"))

    def part(name: str) -> Column:
        return F.try_element_at("parts", F.lit(name))

    def text(name: str) -> Column:
        return part(name)["text"]

    href, paired = part("photo")["attributes"]["href"], part("dam_name").isNotNull()
    fields = one.select(
        "page_id", "position", tx.path_uuid(href).alias("uuid"), tx.path_slug(href).alias("link_name"), *[text(c).alias(c) for c in ("registered_name", "prefix_titles", "suffix_titles")],
        F.when(part("male").isNotNull(), 1).when(part("female").isNotNull(), 2).alias("sex"), F.when(paired, text("sire_name")).alias("sire_name"), text("dam_name").alias("dam_name"),
        text("color").alias("color"), text("land_of_birth").alias("land_of_birth"), tx.extract_year(text("year_of_birth")).alias("year_of_birth"), text("modified_at").alias("modified_at"),
        part("ribbon").isNotNull().alias("is_new"))
    return fields.filter("uuid is not null")


def extract_medical_rows(pages: DataFrame) -> DataFrame:
    """Certificate rows: registry, test date, report date, age, conclusion and number."""
    rows = find(pages.select("page_id", "html"), Search("tr", cells=6), columns=("position", "cells"))
    text = [_cell_text(i) for i in range(6)]
    return rows.select(
        "page_id", "position", text[0].alias("registry"), d.parse_date_cert(text[1]).alias("test_date"), d.parse_date_cert(text[2]).alias("report_date"),
        num.parse_int(text[3]).alias("age_in_months"), text[4].alias("conclusion"), text[5].alias("ofa_number"))


def extract_table_rows(pages: DataFrame, headers: list[str]) -> DataFrame:
    """Rows after the first whose cell count equals the header count, as named columns."""
    kept = find(pages.select("page_id", "html"), Search("tr"), columns=("position", "cells")).filter(f"position > 0 and size(cells) = {len(headers)}")
    return kept.select("page_id", "position", *[_cell_text(i).alias(name) for i, name in enumerate(headers)])


def _section_search(section: str) -> Search:
    return Search("a[href]", within=f"div.{section}")


def section_links(pages: DataFrame, section: str, base_url: str, facts: DataFrame | None = None) -> DataFrame:
    """(page_id, position, url, name): every link of a named section, its url absolute.

    `facts` is the written `page_facts` of the same pages with this section, where several functions read it.
    """
    one = find(pages.select("page_id", "html"), _section_search(section), columns=("position", "text", "attributes")) if facts is None else facts.filter(F.col("search") == f"links {section}")
    return one.select("page_id", "position", tx.absolute_url(F.col("attributes")["href"], base_url).alias("url"), F.col("text").alias("name"))


def extract_section_links(pages: DataFrame, section: str, base_url: str) -> DataFrame:
    """Links of a named section as absolute urls, each url at its first page only."""
    return _first_per(section_links(pages, section, base_url), "url")


def extract_page_links(pages: DataFrame) -> DataFrame:
    """Every anchor of every page: (page_id, position, href, text)."""
    return pages.select("page_id", F.posexplode(h.links(F.col("html"))).alias("position", "link")).select("page_id", "position", "link.href", "link.text")


def extract_page_navigation(pages: DataFrame) -> DataFrame:
    """(page_id, position, href, text) of the links in a page's navigation."""
    links = find(pages.select("page_id", "html"), Search("a[href]", within="nav"), columns=("position", "text", "attributes"))
    return links.select("page_id", "position", F.col("attributes")["href"].alias("href"), "text")


def extract_page_outline(pages: DataFrame) -> DataFrame:
    """(page_id, heading, paragraphs, footer): the article's heading, how many paragraphs it has, and the footer's text."""
    found = find_each(pages.select("page_id", "html"), {"article": Search("article", parts=(("heading", "h1"),)), "paragraph": Search("p", within="article"), "footer": Search("footer")}, columns=("position", "text", "parts"))
    first = F.col("position") == 0
    rows = found.select(
        "page_id", "search", F.when((F.col("search") == "article") & first, F.struct(F.try_element_at("parts", F.lit("heading"))["text"].alias("text"))).alias("article"),
        F.when((F.col("search") == "footer") & first, F.struct("text")).alias("footer"))
    by_page = rows.groupBy("page_id").agg(
        F.collect_list("article").alias("articles"), F.count_if(F.col("search") == "paragraph").alias("paragraphs"), F.collect_list("footer").alias("footers"))
    # A page id that comes several times has each of its articles and footers.
    listed = pages.select("page_id").join(by_page, "page_id", "left").withColumn("article", F.explode_outer("articles")).withColumn("footer", F.explode_outer("footers"))
    return listed.select("page_id", F.col("article.text").alias("heading"), F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.col("footer.text").alias("footer"))
