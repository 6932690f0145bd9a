"""Feed records to canonical registry columns, and display views of registry rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import dates as d, display as show, numbers as num, text as tx
from ..functions.text import blank_to_null

# Columns a feed record carries under the canonical name, taken as they are.
PLAIN_TEXT = [
    "uuid", "registered_name", "link_name", "call_name", "dam_uuid", "dam_name", "dam_link_name", "sire_uuid", "sire_name",
    "sire_link_name", "land_of_birth", "land_of_birth_code", "land_of_standing", "color", "color_marking", "variety",
    "distinguishing_features", "prefix_titles", "suffix_titles", "other_titles", "kennel", "notes", "data_correctness_notes", "club",
]
PLAIN_BOOLEAN = ["incomplete_pedigree", "locked", "removed", "show_ad", "is_new", "modified"]
DEFAULT_FALSE = ["neutered", "approved_for_breeding", "frozen_semen", "artificial_insemination"]
DATE_PARTS = ["year_of_birth", "month_of_birth", "day_of_birth", "year_of_death", "month_of_death", "day_of_death"]
DATES = ["date_of_birth", "date_of_death"]
# Labels of the second feed (Russian) and of the third feed (English), by canonical column.
LABELS_B = {
    "registered_name": "name", "call_name": "домашняя кличка", "land_of_birth": "страна рождения", "land_of_standing": "местонахождение",
    "color": "окрас", "other_titles": "титулы", "kennel": "питомник", "distinguishing_features": "отличительные черты",
    "brand_chip": "клеймо/чип", "sire_name": "отец", "dam_name": "мать",
}
LABELS_B_NUMBERS = {"size": "рост", "weight": "вес"}
LABELS_B_DATES = {"date_of_birth": "дата рождения", "date_of_death": "дата смерти"}
LABELS_B_LINKS = {"sire_link_name": "отец_url", "dam_link_name": "мать_url"}
LABELS_C = {
    "registration_number": "reg.no", "color": "colour", "eyes_color": "eyes", "notes": "note",
}

HEALTH = T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()), T.StructField("screening_test_result", T.StringType()), T.StructField("notes", T.StringType()),
]))


def map_source_a(records: DataFrame, source: str, photo_base: str) -> DataFrame:
    """JSON text in `animal` to typed canonical columns. Absent keys become null or their default."""
    def field(name: str) -> Column:
        return F.get_json_object("animal", f"$.{name}")

    columns = [field(c).alias(c) for c in PLAIN_TEXT]
    columns += [field(c).try_cast("boolean").alias(c) for c in PLAIN_BOOLEAN]
    columns += [F.coalesce(field(c).try_cast("boolean"), F.lit(False)).alias(c) for c in DEFAULT_FALSE]
    columns += [num.parse_int(field(c)).alias(c) for c in DATE_PARTS]
    columns += [d.parse_date_multi(field(c)).alias(c) for c in DATES]
    columns += [
        F.coalesce(num.parse_int(field("sex")), F.lit(0)).alias("sex"),
        num.parse_float(field("size")).alias("size"),
        num.parse_float(field("weight")).alias("weight"),
        num.parse_int(field("registration_status")).alias("registration_status"),
        tx.strip_reg_number(field("registration_number")).alias("registration_number"),
        num.parse_float(field("coi")).alias("coi"),
        d.parse_date_multi(field("coi_updated_on")).alias("coi_updated_on"),
        tx.photo_url_from_path(field("primary_photo_path"), photo_base).alias("photo_url"),
        d.parse_datetime_us(field("modified_at")).alias("modified_at"),
        F.coalesce(F.from_json(field("health_info_general"), HEALTH), F.array().cast(HEALTH)).alias("health_info_general"),
        F.coalesce(F.from_json(field("health_info_genetic"), HEALTH), F.array().cast(HEALTH)).alias("health_info_genetic"),
        F.coalesce(F.from_json(field("sports"), "array<string>"), F.array().cast("array<string>")).alias("sports"),
        F.lit(source).alias("source"),
    ]
    kept = [c for c in records.columns if c != "animal"]
    return records.select(*kept, *columns)


def map_source_b(records: DataFrame, source: str) -> DataFrame:
    """A label -> value map (`info`) to canonical columns. The key is md5 of the page's own slug, else of the name."""
    info = F.col("info")
    columns = [info[label].alias(c) for c, label in LABELS_B.items()]
    columns += [num.parse_float(info[label]).alias(c) for c, label in LABELS_B_NUMBERS.items()]
    columns += [d.parse_date_ru(info[label]).alias(c) for c, label in LABELS_B_DATES.items()]
    columns += [tx.slug_from_query(info[label]).alias(c) for c, label in LABELS_B_LINKS.items()]
    own = F.coalesce(info["link_name"], info["name"], F.lit(""))
    columns += [num.sex_code(F.coalesce(info["пол"], F.lit(""))).alias("sex"), F.lit(source).alias("source"), tx.surrogate_uuid(own).alias("uuid")]
    return records.select(*[c for c in records.columns if c != "info"], *columns)


def map_source_c(records: DataFrame, source: str) -> DataFrame:
    """An English label map (`info`) beside page-level fields to canonical columns."""
    info = F.col("info")
    columns = [info[label].alias(c) for c, label in LABELS_C.items()]
    columns += [
        tx.extract_call_name(info["name"]).alias("call_name"),
        F.when(info["sex"].isNotNull(), num.sex_code(info["sex"])).alias("sex"),
        d.parse_date_dotted(info["born"]).alias("date_of_birth"),
        num.parse_float(info["height"]).alias("size"),
        blank_to_null(F.concat_ws("; ", info["ch-titles"], info["results"])).alias("other_titles"),
        F.lit(source).alias("source"),
    ]
    return records.select(*[c for c in records.columns if c != "info"], *columns)


def map_person(records: DataFrame, people: str, flag: str, default: bool, prefix: str = "") -> DataFrame:
    """(rec_id, uuid, name, flag) out of an array of people; a person without uuid gets md5(prefix + name)."""
    one = records.select("rec_id", F.explode(people).alias("p"))
    key = F.coalesce(blank_to_null(F.col("p.uuid")), tx.surrogate_uuid(F.coalesce("p.name", F.lit("")), prefix))
    return one.select("rec_id", key.alias("uuid"), F.col("p.name").alias("name"), F.coalesce(f"p.{flag}", F.lit(default)).alias(flag))


def map_title(records: DataFrame, titles: str = "titles") -> DataFrame:
    """Title rows with the owning animal's id."""
    one = records.select("dog_id", F.explode(titles).alias("t"))
    return one.select(
        "dog_id", F.col("t.id").alias("title_id"), "t.short_name", "t.long_name", "t.is_prefix", "t.has_winner_year", "t.winner_year")


def map_litter(litters: DataFrame) -> DataFrame:
    """Litter attributes from `litter` structs: typed date, counts default 0, parent ids out of nested structs."""
    counts = [F.coalesce(f"litter.{c}", F.lit(0)).alias(c) for c in ("litter_male_count", "litter_female_count", "litter_undef_count")]
    parents = [F.col(f"litter.{r}.id").alias(f"{r}_id") for r in ("dam", "sire", "mating_partner")]
    kept = [c for c in litters.columns if c != "litter"]
    return litters.select(*kept, d.parse_date_multi(F.col("litter.date_of_birth")).alias("date_of_birth"), *counts, *parents)


LITTER = T.StructType(
    [T.StructField("date_of_birth", T.StringType())]
    + [T.StructField(c, T.IntegerType()) for c in ("litter_male_count", "litter_female_count", "litter_undef_count")]
    + [T.StructField(r, T.StructType([T.StructField("id", T.LongType())])) for r in ("dam", "sire", "mating_partner")]
)


def map_sibling(records: DataFrame, source: str, photo_base: str) -> DataFrame:
    """Slim record from a sibling entry held as JSON text in `animal`."""
    def field(name: str) -> Column:
        return F.get_json_object("animal", f"$.{name}")

    names = ["uuid", "link_name", "registered_name", "land_of_birth", "color", "variety", "prefix_titles", "suffix_titles"]
    return records.select(
        *[c for c in records.columns if c != "animal"], *[field(c).alias(c) for c in names],
        num.parse_int(field("sex")).alias("sex"), num.parse_int(field("registration_status")).alias("registration_status"),
        num.parse_int(field("year_of_birth")).alias("year_of_birth"),
        tx.photo_url_from_path(field("primary_photo_path"), photo_base).alias("photo_url"), F.lit(source).alias("source"))


def overlay_records(detail: Column, listing: Column, always: list[str]) -> Column:
    """Maps laid over each other: detail wins, the listing adds keys the detail lacks, `always` comes from the listing.

    A key counts as present even when its value is null.
    """
    forced = F.transform(F.array(*[F.lit(k) for k in always]), lambda k: F.struct(k.alias("key"), F.element_at(listing, k).alias("value")))
    own = F.map_filter(detail, lambda k, v: ~k.isin(*always))
    added = F.map_filter(listing, lambda k, v: ~F.map_contains_key(detail, k) & ~k.isin(*always))
    return F.map_concat(own, added, F.map_from_entries(forced))


def view_tree_node(tree: DataFrame) -> DataFrame:
    """Display names for lineage rows; children follow by path, dam before sire."""
    return tree.select(
        "root", "path", F.col("node").alias("id"), F.col("registered_name").alias("name"),
        F.struct(
            "sex", "color", d.format_date_long(F.col("date_of_birth")).alias("date_of_birth"), "registration_number", "coi",
        ).alias("attributes"),
    )


def view_status_tags(dogs: DataFrame) -> DataFrame:
    return dogs.select("id", show.status_tags({c: F.col(c) for c in show.STATUS_LABELS if c in dogs.columns}).alias("tags"))


def view_title_text(titles: DataFrame) -> DataFrame:
    return titles.select("id", "dog_id", show.title_text(
        F.col("long_name"), F.col("short_name"), F.col("is_prefix"), F.col("has_winner_year"), F.col("winner_year")).alias("title_text"))


def view_health_rows(records: DataFrame) -> DataFrame:
    """(id, kind, name, value) from both health arrays."""
    def rows(column: str, kind: str, with_notes: bool) -> DataFrame:
        one = records.select("id", F.explode(column).alias("h"))
        value = show.health_value(F.col("h.screening_test_result"), F.col("h.notes") if with_notes else None)
        return one.select("id", F.lit(kind).alias("kind"), F.col("h.name").alias("name"), value.alias("value"))

    return rows("health_info_general", "general", False).unionByName(rows("health_info_genetic", "genetic", True))
