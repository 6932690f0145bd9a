"""Page extraction and feed mapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as h, numbers as num
from ..operators import ancestry as anc, extraction as ex, mapping as mp
from . import query

BASE = "http://base/"


def between(start: str, stop: str, text: str = "html") -> str:
    """SQL for the text between two fixed markers, null when the first is missing."""
    return f"case when contains({text}, '{start}') then split_part(split_part({text}, '{start}', 2), '{stop}', 1) end"


@query("extract_script_json", f"""
select page_id, concat({between('var animal = ', '};')}, '}}') as animal, concat({between('var health_screenings = ', '];')}, ']') as health_screenings,
  concat({between('var animal_healthinfos = ', '];')}, ']') as animal_healthinfos, concat({between('var siblings = ', '];')}, ']') as siblings,
  concat({between('{"litters":', ']};')}, ']') as litters from script_pages""")
def extract_script_json(t):
    return ex.extract_script_json(t("script_pages"))


@query("extract_script_json_pages", "select page_id, '{}' as animal, '[]' as siblings from pages")
def extract_script_json_pages(t):
    """Untidy pages whose scripts set none of the variables."""
    return ex.extract_script_json(t.base("pages")).select("page_id", "animal", "siblings")


LABELS = f"""
select page_id, 0 as position, 'окрас' as label, trim({between('Окрас:</div><div class="textDescription">', '<')}) as value from html_labels
union all select page_id, 1, 'отец', trim(split_part(split_part(split_part(html, '<a href', 2), '>', 2), '<', 1)) from html_labels
union all select page_id, 2, 'дата рождения', {between('Дата рождения:</div><div class="textDescription">', '<')} from html_labels
union all select page_id, -1, 'name', trim({between('itemprop="name">', '<')}) from html_labels"""


@query("extract_label_values", LABELS)
def extract_label_values(t):
    return ex.extract_label_values(t("html_labels"))


@query("extract_label_links", """
select id as page_id, 'владелец' as label, 0 as link_no, concat('Own ', cast(id % 7 as string)) as text, concat('http://base/u.php?id=', cast(id as string)) as url from registry
union all select id, 'владелец', 1, concat('Co ', cast(id % 5 as string)), concat('http://x/', cast(id % 5 as string)) from registry
union all select id, 'заводчик', 0, concat('Kennel ', cast(id % 11 as string)), concat('http://base/k.php?id=', cast(id % 11 as string)) from registry""")
def extract_label_links(t):
    return ex.extract_label_links(t("person_pages"), BASE)


@query("extract_labelled_table", """
select id as page_id, registered_name, concat('JR ', cast(id as string)) as reg_no, case when sex = 1 then 'male' else 'female' end as sex, coalesce(color, '') as color,
  case when id % 6 = 0 then 'tall' else cast(50 + id % 12 as string) end as height, case when id % 2 = 0 then 'BOB' end as results, 10 + cast(id % 2 = 0 as int) - 1 as labels from registry""")
def extract_labelled_table(t):
    info = F.col("info")
    return ex.extract_labelled_table(t("record_pages")).select(
        "page_id", "registered_name", info["reg.no"].alias("reg_no"), info["sex"].alias("sex"), info["colour"].alias("color"),
        info["height"].alias("height"), info["results"].alias("results"), (F.size(info) + 1).alias("labels"))


@query("extract_photo_ids", """
select id as page_id, concat('http://base/slike/', cast(100 + id as string), '/', cast(id as string), '.jpg;http://base/slike/', cast(200 + id as string), '/', cast(id as string), '.jpg') as photo_url from registry""")
def extract_photo_ids(t):
    return ex.extract_photo_ids(t("record_pages"), "http://base")


@query("extract_parents_by_rowspan", """
select id as page_id, cast(coalesce(sire_id, 9) as string) as sire_uuid, coalesce(sire_name, 'unknown') as sire_name,
  cast(coalesce(dam_id, 8) as string) as dam_uuid, coalesce(dam_name, 'unknown') as dam_name from registry_named""")
def extract_parents_by_rowspan(t):
    return ex.extract_parents_by_rowspan(t("ancestor_pages"))


@query("extract_offspring_rows", """
select coalesce(dam_id, 0) as page_id, concat('JR ', cast(id as string)) as registration_number, cast(id as string) as uuid, registered_name, sex, coalesce(color, '') as color,
  cast(date_of_birth as timestamp) as date_of_birth, case when sire_id is not null then coalesce(sire_name, '') end as sire_name, cast(sire_id as string) as sire_uuid from registry_named where id % 6 <> 0""")
def extract_offspring_rows(t):
    return ex.extract_offspring_rows(t("offspring_pages").select("page_id", "html"))


LISTING = "select id as page_id, concat('<table id=\"doglist\"><tr><th>Name</th></tr>', row_html, '</table>') as html from listing_pages"


@query("extract_listing_rows", """
select page_id, 1 as position, name, concat('http://base/details.php?name=d', cast(page_id - page_id % 2 as string)) as link, sex, sire, dam, birth_date from (
  select id as page_id, registered_name as name, case when sex = 1 then 'Male' else 'Female' end as sex, coalesce(sire_name, '') as sire, coalesce(dam_name, '') as dam,
    case when id % 4 = 0 then '' else cast(year(date_of_birth) as string) end as birth_date, row_number() over (partition by id - id % 2 order by id) as n
  from registry_named where id % 9 <> 0 and (id % 4 <> 0 or sire_name is not null or dam_name is not null)) x where n = 1""")
def extract_listing_rows(t):
    return ex.extract_listing_rows(t.sql(LISTING), BASE)


@query("extract_listing_rows_wide", """
select page_id, 0 as position, cast(page_id - page_id % 3 as string) as dog_id, registered_name as name from (
  select id as page_id, registered_name, row_number() over (partition by id - id % 3 order by id) as n from registry where id % 8 <> 0 and id % 6 <> 0) x where n = 1""")
def extract_listing_rows_wide(t):
    return ex.extract_listing_rows_wide(t("wide_listing_pages"))


@query("extract_listing_cards", f"""
select page_id, 0 as position, regexp_extract(html, '-([a-f0-9-]{{36}})"', 1) as uuid, concat('dog-', cast(page_id as string)) as link_name, n.registered_name,
  case when page_id % 3 = 0 then 'CH' else '' end as prefix_titles, case when page_id % 4 = 0 then 'JW' else '' end as suffix_titles, n.sex, coalesce(n.sire_name, '') as sire_name, coalesce(n.dam_name, '') as dam_name,
  coalesce(n.color, '') as color, n.land_of_birth, cast(year(n.date_of_birth) as int) as year_of_birth, concat(cast(1 + page_id % 28 as string), '/6/2025, 20:24') as modified_at, page_id % 5 = 0 as is_new
from card_pages join registry_named n on n.id = page_id where page_id % 10 <> 0""")
def extract_listing_cards(t):
    return ex.extract_listing_cards(t("card_pages"))


@query("extract_medical_rows", """
select dog_id as page_id, 0 as position, registry, cast(make_date(2020, 1, cast(1 + id % 28 as bigint)) as timestamp) as test_date, cast(null as timestamp) as report_date,
  case when id % 10 = 0 then null else age_in_months end as age_in_months, 'NORMAL' as conclusion, ofa_number from medical_record""")
def extract_medical_rows(t):
    return ex.extract_medical_rows(t("html_medical"))


@query("extract_table_rows", """
select id as page_id, 1 as position, concat('a', cast(id as string)) as name, concat('v ', cast(id % 5 as string)) as value from registry
union all select id, 3, 'b', cast(id % 3 as string) from registry""")
def extract_table_rows(t):
    return ex.extract_table_rows(t("table_pages"), ["name", "value"])


@query("extract_inbreeding_text", "select id as page_id, cast(concat(cast(id % 30 as string), '.5') as double) / 100 as coi from registry")
def extract_inbreeding_text(t):
    text = h.node_text(h.body_with(F.col("html"), "span", "id", "result"))
    return t("record_pages").select("page_id", num.extract_inbreeding_text(text).alias("coi"))


@query("extract_section_links", """
select url, arg_min(page_id, row(page_id, position)) as page_id, arg_min(position, row(page_id, position)) as position, arg_min(name, row(page_id, position)) as name from (
  select id as page_id, 0 as position, concat('http://base/details.php?name=s', cast(id % 6 as string)) as url, 'S' as name from registry
  union all select id, 1, concat('http://base/details.php?name=s', cast(id % 4 as string)), 'T' from registry) x group by url""")
def extract_section_links(t):
    return ex.extract_section_links(t("person_pages"), "siblings", BASE)


LINK_RE = "(?is)<a\\b[^>]*\\bhref\\s*=\\s*[\"''](" + "[^\"'']*)[\"''][^>]*>(.*?)</a>"


@query("extract_page_links", f"""
select page_id, cast(n - 1 as int) as position, href from (
  select page_id, unnest(regexp_extract_all(html, '{LINK_RE}', 1)) as href, unnest(range(1, 1 + len(regexp_extract_all(html, '{LINK_RE}', 1)))) as n from pages) x""")
def extract_page_links(t):
    """All links of the raw page table."""
    return ex.extract_page_links(t.base("pages")).select("page_id", "position", "href")


def decoded(text: str) -> str:
    """SQL that decodes the entities the raw pages use."""
    for entity, character in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"


@query("extract_page_navigation", f"""
select page_id, cast(n - 1 as int) as position, {decoded('href')} as href, trim({decoded('link_text')}) as text from (
  select page_id, unnest(regexp_extract_all({NAV}, '<a href="([^"]*)">(.*?)</a>', 1)) as href, unnest(regexp_extract_all({NAV}, '<a href="([^"]*)">(.*?)</a>', 2)) as link_text,
    unnest(range(1, 1 + len(regexp_extract_all({NAV}, '<a href="([^"]*)">', 1)))) as n from pages) x""")
def extract_page_navigation(t):
    return ex.extract_page_navigation(t.base("pages"))


@query("extract_page_outline", f"""
select page_id, trim({decoded("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}) as heading,
  cast((length(html) - length(replace(html, '<p>', ''))) / 3 as bigint) as paragraphs, trim({decoded("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}) as footer from pages""")
def extract_page_outline(t):
    """Untidy pages: paragraphs and bold text left open, missing end tags, named entities."""
    return ex.extract_page_outline(t.base("pages"))


# --- mapping -------------------------------------------------------------------------------------

@query("map_source_a", """
select id, case when id % 40 = 0 then '' else uuid end as uuid, registered_name, sex, case when id % 9 = 0 then null else cast(year(date_of_birth) as int) end as year_of_birth,
  cast(date_of_birth as timestamp) as date_of_birth, case when id % 5 = 0 then null else cast(id % 40 as double) end as weight, concat('AB', cast(id as string), 'C') as registration_number,
  cast(concat('0.', cast(1 + id % 8 as string)) as double) as coi, land_of_birth, neutered, false as frozen_semen, case when id % 7 <> 0 then concat('http://x/p', cast(id as string), '.jpg') end as photo_url,
  make_timestamp(2024, 1 + id % 12, 1 + id % 28, 8, 10 + id % 50, 0) as modified_at, 'feed_a' as source from registry""")
def map_source_a(t):
    return mp.map_source_a(t("feed_json").select("id", "animal"), "feed_a", "http://x/").select(
        "id", "uuid", "registered_name", "sex", "year_of_birth", "date_of_birth", "weight", "registration_number", "coi", "land_of_birth",
        "neutered", "frozen_semen", "photo_url", "modified_at", "source")


@query("map_source_b", """
select id as page_id, registered_name, coalesce(color, '') as color, coalesce(sire_name, '') as sire_name, coalesce(cast(sire_id as string), '') as sire_link_name, 2 as sex,
  make_date(2000 + id % 20, case when id % 2 = 0 then 5 else 12 end, 1 + id % 28) as born, md5(registered_name) as uuid, 'feed_b' as source from registry_named""")
def map_source_b(t):
    return mp.map_source_b(ex.label_info(t("html_labels"), BASE), "feed_b").select(
        "page_id", "registered_name", "color", "sire_name", "sire_link_name", "sex", F.col("date_of_birth").cast("date").alias("born"), "uuid", "source")


@query("map_source_c", """
select id as page_id, registered_name, concat('JR ', cast(id as string)) as registration_number, coalesce(call_name, 'none') as call_name, sex, coalesce(color, '') as color,
  make_timestamp(2020, 5, 1 + id % 28, 0, 0, 0) as date_of_birth, case when id % 6 = 0 then null else cast(50 + id % 12 as double) end as size,
  concat('CH ', cast(id % 4 as string), case when id % 2 = 0 then '; BOB' else '' end) as other_titles, 'feed_c' as source from registry""")
def map_source_c(t):
    return mp.map_source_c(ex.extract_labelled_table(t("record_pages")), "feed_c").select(
        "page_id", "registered_name", "registration_number", "call_name", "sex", "color", "date_of_birth", "size", "other_titles", "source")


PEOPLE = """
select dog_id as rec_id, name, case when owner_id % 3 = 0 then '' when owner_id % 3 = 1 then null else owner.uuid end as uuid, case when owner_id % 2 = 0 then null else true end as is_main_owner
from dog_owner join owner on owner.id = owner_id"""


@query("map_person", f"select rec_id, coalesce(nullif(uuid, ''), md5(concat('feed_', name))) as uuid, name, coalesce(is_main_owner, false) as is_main_owner from ({PEOPLE}) p")
def map_person(t):
    records = t.sql(PEOPLE).select("rec_id", F.array(F.struct("uuid", "name", "is_main_owner")).alias("owners"))
    return mp.map_person(records, "owners", "is_main_owner", False, "feed_")


@query("map_title", "select dog_id, id as title_id, short_name, long_name, is_prefix, has_winner_year, winner_year from title")
def map_title(t):
    records = t("title").select("dog_id", F.array(F.struct("id", "short_name", "long_name", "is_prefix", "has_winner_year", "winner_year")).alias("titles"))
    return mp.map_title(records)


@query("map_litter", """
select id as page_id, timestamp '2020-12-05 00:00:00' as date_of_birth, cast(id % 4 as int) as litter_male_count, 0 as litter_female_count, 0 as litter_undef_count,
  id + 1 as dam_id, id + 2 as sire_id, cast(null as bigint) as mating_partner_id from registry""")
def map_litter(t):
    scripts = ex.extract_script_json(t("script_pages"))
    litters = scripts.select("page_id", F.explode(F.from_json("litters", F.lit(f"array<{mp.LITTER.simpleString()}>"))).alias("litter"))
    return mp.map_litter(litters)


@query("map_sibling", """
select id, case when id % 40 = 0 then '' else uuid end as uuid, registered_name, sex, case when id % 9 = 0 then null else cast(year(date_of_birth) as int) end as year_of_birth, land_of_birth,
  case when id % 7 <> 0 then concat('http://x/p', cast(id as string), '.jpg') end as photo_url, 'feed_a' as source from registry""")
def map_sibling(t):
    return mp.map_sibling(t("feed_json").select("id", "animal"), "feed_a", "http://x/").select(
        "id", "uuid", "registered_name", "sex", "year_of_birth", "land_of_birth", "photo_url", "source")


@query("overlay_records", """
select id, registered_name as from_detail, case when id % 2 = 0 then cast(null as string) else color end as present_null, land_of_birth as only_listing, 'L' as forced from registry""")
def overlay_records(t):
    detail = F.create_map(F.lit("name"), F.col("registered_name"), F.lit("color"), F.when(F.col("id") % 2 != 0, F.col("color")), F.lit("modified_at"), F.lit("D"))
    listing = F.create_map(F.lit("name"), F.lit("other"), F.lit("color"), F.lit("listed"), F.lit("land"), F.col("land_of_birth"), F.lit("modified_at"), F.lit("L"))
    laid = mp.overlay_records(detail, listing, ["modified_at", "is_new"])
    return t("registry").withColumn("m", laid).select(
        "id", F.col("m")["name"].alias("from_detail"), F.col("m")["color"].alias("present_null"), F.col("m")["land"].alias("only_listing"), F.col("m")["modified_at"].alias("forced"))


@query("view_slim", "select id, uuid, registered_name, call_name, sex, date_of_birth, color, source, has_conflicts, dam_id, sire_id, dam_name, sire_name from registry_ext")
def view_slim(t):
    from ..operators.relations import view_slim as slim

    return slim(t("registry_ext"))


@query("view_tree_node", """
select w.root, w.path, w.node as id, r.registered_name as name, r.sex, r.color, r.registration_number, r.coi from walk w join registry_ext r on r.id = w.node""", {
    "edge": "select id as child, 'S' as letter, sire_id as parent from registry where sire_id is not null union all select id, 'D', dam_id from registry where dam_id is not null",
    "walk": """select id as root, id as node, '' as path, 0 as gen from registry
union all select w.root, e.parent, concat(w.path, e.letter), w.gen + 1 from walk w join edge e on e.child = w.node where w.gen < 2""",
}, recursive=True)
def view_tree_node(t):
    return mp.view_tree_node(anc.lineage_tree(t("registry_ext"), 3)).select(
        "root", "path", "id", "name", "attributes.sex", "attributes.color", "attributes.registration_number", "attributes.coi")


@query("view_status_tags", """
select id, concat_ws('|', case when neutered then 'Neutered' end, case when approved_for_breeding then 'Stud Animal' end, case when frozen_semen then 'Frozen Semen' end,
  case when artificial_insemination then 'AI Available' end) as tags from registry_ext""")
def view_status_tags(t):
    return mp.view_status_tags(t("registry_ext")).select("id", F.array_join("tags", "|").alias("tags"))


@query("view_title_text", """
select id, dog_id, concat(coalesce(long_name, 'null'), ' — ', coalesce(short_name, 'null'), case when has_winner_year and winner_year <> 0 then concat(' (', cast(winner_year as string), ')') else '' end,
  case when is_prefix then ' [Prefix]' else ' [Suffix]' end) as title_text from title""")
def view_title_text(t):
    return mp.view_title_text(t("title"))


@query("view_health_rows", """
select id, 'general' as kind, 'HIP' as name, case when id % 3 = 0 then 'N/A' else 'A' end as value from registry
union all select id, 'genetic', 'DM', case when id % 5 = 0 then concat('n', cast(id as string)) when id % 4 = 0 then 'N/A' else 'clear' end from registry
union all select id, 'genetic', 'PRA', 'carrier' from registry""")
def view_health_rows(t):
    scripts = ex.extract_script_json(t("script_pages"))
    kind = F.lit(mp.HEALTH.simpleString())
    return mp.view_health_rows(scripts.select(
        F.col("page_id").alias("id"), F.from_json("health_screenings", kind).alias("health_info_general"), F.from_json("animal_healthinfos", kind).alias("health_info_genetic")))
