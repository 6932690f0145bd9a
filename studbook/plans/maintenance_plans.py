"""Sources, sinks, upserts, incremental refresh and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.dates import parse_datetime_listing
from ..functions.rows import stack_rows
from ..operators import incremental as inc, ingest as ing, matching as mat, upsert as up
from ..session import new_folder, settle
from ..sources import feeds, schema as sc, sinks
from ..sources.bucketed import BucketedTable
from ..streaming import listing as ls
from . import query
from .resolve_plans import CASCADE, fill_sql
from .search_plans import REQUESTS

AS_OF = "2024-01-20 12:00:00"


# --- sources and sinks ---------------------------------------------------------------------------

ENTITIES = {
    "dog": "select * from registry_ext",
    "dogsiblinglink": "select * from sibling_link",
    "dogbreederlink": "select * from dog_breeder",
    "dogownerlink": "select * from dog_owner",
    "breeder": "select * from breeder",
    "owner": "select * from owner",
    "litter": "select id, date_of_birth, sire_id, dam_id, cast(male_count as int) as litter_male_count from litter",
    "title": "select * from title",
    "medical_record": "select * from medical_record",
    "mergelog": "select log_id * 2 + case when field = 'color' then 0 else 1 end as id, dog_id from merge_log",
}


@query("src_entity_tables", "\nunion all ".join(
    f"select '{name}' as table_name, count(*) as row_count, cast(sum({'id' if 'id bigint' in sc.TABLES[name].split(', ') else 'dog_id'}) as bigint) as key_sum from ({sql}) s"
    for name, sql in ENTITIES.items()))
def src_entity_tables(t):
    """Write the ten tables, then load them with their fixed schemas."""
    root = new_folder(t.spark, "entities")
    for name, sql in ENTITIES.items():
        sc.conform(t.sql(sql), name).write.parquet(f"{root}/{name}")
    loaded = sc.entity_tables(t.spark, root)
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("row_count"), F.sum("id" if "id" in df.columns else "dog_id").alias("key_sum")).withColumn("table_name", F.lit(name))
        for name, df in loaded.items()])


FEED = "select id as batch_id, concat('{\"animals\":[', animal, ',{\"uuid\":\"extra', cast(id as string), '\",\"deep\":{\"a\":[1,2]}}],\"has_more\":true}') as body from feed_json"


@query("src_listing_feed", """
select id as batch_id, 0 as position, case when id % 40 = 0 then '' else uuid end as uuid, sex, cast(null as string) as deep from registry
union all select id, 1, concat('extra', cast(id as string)), null, '{"a":[1,2]}' from registry""")
def src_listing_feed(t):
    animal = F.col("animal")
    return feeds.listing_feed(t.sql(FEED)).select(
        "batch_id", "position", F.get_json_object(animal, "$.uuid").alias("uuid"), F.get_json_object(animal, "$.sex").try_cast("int").alias("sex"),
        F.get_json_object(animal, "$.deep").alias("deep"))


DOCS = """
select r.id as root, concat('{"uuid":"', r.uuid, '"', case when s.id is null then '' else concat(',"sire":{"uuid":"', s.uuid, '"',
  case when sd.id is null then '' else concat(',"dam":{"uuid":"', sd.uuid, '"}') end, '}') end,
  case when d.id is null then ',"dam":null' else concat(',"dam":{"uuid":"', d.uuid, '"}') end, '}') as body
from registry r left join registry s on s.id = r.sire_id left join registry sd on sd.id = s.dam_id left join registry d on d.id = r.dam_id"""


@query("src_nested_ancestor_docs", """
select id as root, '' as path, uuid from registry
union all select r.id, 'S', s.uuid from registry r join registry s on s.id = r.sire_id
union all select r.id, 'SD', sd.uuid from registry r join registry s on s.id = r.sire_id join registry sd on sd.id = s.dam_id
union all select r.id, 'D', d.uuid from registry r join registry d on d.id = r.dam_id""")
def src_nested_ancestor_docs(t):
    return feeds.nested_ancestor_docs(t.sql(DOCS)).select("root", "path", F.get_json_object("animal", "$.uuid").alias("uuid"))


@query("src_raw_pages", "select page_id, url, length(html) as size from pages")
def src_raw_pages(t):
    return feeds.raw_pages(t.spark, f"{t.folder}/pages.parquet").select("page_id", "url", F.length("html").cast("bigint").alias("size"))


@query("sink_json_documents", """
select id, concat('{"id":', cast(id as string), ',"registered_name":"', registered_name, '","color":', case when color is null then 'null' else concat('"', color, '"') end,
  ',"date_of_birth":"', cast(date_of_birth as string), '"}') as document from registry""")
def sink_json_documents(t):
    return sinks.json_documents(t("registry").select("id", "registered_name", "color", "date_of_birth"))


@query("sink_json_documents_files", "select count(*) as documents, count(color) as colors from registry")
def sink_json_documents_files(t):
    path = new_folder(t.spark, "documents")
    sinks.write_json_documents(t("registry").select("id", "registered_name", "color", "date_of_birth"), path)
    lines = t.spark.read.text(path)
    return lines.agg(F.count_if(F.contains("value", F.lit('"color":'))).alias("documents"), F.count(F.get_json_object("value", "$.color")).alias("colors"))


@query("sink_snapshot", "select id, coalesce(case when id % 2 = 0 then 'patched' end, color) as color from registry")
def sink_snapshot(t):
    root = new_folder(t.spark, "registry")
    sinks.publish_snapshot(t("registry").select("id", "color"), root, 1)
    held = sinks.read_snapshot(t.spark, root)
    changed = held.withColumn("color", F.when(F.col("id") % 2 == 0, "patched").otherwise(F.col("color")))
    sinks.publish_snapshot(changed, root, 2)
    return sinks.read_snapshot(t.spark, root)


# --- upserts -------------------------------------------------------------------------------------

PERSON_BATCH = """
select c_custkey as position, concat('Person ', cast(c_custkey as string)) as name, c_custkey % 2 = 1 as is_main_owner,
  case when c_custkey % 3 = 0 then md5(concat('new', cast(c_custkey % 200 as string))) else md5(concat('Supplier#', lpad(cast(c_custkey % 40 as string), 9, '0'))) end as uuid from customer"""


def people_sql(update: bool) -> str:
    pick = "arg_max" if update else "arg_min"
    chosen = f"select uuid, {pick}(name, position) as name, {pick}(is_main_owner, position) as is_main_owner from ({PERSON_BATCH}) b group by uuid"
    name, flag = ("coalesce(b.name, o.name)", "coalesce(b.is_main_owner, o.is_main_owner)") if update else ("o.name", "o.is_main_owner")
    fresh = f"select * from ({chosen}) f where f.uuid not in (select uuid from owner)"
    return f"""
select o.id, {name} as name, o.uuid, {flag} as is_main_owner from owner o left join ({chosen}) b on b.uuid = o.uuid
union all select (select max(id) from owner) + row_number() over (order by md5(concat(cast(length(uuid) as string), ':', uuid))), name, uuid, is_main_owner from ({fresh}) g"""


@query("upsert_people", people_sql(True))
def upsert_people(t):
    return up.upsert_people(t("owner"), t.sql(PERSON_BATCH), update=True).select("id", "name", "uuid", "is_main_owner")


@query("upsert_people_insert_only", people_sql(False))
def upsert_people_insert_only(t):
    return up.upsert_people(t("owner"), t.sql(PERSON_BATCH), update=False).select("id", "name", "uuid", "is_main_owner")


TITLE_BATCH = """
select dog_id, short_name, long_name, true as has_winner_year, 2030 + cast(id % 5 as int) as winner_year, id as position from title where id % 2 = 0
union all select dog_id, short_name, long_name, false, 2040, id + 1000000000 from title where id % 4 = 0
union all select dog_id, 'NEW', long_name, true, 2050, id from title where id % 5 = 0"""


@query("upsert_titles", """
select t.dog_id, t.short_name, t.long_name, case when t.id % 4 = 0 then false when t.id % 2 = 0 then true else t.has_winner_year end as has_winner_year,
  case when t.id % 4 = 0 then 2040 when t.id % 2 = 0 then 2030 + cast(t.id % 5 as int) else t.winner_year end as winner_year from title t
union all select dog_id, 'NEW', long_name, true, 2050 from title where id % 5 = 0""")
def upsert_titles(t):
    return up.upsert_titles(t("title"), t.sql(TITLE_BATCH)).select("dog_id", "short_name", "long_name", "has_winner_year", "winner_year")


@query("upsert_titles_ids", """
select count(*) as n, count(distinct id) as distinct_ids, max(id) as top from (
  select id from title union all select (select max(id) from title) + row_number() over () from title where id % 5 = 0) x""")
def upsert_titles_ids(t):
    new = up.upsert_titles(t("title"), t.sql(TITLE_BATCH))
    return new.agg(F.count("*").alias("n"), F.count_distinct("id").alias("distinct_ids"), F.max("id").alias("top"))


LITTER_BATCH = """
select dam_id, sire_id, date_of_birth, male_count + 10 as male_count, female_count, id as position from litter where id % 2 = 0
union all select dam_id, sire_id, date_of_birth + 1000, 1, 2, id from litter where id % 3 = 0
union all select dam_id, cast(null as bigint), date_of_birth, 3, 4, id from litter where id % 5 = 0"""


ORACLE_LITTERS = f"""
select l.dam_id, l.sire_id, l.date_of_birth, coalesce(b.male_count, l.male_count) as male_count, coalesce(b.female_count, l.female_count) as female_count
from litter l left join ({LITTER_BATCH}) b on b.dam_id = l.dam_id and b.sire_id = l.sire_id and b.date_of_birth = l.date_of_birth
union all select dam_id, sire_id, date_of_birth, arg_max(male_count, position), arg_max(female_count, position) from ({LITTER_BATCH}) b
where not exists (select 1 from litter l where l.dam_id = b.dam_id and l.sire_id = b.sire_id and l.date_of_birth = b.date_of_birth) group by 1, 2, 3"""


@query("upsert_litters", ORACLE_LITTERS)
def upsert_litters(t):
    return up.upsert_litters(t("litter"), t.sql(LITTER_BATCH)).select("dam_id", "sire_id", "date_of_birth", "male_count", "female_count")


MEDICAL_BATCH = """
select dog_id, case when id % 7 = 0 then null else ofa_number end as ofa_number, concat('new_', registry) as registry, age_in_months + 100 as age_in_months, id as position from medical_record where id % 3 = 0
union all select dog_id + 1, concat(ofa_number, 'x'), registry, age_in_months, id + 1000000000 from medical_record where id % 10 = 0"""


ORACLE_MEDICAL = f"""
select m.id, m.dog_id, m.ofa_number, coalesce(b.registry, m.registry) as registry, coalesce(b.age_in_months, m.age_in_months) as age_in_months
from medical_record m left join (select dog_id, ofa_number, min(id) as id from medical_record group by 1, 2) f on f.id = m.id
left join (select dog_id, ofa_number, arg_max(registry, position) as registry, arg_max(age_in_months, position) as age_in_months from ({MEDICAL_BATCH}) x group by 1, 2) b
  on f.id is not null and b.dog_id = m.dog_id and b.ofa_number is not distinct from m.ofa_number
union all select (select max(id) from medical_record) + row_number() over (order by md5(concat(cast(length(cast(dog_id as string)) as string), ':', cast(dog_id as string), '|',
    case when ofa_number is null then '-' else concat(cast(length(ofa_number) as string), ':', ofa_number) end))), dog_id, ofa_number, registry, age_in_months from (
  select dog_id, ofa_number, arg_max(registry, position) as registry, arg_max(age_in_months, position) as age_in_months from ({MEDICAL_BATCH}) x group by 1, 2) b
where not exists (select 1 from medical_record m where m.dog_id = b.dog_id and m.ofa_number is not distinct from b.ofa_number)"""


@query("upsert_medical", ORACLE_MEDICAL)
def upsert_medical(t):
    return up.upsert_medical(t("medical_record"), t.sql(MEDICAL_BATCH)).select("id", "dog_id", "ofa_number", "registry", "age_in_months")


def _bucketed(t, name, table, keys, batch, run, columns):
    stored = BucketedTable(t.spark, new_folder(t.spark, name), keys, buckets=16)
    stored.create(table)
    stored.apply(settle(batch), run)
    return stored.read().select(*columns)


@query("upsert_medical_buckets", ORACLE_MEDICAL)
def upsert_medical_buckets(t):
    """The same batch against a table stored by buckets of its key."""
    return _bucketed(t, "medical", t("medical_record"), ("dog_id", "ofa_number"), t.sql(MEDICAL_BATCH), lambda rows, batch, top: up.upsert_medical(rows, batch, top=top),
                     ["id", "dog_id", "ofa_number", "registry", "age_in_months"])


@query("upsert_litters_buckets", ORACLE_LITTERS)
def upsert_litters_buckets(t):
    return _bucketed(t, "litters", t("litter"), ("dam_id", "sire_id", "date_of_birth"), t.sql(LITTER_BATCH), lambda rows, batch, top: up.upsert_litters(rows, batch, top=top),
                     ["dam_id", "sire_id", "date_of_birth", "male_count", "female_count"])


@query("upsert_registry", f"""
select r.id, r.uuid, {fill_sql('registered_name')}, {fill_sql('weight', True)}, {fill_sql('color')} from registry_named r
union all select (select max(id) from registry_named) + row_number() over (order by md5(uuid)), uuid, registered_name, weight, color from incoming
where rec_id in (select rec_id from matched where matched_id is null)""", CASCADE)
def upsert_registry(t):
    registry, records = t.stored("registry_named"), t.stored("incoming")
    return up.upsert_registry(registry, records, mat.match_cascade(records, registry)).select("id", "uuid", "registered_name", "weight", "color")


# --- a whole batch of pages ------------------------------------------------------------------------

INGEST = {
    "new_level": """
select page_id, max(level) as level from (
  with recursive walk(page_id, level) as (
    select page_id, 0 from ingest_facts where is_new and copy = 0
    union select c.page_id, w.level + 1 from walk w join ingest_facts c on (c.sire_id = w.page_id or c.dam_id = w.page_id) and c.is_new and c.copy = 0)
  select * from walk) x group by page_id""",
    "animal": """
select f.*, case when is_new then n.new_id else f.id end as animal_id from ingest_facts f left join (
  select page_id, (select max(id) from registry) + row_number() over (order by level, md5(concat(md5(concat('s', cast(page_id as varchar))), ' rec ', cast(page_id as varchar)))) as new_id from new_level) n
  on n.page_id = f.id""",
    "told": """
select a.animal_id, a.is_new, a.copy, a.name, a.color, s.name as sire_name, d.name as dam_name, r.color as r_color, r.sire_name as r_sire, r.dam_name as r_dam, l.color as l_color, l.name as l_name
from animal a left join ingest_facts s on s.page_id = a.sire_id left join ingest_facts d on d.page_id = a.dam_id
left join registry_named r on r.id = a.id left join ingest_facts l on l.page_id = a.id""",
    "differs": """
select animal_id, 'color' as field, r_color as old, color as new, 'source_a' as source from told where not is_new and r_color <> '' and color <> '' and r_color <> color
union all select animal_id, 'sire_name', r_sire, sire_name, 'source_a' from told where not is_new and r_sire <> sire_name
union all select animal_id, 'dam_name', r_dam, dam_name, 'source_a' from told where not is_new and r_dam <> dam_name
union all select animal_id, 'color', l_color, color, 'source_b' from told where is_new and copy > 0 and l_color <> '' and l_color <> color
union all select animal_id, 'registered_name', l_name, name, 'source_b' from told where is_new and copy = 2""",
}


@query("ingest_pages", """
select 'animal' as part, id, cast(null as bigint) as other_id, concat(name, '/', color) as text, cast(id in (select animal_id from differs) as bigint) as number from (
  select r.id, r.registered_name as name, case when coalesce(r.color, '') = '' then a.color else r.color end as color from registry r join animal a on a.page_id = r.id where true
  union all select a.animal_id, a.name, case when a.color = '' then coalesce(c.color, '') else a.color end from animal a left join ingest_facts c on c.id = a.id and c.copy > 0 where a.is_new and a.copy = 0) x
union all select 'parent', c.animal_id, p.animal_id, 'sire', null from animal c join animal p on p.page_id = c.sire_id where c.copy = 0
union all select 'parent', c.animal_id, p.animal_id, 'dam', null from animal c join animal p on p.page_id = c.dam_id where c.copy = 0
union all select 'parent', id, sire_id, 'sire', null from registry where id % 3 = 0 and sire_id is not null
union all select 'parent', id, dam_id, 'dam', null from registry where id % 3 = 0 and dam_id is not null
union all select 'owner', animal_id, null, owner, null from animal where owner <> ''
union all select 'owner', animal_id, null, 'Second Owner', null from animal where owner <> '' and id % 4 = 0
union all select 'owner', l.dog_id, null, o.name, null from dog_owner l join owner o on o.id = l.owner_id where l.dog_id % 10 = 9 or l.dog_id % 3 = 0 or l.dog_id not in (select id from registry)
union all select 'breeder', animal_id, null, breeder, null from animal where breeder <> ''
union all select distinct 'sibling', id, other_id, null, cast(null as bigint) from (
  select a.animal_id as id, b.animal_id as other_id from animal a join animal b on b.page_id = a.id + 1 where a.copy = 0 and a.id % 4 = 1 union select dog_id, sibling_id from sibling_link) y
union all select 'litter', p.animal_id, null, cast(c.born as varchar), sum(case when c.sex = 1 then 1000 else 1 end)::bigint from animal c join animal p on p.page_id = c.dam_id where c.dam_id % 7 = 0 group by 2, 4
union all select 'puppy', c.animal_id, p.animal_id, cast(c.born as varchar), null from animal c join animal p on p.page_id = c.dam_id where c.dam_id % 7 = 0
union all select 'conflict', animal_id, null, concat(field, '/', source, '/', case when source = 'source_b' then new else old end), null from differs
union all select 'conflict', animal_id, null, concat(field, '/source_b/', new), null from differs where source = 'source_a'""", INGEST, recursive=True)
def ingest_pages(t):
    people = "cast(null as bigint) as id, cast(null as string) as name, cast(null as string) as uuid"
    state = ing.State(
        t.stored("registry_named"), t.sql("select id, name, uuid, is_main_owner from owner"), t.sql(f"select {people}, true as is_breeder from nation where false"),
        t.sql("select dog_id, owner_id as person_id from dog_owner"), t.sql("select cast(null as bigint) as dog_id, cast(null as bigint) as person_id from nation where false"),
        t("sibling_link"), t("litter"), t.sql("select cast(null as bigint) as id, '' as field, '' as source, '' as value from nation where false"))
    after, _ = ing.ingest(state, ing.read_pages(t.stored("ingest_pages"), "http://b/", "source_b"))
    nothing, none = F.lit(None).cast("bigint"), F.lit(None).cast("string")

    def part(name, frame, key, other=nothing, text=none, number=nothing):
        return frame.select(F.lit(name).alias("part"), F.col(key).alias("id"), other.cast("bigint").alias("other_id"), text.alias("text"), number.cast("bigint").alias("number"))

    dogs, litters = settle(after.registry), settle(after.litters.where("sire_id is null"))
    parents = dogs.select("id", stack_rows(["text", "other"], (F.lit("sire"), F.col("sire_id")), (F.lit("dam"), F.col("dam_id")))).where("other is not null")
    puppies = dogs.join(litters.select(F.col("id").alias("birth_litter_id"), "dam_id", F.col("date_of_birth").alias("litter_date")).withColumnRenamed("dam_id", "litter_dam"), "birth_litter_id")
    people_links = [part(role, links.join(table.select(F.col("id").alias("person_id"), "name"), "person_id"), "dog_id", text=F.col("name"))
                    for role, links, table in (("owner", after.owner_links, after.owners), ("breeder", after.breeder_links, after.breeders))]
    parts = [
        part("animal", dogs, "id", text=F.concat("registered_name", F.lit("/"), F.coalesce("color", F.lit(""))), number=F.col("has_conflicts").cast("int")),
        part("parent", parents, "id", F.col("other"), F.col("text")), *people_links, part("sibling", after.siblings, "dog_id", F.col("sibling_id")),
        part("litter", litters, "dam_id", text=F.col("date_of_birth").cast("string"), number=F.col("male_count") * 1000 + F.col("female_count")),
        part("puppy", puppies, "id", F.col("litter_dam"), F.col("litter_date").cast("string")),
        part("conflict", after.conflicts, "id", text=F.concat_ws("/", "field", "source", "value"))]
    return reduce(DataFrame.unionByName, parts)


OVERWRITES = "select rec_id as id, color, weight, cast(rec_id - 1 as bigint) as sire_id, cast(null as bigint) as dam_id from incoming"


@query("update_overwrite", f"""
select r.id, case when o.id is not null then o.color else r.color end as color, case when o.id is not null and o.id % 2 = 0 then o.weight else r.weight end as weight,
  case when o.id is not null then o.sire_id else r.sire_id end as sire_id, case when o.id is not null then null else r.dam_id end as dam_id
from registry r left join ({OVERWRITES}) o on o.id = r.id""")
def update_overwrite(t):
    records = t.sql(OVERWRITES).withColumn("set_columns", F.when(F.col("id") % 2 == 0, F.array(F.lit("color"), F.lit("weight"))).otherwise(F.array(F.lit("color"))))
    return up.update_overwrite(t("registry"), records, ["color", "weight"], "set_columns").select("id", "color", "weight", "sire_id", "dam_id")


LINKS = "select dog_id, owner_id + 1 as owner_id from dog_owner where dog_id % 10 = 0"


@query("link_people", f"select dog_id, owner_id from dog_owner where dog_id not in (select dog_id from ({LINKS}) n) union all select distinct dog_id, owner_id from ({LINKS}) m")
def link_people(t):
    return up.link_people(t("dog_owner"), t.sql(LINKS))


SIBLINGS = "select sibling_id as dog_id, dog_id as sibling_id from sibling_link union all select dog_id, sibling_id from sibling_link where dog_id % 2 = 0"


@query("link_siblings", f"select dog_id, sibling_id from sibling_link union select dog_id, sibling_id from ({SIBLINGS}) n")
def link_siblings(t):
    return up.link_siblings(t("sibling_link"), t.sql(SIBLINGS))


PUPPIES = """
select r.id as puppy_id, l.id as litter_id from registry r join litter l on l.dam_id = r.dam_id and l.sire_id = r.sire_id and l.date_of_birth = r.date_of_birth"""


@query("link_puppies", f"select r.id, p.litter_id as birth_litter_id from registry r left join ({PUPPIES}) p on p.puppy_id = r.id")
def link_puppies(t):
    return up.link_puppies(t("registry"), t.sql(PUPPIES)).select("id", "birth_litter_id")


PARENT_LITTERS = "select id, date_of_birth, case when id % 2 = 0 then sire_id else dam_id end as parent_id, cast(null as bigint) as sire_id, cast(null as bigint) as dam_id from litter"


@query("link_puppies_parent", "select id, case when id % 2 = 0 then sire_id end as sire_id, case when id % 2 = 1 then dam_id end as dam_id from litter")
def link_puppies_parent(t):
    return up.set_litter_parent(t.sql(PARENT_LITTERS), t("registry")).select("id", "sire_id", "dam_id")


PARENTS = "select id, case when id % 2 = 0 then cast(1 as bigint) end as sire_id, case when id % 3 = 0 then cast(2 as bigint) end as dam_id from registry where id % 4 = 0"


@query("link_parents", f"select r.id, coalesce(p.sire_id, r.sire_id) as sire_id, coalesce(p.dam_id, r.dam_id) as dam_id from registry r left join ({PARENTS}) p on p.id = r.id")
def link_parents(t):
    return up.link_parents(t("registry"), t.sql(PARENTS)).select("id", "sire_id", "dam_id")


PATCHES = "select id, case when id % 2 = 0 then concat('patched ', cast(id as string)) end as notes, 'checked' as data_correctness_notes from registry where id % 4 < 2"


@query("patch_notes", f"select r.id, coalesce(p.notes, r.notes) as notes, p.data_correctness_notes from registry_ext r left join ({PATCHES}) p on p.id = r.id")
def patch_notes(t):
    return up.patch_notes(t("registry_ext"), t.sql(PATCHES)).select("id", "notes", "data_correctness_notes")


@query("delete_medical", "select id, dog_id, ofa_number from medical_record where id not in (select l_orderkey from lineitem)")
def delete_medical(t):
    ids = t.base("lineitem").select(F.col("l_orderkey").alias("id"))
    return up.delete_medical(t("medical_record"), ids).select("id", "dog_id", "ofa_number")


@query("medical_for_animals", "select id, dog_id, ofa_number from medical_record where dog_id in (select rec_id from incoming)")
def medical_for_animals(t):
    return up.medical_for_animals(t("medical_record"), t("incoming").select(F.col("rec_id").alias("id"))).select("id", "dog_id", "ofa_number")


FOUND = f"""
select q.request_id, q.dog_id, coalesce(n.id, m.id, c.id) as found_id from (select r.*, request_id + 5000000 as dog_id from ({REQUESTS}) r) q
left join (select registration_number, min(id) as id from registry_ext group by 1) n on n.registration_number = q.registration_number
left join (select registered_name, min(id) as id from registry_ext group by 1) m on m.registered_name = q.registered_name
left join (select ofa_number, min(dog_id) as id from medical_record group by 1) c on c.ofa_number = q.ofa_number"""


@query("medical_batch", f"""
select f.request_id, f.found_id is not null as success, count(r.id) as records_count from ({FOUND}) f left join medical_record r on r.dog_id = f.found_id group by 1, 2""")
def medical_batch(t):
    return _medical_batch(t)[1].select("request_id", "success", "records_count")


def _medical_batch(t):
    requests = t.sql(f"select r.*, request_id + 5000000 as dog_id from ({REQUESTS}) r")
    records = t("medical_record")
    results = records.select(F.col("dog_id").alias("found_id"), F.col("id").alias("position"), "registry", "test_date", "age_in_months", "ofa_number")
    return up.medical_batch(requests, t("registry_ext"), records, results)


@query("medical_batch_records", f"""
select dog_id, ofa_number, registry from medical_record
union all select f.dog_id, r.ofa_number, arg_max(r.registry, r.id) from ({FOUND}) f join medical_record r on r.dog_id = f.found_id group by 1, 2""")
def medical_batch_records(t):
    return _medical_batch(t)[0].select("dog_id", "ofa_number", "registry")


# --- incremental and streaming -------------------------------------------------------------------

SQL_TS = "try_strptime(modified_text, '%d/%m/%Y, %H:%M')"


@query("incr_recent_window", f"select pos, uuid, modified_text from listing_feed where {SQL_TS} is null or {SQL_TS} >= timestamp '{AS_OF}' - interval 5 day")
def incr_recent_window(t):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return inc.incr_recent_window(t("listing_feed"), as_of, 5).select("pos", "uuid", "modified_text")


@query("incr_take_until_cutoff", f"""
select pos, uuid, modified_text from listing_feed where pos < coalesce((select min(pos) from listing_feed where {SQL_TS} < timestamp '{AS_OF}' - interval 5 day), 9223372036854775807)""")
def incr_take_until_cutoff(t):
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    return inc.incr_take_until_cutoff(t("listing_feed"), as_of, 5).select("pos", "uuid", "modified_text")


@query("incr_capped_refresh", """
select * from (select id, 'feed_a' as feed from registry order by id limit 100) a union all select * from (select id, 'feed_b' from title order by id limit 50) b
union all select * from (select id, 'feed_c' from medical_record order by id limit 26) c""")
def incr_capped_refresh(t):
    return inc.incr_capped_refresh({
        "feed_a": (t("registry").select("id"), 100), "feed_b": (t("title").select("id"), 50), "feed_c": (t("medical_record").select("id"), 26)})


def _arrivals(t):
    """The listing as a folder of files, taken in one file per micro-batch."""
    folder = new_folder(t.spark, "arrivals")
    feed = t("listing_feed")
    feed.repartition(4, "pos").write.parquet(folder)
    return ls.file_stream(t.spark, folder, feed.schema, files_per_batch=1)


@query("stream_listing_upsert", f"""
select r.id, r.uuid, l.status, l.value from registry r left join (
  select uuid, arg_max(status, row({SQL_TS} is not null, coalesce({SQL_TS}, timestamp '1900-01-01'), pos)) as status,
    arg_max(value, row({SQL_TS} is not null, coalesce({SQL_TS}, timestamp '1900-01-01'), pos)) as value from listing_feed group by uuid) l on l.uuid = r.uuid""")
def stream_listing_upsert(t):
    root = new_folder(t.spark, "listing")
    modified = parse_datetime_listing(F.col("modified_text"))
    arrivals = _arrivals(t)
    ls.stream_listing(arrivals, root, modified, "pos")
    latest = ls.current_listing(t.spark, root, arrivals.schema)
    return ls.upsert_from_listing(t("registry"), latest, ["status", "value"]).select("id", "uuid", "status", "value")


@query("stream_dedupe", "select distinct uuid from listing_feed")
def stream_dedupe(t):
    root = new_folder(t.spark, "seen")
    ls.stream_distinct(_arrivals(t).select("uuid"), root, "uuid")
    return t.spark.read.parquet(f"{root}/rows")
