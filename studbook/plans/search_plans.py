"""Search, sorting, paging, joins and aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import aggregates as agg, relations as rel, search as s, text_index
from ..session import settle
from . import query

FLAGS = ["neutered", "approved_for_breeding", "frozen_semen", "artificial_insemination", "is_new"]


@query("filter_search_text", """
select id, registered_name, call_name from registry_ext
where registered_name ilike '%a_c%7%' or registration_number ilike '%a_c%7%' or call_name ilike '%a_c%7%' or sire_name ilike '%a_c%7%' or dam_name ilike '%a_c%7%'""")
def filter_search_text(t):
    return s.filter_search_text(t("registry_ext"), "A_C%7").select("id", "registered_name", "call_name")


INDEXED_TERMS = ["ALL12", "tic 0_%E", "rctic%b", "l1"]


@query("search_text_indexed", " union all ".join(f"""
select '{term}' as term, id, registered_name, call_name from registry_ext
where registered_name ilike '%{term}%' or registration_number ilike '%{term}%' or call_name ilike '%{term}%' or sire_name ilike '%{term}%' or dam_name ilike '%{term}%'"""
                                            for term in INDEXED_TERMS))
def search_text_indexed(t):
    """Rows of several terms, found over stored grams; the last term is too short for a gram."""
    dogs = settle(t("registry_ext"))
    index = text_index.build_index(dogs)
    found = [text_index.search_text(dogs, index, term).select(F.lit(term).alias("term"), "id", "registered_name", "call_name") for term in INDEXED_TERMS]
    return reduce(DataFrame.unionByName, found)


@query("filter_color", "select id, color from registry_ext where color ilike '%build%'")
def filter_color(t):
    return s.filter_color(t("registry_ext"), "Build").select("id", "color")


@query("filter_land_of_birth", "select id, land_of_birth from registry_ext where land_of_birth = 'NATION_7'")
def filter_land_of_birth(t):
    return s.filter_equal(t("registry_ext"), "land_of_birth", "NATION_7").select("id", "land_of_birth")


@query("filter_land_of_standing", "select id, land_of_standing from registry_ext where land_of_standing = 'NATION_3'")
def filter_land_of_standing(t):
    return s.filter_equal(t("registry_ext"), "land_of_standing", "NATION_3").select("id", "land_of_standing")


@query("filter_flags", f"select id, {', '.join(FLAGS)} from registry_ext where neutered = false and frozen_semen = true and is_new = false")
def filter_flags(t):
    kept = s.filter_flags(t("registry_ext"), neutered=False, frozen_semen=True, is_new=False, approved_for_breeding=None)
    return kept.select("id", *FLAGS)


@query("filter_has_photo", "select id, photo_url from registry where photo_url is not null")
def filter_has_photo(t):
    return s.filter_has_photo(t("registry"), True).select("id", "photo_url")


@query("filter_birth_range", "select id, date_of_birth from registry where date_of_birth between date '1990-06-01' and date '2010-01-01'")
def filter_birth_range(t):
    low, high = F.to_date(F.lit("1990-06-01")), F.to_date(F.lit("2010-01-01"))
    return s.filter_range(t("registry"), "date_of_birth", low, high).select("id", "date_of_birth")


@query("filter_death_range", "select id, date_of_death from registry_ext where date_of_death <= date '2005-01-01'")
def filter_death_range(t):
    return s.filter_range(t("registry_ext"), "date_of_death", None, F.to_date(F.lit("2005-01-01"))).select("id", "date_of_death")


@query("filter_modified_range", "select id, modified_at from registry_ext where modified_at >= date '2024-06-01'")
def filter_modified_range(t):
    return s.filter_range(t("registry_ext"), "modified_at", F.to_date(F.lit("2024-06-01"))).select("id", "modified_at")


@query("filter_sex", "select id, sex from registry where sex = 2")
def filter_sex(t):
    return s.filter_equal(t("registry"), "sex", 2).select("id", "sex")


@query("filter_year_range", "select id, year_of_birth from registry_ext where year_of_birth between 1992 and 1996")
def filter_year_range(t):
    return s.filter_range(t("registry_ext"), "year_of_birth", 1992, 1996).select("id", "year_of_birth")


@query("filter_has_conflicts", "select id, has_conflicts from registry_ext where has_conflicts = true")
def filter_has_conflicts(t):
    return s.filter_equal(t("registry_ext"), "has_conflicts", True).select("id", "has_conflicts")


@query("filter_incomplete_identity", "select id from feed_json where animal not like '{\"uuid\":\"\"%'")
def filter_incomplete_identity(t):
    return s.filter_incomplete_identity(t("feed_json").select("id", F.get_json_object("animal", "$.uuid").alias("uuid"))).select("id")


@query("filter_by_owner_name", """
select id, registered_name from registry where id in (select dog_id from dog_owner join owner on owner.id = owner_id where name ilike '%0003%')""")
def filter_by_owner_name(t):
    return s.filter_by_person(t("registry"), t("dog_owner"), t("owner"), "owner_id", "0003").select("id", "registered_name")


@query("filter_by_breeder_name", """
select id, registered_name from registry where id in (select dog_id from dog_breeder join breeder on breeder.id = breeder_id where name ilike '%kennel%0004%')""")
def filter_by_breeder_name(t):
    kept = s.filter_by_person(t("registry"), t("dog_breeder"), t("breeder"), "breeder_id", "kennel%0004")
    return kept.select("id", "registered_name")


@query("registry_search", """
select id, registered_name, color, date_of_birth, sire_name from registry_ext
where (registered_name ilike '%arctic%' or registration_number ilike '%arctic%' or call_name ilike '%arctic%' or sire_name ilike '%arctic%' or dam_name ilike '%arctic%')
  and color ilike '%i%' and date_of_birth between date '1990-01-01' and date '2030-01-01'
  and (neutered = false) and id in (select dog_id from dog_owner join owner on owner.id = owner_id where name ilike '%000%')
order by date_of_birth desc nulls first, id limit 20 offset 20""")
def registry_search(t):
    page = s.registry_search(
        t("registry_ext"), search="arctic", color="I", flags={"neutered": False},
        born=(F.to_date(F.lit("1990-01-01")), F.to_date(F.lit("2030-01-01"))),
        owner=(t("dog_owner"), t("owner"), "000"), sort_by="date_of_birth", sort_order="desc", page=2, per_page=20,
    )
    return page.select("id", "registered_name", "color", "date_of_birth", "sire_name")


# Sorted results carry the position of each row, so the order itself is compared.
@query("sort_dynamic", "select id, call_name, row_number() over (order by call_name asc nulls last, id) as position from registry")
def sort_dynamic(t):
    return s.with_position(s.sort_dynamic(t("registry"), "call_name", "asc")).select("id", "call_name", "position")


@query("sort_presets", "select id, date_of_birth, row_number() over (order by date_of_birth desc nulls first, id) as position from registry")
def sort_presets(t):
    return s.with_position(s.sort_presets(t("registry"), "birth_date_desc")).select("id", "date_of_birth", "position")


@query("page_offset", "select id, registered_name from (select * from registry order by registered_name asc nulls last, id limit 30 offset 60)")
def page_offset(t):
    return s.page_offset(s.sort_dynamic(t("registry"), "registered_name"), 3, 30).select("id", "registered_name")


@query("page_meta", """
select 2 as page, 20 as per_page, total, cast(ceil(total / 20.0) as bigint) as total_pages, 2 < cast(ceil(total / 20.0) as bigint) as has_more
from (select count(id) as total from registry_ext where color ilike '%build%')""")
def page_meta(t):
    return s.page_meta(s.filter_color(t("registry_ext"), "build"), 2, 20)


@query("page_medical", "select id, dog_id, registry, ofa_number from medical_record order by id limit 100 offset 200")
def page_medical(t):
    return s.page_medical(t("medical_record"), 100, 200).select("id", "dog_id", "registry", "ofa_number")


@query("first_match", "select land_of_birth, color, min(id) as id from registry where land_of_birth is not null and color is not null group by land_of_birth, color")
def first_match(t):
    return rel.first_match(t("registry"), "land_of_birth", "color")


@query("join_sire", """
select c.id, c.registered_name, s.registered_name as sire_registered_name_value, s.uuid as sire_uuid_value from registry c left join registry s on c.sire_id = s.id""")
def join_sire(t):
    r = t("registry")
    return rel.join_parent(r, r, "sire", ["registered_name", "uuid"]).select("id", "registered_name", "sire_registered_name_value", "sire_uuid_value")


@query("join_dam", """
select c.id, c.registered_name, s.registered_name as dam_registered_name_value, s.color as dam_color_value from registry c left join registry s on c.dam_id = s.id""")
def join_dam(t):
    r = t("registry")
    return rel.join_parent(r, r, "dam", ["registered_name", "color"]).select("id", "registered_name", "dam_registered_name_value", "dam_color_value")


OFFSPRING = """
select p.id as parent_id, c.id as child_id, 'sire' as role from registry p join registry c on c.sire_id = p.id
union all select p.id, c.id, 'dam' from registry p join registry c on c.dam_id = p.id"""


@query("join_offspring", OFFSPRING)
def join_offspring(t):
    return rel.join_offspring(t("registry"), t("registry"))


@query("join_owners", "select d.id as dog_id, o.id as owner_id, o.name, o.is_main_owner from registry d join dog_owner l on l.dog_id = d.id join owner o on o.id = l.owner_id")
def join_owners(t):
    return rel.join_people(t("registry"), t("dog_owner"), t("owner"), "owner_id").select("dog_id", "owner_id", "name", "is_main_owner")


@query("join_breeders", "select d.id as dog_id, o.id as breeder_id, o.name, o.is_breeder from registry d join dog_breeder l on l.dog_id = d.id join breeder o on o.id = l.breeder_id")
def join_breeders(t):
    return rel.join_people(t("registry"), t("dog_breeder"), t("breeder"), "breeder_id").select("dog_id", "breeder_id", "name", "is_breeder")


@query("join_siblings", "select l.dog_id, l.sibling_id, s.registered_name as sibling_name, s.sex as sibling_sex from sibling_link l join registry s on s.id = l.sibling_id join registry d on d.id = l.dog_id")
def join_siblings(t):
    return rel.join_siblings(t("registry"), t("sibling_link"), t("registry"))


@query("join_titles", "select d.id as dog_id, d.registered_name, t.short_name, t.long_name, t.winner_year from registry d join title t on t.dog_id = d.id")
def join_titles(t):
    return rel.join_records(t("registry"), t("title"), ["short_name", "long_name", "winner_year"])


@query("join_medical_records", "select d.id as dog_id, d.registered_name, m.ofa_number, m.age_in_months from registry d join medical_record m on m.dog_id = d.id")
def join_medical_records(t):
    return rel.join_records(t("registry"), t("medical_record"), ["ofa_number", "age_in_months"])


@query("join_merge_logs", "select d.id as dog_id, d.registered_name, m.log_id, m.field, m.old_value, m.new_value from registry d join merge_log m on m.dog_id = d.id")
def join_merge_logs(t):
    return rel.join_records(t("registry"), t("merge_log"), ["log_id", "field", "old_value", "new_value"])


@query("join_birth_litter", """
select d.id, l.id as birth_litter_id, l.male_count, l.female_count from registry d
left join litter l on l.dam_id = d.dam_id and l.sire_id = d.sire_id and l.date_of_birth = d.date_of_birth""")
def join_birth_litter(t):
    return rel.join_birth_litter(t("registry"), t("litter")).select("id", "birth_litter_id", "male_count", "female_count")


@query("join_litters_by_role", """
select d.id as dog_id, l.id as litter_id, l.date_of_birth, 'dam' as role from registry d join litter l on l.dam_id = d.id
union all select d.id, l.id, l.date_of_birth, 'sire' from registry d join litter l on l.sire_id = d.id""")
def join_litters_by_role(t):
    return rel.join_litters_by_role(t("registry"), t("litter")).select("dog_id", "litter_id", "date_of_birth", "role")


@query("entity_profile", """
select d.id as dog_id, x.relation, x.related_id, x.label from registry d left join (
  select c.id as dog_id, 'sire' as relation, p.id as related_id, p.registered_name as label from registry c join registry p on p.id = c.sire_id
  union all select c.id, 'dam', p.id, p.registered_name from registry c join registry p on p.id = c.dam_id
  union all select dog_id, 'title', id, short_name from title
  union all select dog_id, 'medical_record', id, ofa_number from medical_record
  union all select dog_id, 'merge_log', log_id, field from merge_log
  union all select l.dog_id, 'owner', o.id, o.name from dog_owner l join owner o on o.id = l.owner_id
  union all select l.dog_id, 'breeder', o.id, o.name from dog_breeder l join breeder o on o.id = l.breeder_id
  union all select l.dog_id, 'sibling', o.id, o.registered_name from sibling_link l join registry o on o.id = l.sibling_id
  union all select dam_id, 'litter_as_dam', id, cast(date_of_birth as string) from litter
  union all select sire_id, 'litter_as_sire', id, cast(date_of_birth as string) from litter
  union all select r.id, 'birth_litter', l.id, cast(l.date_of_birth as string) from registry r join litter l
    on l.dam_id = r.dam_id and l.sire_id = r.sire_id and l.date_of_birth = r.date_of_birth
) x on x.dog_id = d.id""")
def entity_profile(t):
    dogs = t("registry")
    return rel.entity_profile(
        dogs, dogs, rel.join_people(dogs, t("dog_owner"), t("owner"), "owner_id"),
        rel.join_people(dogs, t("dog_breeder"), t("breeder"), "breeder_id"),
        t("sibling_link"), t("title"), t("medical_record"), t("litter"), t("merge_log"),
    )


@query("resolve_parent_ids", """
select q.rec_id, s.id as sire_id, d.id as dam_id from
  (select id as rec_id, case when id % 3 = 0 then 'missing' else md5(concat('dog_', cast(id - 20 as string))) end as sire_uuid, md5(concat('dog_', cast(id - 9 as string))) as dam_uuid from registry) q
left join registry s on s.uuid = q.sire_uuid left join registry d on d.uuid = q.dam_uuid""")
def resolve_parent_ids(t):
    records = t.sql("""
        select id as rec_id, case when id % 3 = 0 then 'missing' else md5(concat('dog_', cast(id - 20 as string))) end as sire_uuid,
          md5(concat('dog_', cast(id - 9 as string))) as dam_uuid from registry""")
    return rel.resolve_parent_ids(records, t("registry")).select("rec_id", "sire_id", "dam_id")


REQUESTS = """
select id as request_id, case when id % 4 = 0 then 'none' else concat('RN ', cast(id as string)) end as registration_number,
  case when id % 3 = 0 then 'nobody' else registered_name end as registered_name,
  concat('OFA-', cast(id % 90 as string), '-', cast(id % 97 as string)) as ofa_number from registry"""


@query("join_medical_search", f"""
select q.request_id, coalesce(n.id, m.id, c.id) as found_id,
  case when n.id is not null then 'registration_number' when m.id is not null then 'name' when c.id is not null then 'certificate' end as found_by
from ({REQUESTS}) q
left join (select registration_number, min(id) as id from registry_ext group by 1) n on n.registration_number = q.registration_number
left join (select registered_name, min(id) as id from registry_ext group by 1) m on m.registered_name = q.registered_name
left join (select ofa_number, min(dog_id) as id from medical_record group by 1) c on c.ofa_number = q.ofa_number""")
def join_medical_search(t):
    found = rel.join_medical_search(t.sql(REQUESTS), t("registry_ext"), t("medical_record"))
    return found.select("request_id", "found_id", "found_by")


@query("agg_total_count", "select count(id) as total from registry_ext where color ilike '%build%'")
def agg_total_count(t):
    return s.agg_total_count(s.filter_color(t("registry_ext"), "build"))


CHILDREN = f"select o.parent_id, o.child_id, r.date_of_birth, r.sex, r.registered_name from ({OFFSPRING}) o join registry r on r.id = o.child_id"


@query("agg_litters_by_birth", f"""
select parent_id, date_of_birth, count(*) filter (where sex = 1) as male_count, count(*) filter (where sex = 2) as female_count,
  count(*) filter (where coalesce(sex, 0) not in (1, 2)) as undefined_count, count(*) as puppy_count
from ({CHILDREN}) c where date_of_birth is not null group by parent_id, date_of_birth""")
def agg_litters_by_birth(t):
    return agg.agg_litters_by_birth(_children(t))


def _children(t):
    facts = t("registry").select(F.col("id").alias("child_id"), "date_of_birth", "sex", "registered_name")
    return rel.join_offspring(t("registry"), t("registry")).join(facts, "child_id")


@query("agg_offspring_by_birth", f"select parent_id, date_of_birth, child_id as puppy_id from ({CHILDREN}) c where date_of_birth is not null")
def agg_offspring_by_birth(t):
    return agg.litter_puppies(_children(t))


@query("agg_litter_first_per_date", f"""
select parent_id, date_of_birth, child_id, registered_name from (
  select c.*, row_number() over (partition by parent_id, date_of_birth order by child_id) as n from ({CHILDREN}) c) x where n = 1""")
def agg_litter_first_per_date(t):
    listed = _children(t).select("parent_id", "date_of_birth", "child_id", "registered_name", F.col("child_id").alias("position"))
    return agg.agg_litter_first_per_date(listed).select("parent_id", "date_of_birth", "child_id", "registered_name")


@query("agg_batch_outcome", "select count(*) as attempted, count(*) filter (where num_text <> '' and num_text <> 'n/a') as succeeded, count(*) filter (where num_text in ('', 'n/a')) as failed from raw_values")
def agg_batch_outcome(t):
    return agg.agg_batch_outcome(t("raw_values"), ~F.col("num_text").isin("", "n/a"))


@query("agg_success_rate", """
select attempted, succeeded, failed, case when attempted > 0 then printf('%.1f%%', succeeded / attempted * 100) else '0%' end as success_rate from (
  select count(*) as attempted, count(*) filter (where date_text <> 'unknown') as succeeded, count(*) filter (where date_text = 'unknown') as failed from raw_values) o""")
def agg_success_rate(t):
    return agg.agg_success_rate(agg.agg_batch_outcome(t("raw_values"), F.col("date_text") != "unknown"))


@query("agg_join_text", """
select id, nullif(concat_ws('; ', nullif(color, ''), nullif(color_marking, ''), nullif(notes, '')), '') as joined from registry_ext""")
def agg_join_text(t):
    return t("registry_ext").select("id", agg.agg_join_text(F.array("color", "color_marking", "notes"), "; ").alias("joined"))


@query("set_concat_pages", """
select * from (select id, registered_name from registry where neutered) a union all select * from (select id, registered_name from registry where color is null) b""")
def set_concat_pages(t):
    r = t("registry")
    return r.filter("neutered").select("id", "registered_name").unionByName(r.filter("color is null").select("id", "registered_name"))


@query("set_distinct_seen", "select distinct uuid from listing_feed")
def set_distinct_seen(t):
    return t("listing_feed").select("uuid").dropDuplicates(["uuid"])
