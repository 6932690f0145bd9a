"""Matching, conflicts, merging, resolution and undo."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..operators import conflicts as con, matching as mat
from . import query


def lowest(key: str) -> str:
    return f"(select {key}, min(id) as id from registry_named where {key} is not null group by {key})"


EXACT = f"select i.rec_id, m.id as matched_id from incoming i join {lowest('registered_name')} m on m.registered_name = i.registered_name"
UUID = f"select i.rec_id, m.id as matched_id from incoming i join {lowest('uuid')} m on m.uuid = i.uuid"
BIRTH = """
select i.rec_id, min(r.id) as matched_id from incoming i join registry_named r on r.date_of_birth = i.date_of_birth
  and (coalesce(i.sire_name, '') = '' or r.sire_name = i.sire_name) and (coalesce(i.dam_name, '') = '' or r.dam_name = i.dam_name)
where coalesce(i.sire_name, '') <> '' or coalesce(i.dam_name, '') <> '' group by i.rec_id"""


def similarity_sql(a: str, b: str) -> str:
    return (f"case when length({a}) = 0 and length({b}) = 0 then cast(1 as double) when length({a}) = 0 or length({b}) = 0 then cast(0 as double) "
            f"else cast(1 as double) - cast(levenshtein({a}, {b}) as double) / greatest(length({a}), length({b})) end")


def like_sql(a: str, b: str) -> str:
    return f"(coalesce({a}, '') <> '' and coalesce({b}, '') <> '' and ({similarity_sql(f'lower(trim({a}))', f'lower(trim({b}))')}) >= 0.7)"


FUZZY = f"""
select rec_id, arg_max(id, row(score, -id)) as matched_id, max(score) as score from (
  select rec_id, id, case when dam_like then s2 + 0.05::double else s2 end as score from (
    select *, case when sire_like then s1 + 0.05::double else s1 end as s2 from (
      select i.rec_id, r.id, {like_sql('i.sire_name', 'r.sire_name')} as sire_like, {like_sql('i.dam_name', 'r.dam_name')} as dam_like,
        case when i.date_of_birth = r.date_of_birth then base + 0.1::double else base end as s1
      from incoming i join (select a.name as a_name, b.name as b_name, {similarity_sql('a.name', 'b.name')} as base
        from (select distinct lower(trim(registered_name)) as name from incoming) a, (select distinct lower(trim(registered_name)) as name from registry) b) p
        on p.a_name = lower(trim(i.registered_name)) and p.base >= 0.8::double
      join registry_named r on lower(trim(r.registered_name)) = p.b_name) x) y) z
group by rec_id"""
CASCADE = {
    "by_name": EXACT, "by_uuid": UUID, "by_birth": BIRTH, "by_fuzzy": FUZZY,
    "matched": """
select i.rec_id, coalesce(n.matched_id, u.matched_id, b.matched_id, f.matched_id) as matched_id,
  case when n.rec_id is not null or u.rec_id is not null or b.rec_id is not null then cast(1 as double) else coalesce(f.score, 0) end as score,
  case when n.rec_id is not null then 'exact_name' when u.rec_id is not null then 'uuid' when b.rec_id is not null then 'birth_parents'
    when f.rec_id is not null then 'levenshtein' else 'not_found' end as method
from incoming i left join by_name n on n.rec_id = i.rec_id left join by_uuid u on u.rec_id = i.rec_id
left join by_birth b on b.rec_id = i.rec_id left join by_fuzzy f on f.rec_id = i.rec_id""",
}


@query("match_exact_name", f"select rec_id, matched_id, cast(1 as double) as score from ({EXACT}) m")
def match_exact_name(t):
    return mat.match_exact_name(t("incoming"), t("registry_named"))


@query("match_uuid", f"select rec_id, matched_id, cast(1 as double) as score from ({UUID}) m")
def match_uuid(t):
    return mat.match_uuid(t("incoming"), t("registry_named"))


@query("match_birth_parents", f"select rec_id, matched_id, cast(1 as double) as score from ({BIRTH}) m")
def match_birth_parents(t):
    return mat.match_birth_parents(t("incoming"), t("registry_named"))


@query("match_fuzzy", f"select rec_id, matched_id, round(score, 9) as score from ({FUZZY}) m")
def match_fuzzy(t):
    return mat.match_fuzzy(t.stored("incoming"), t.stored("registry_named")).withColumn("score", F.round("score", 9))


@query("match_cascade", "select rec_id, matched_id, round(score, 9) as score, method from matched", CASCADE)
def match_cascade(t):
    return mat.match_cascade(t.stored("incoming"), t.stored("registry_named")).withColumn("score", F.round("score", 9))


BEST = f"select id, target, candidate, position, {similarity_sql('lower(trim(target))', 'lower(trim(candidate))')} as score from name_candidates"


@query("best_candidate", f"""
select id, target, candidate, round(score, 9) as score from (
  select s.*, row_number() over (partition by id order by score desc, position) as n from ({BEST}) s where score >= 0.8::double) x where n = 1""")
def best_candidate(t):
    return mat.best_candidate(t("name_candidates")).withColumn("score", F.round("score", 9))


@query("edit_distance", "select id, position, cast(levenshtein(target, candidate) as int) as distance from name_candidates")
def edit_distance(t):
    return t("name_candidates").select("id", "position", sim.edit_distance(F.col("target"), F.col("candidate")).alias("distance"))


@query("name_similarity", f"select id, position, round({similarity_sql('target', 'candidate')}, 9) as similarity from name_candidates")
def name_similarity(t):
    return t("name_candidates").select("id", "position", F.round(sim.name_similarity(F.col("target"), F.col("candidate")), 9).alias("similarity"))


@query("is_similar_name", f"select id, position, score >= 0.8::double as similar from ({BEST}) s")
def is_similar_name(t):
    return t("name_candidates").select("id", "position", sim.is_similar_name(F.col("target"), F.col("candidate")).alias("similar"))


SHARED_FIELDS = ["registered_name", "date_of_birth", "land_of_birth", "weight", "color", "sire_name", "dam_name"]
FOUND = {**CASCADE, "found": "\nunion all ".join(
    f"""select r.id, i.rec_id, '{f}' as field, coalesce(r.source, 'unknown') as old_source, cast(r.{f} as string) as old_value, i.source as new_source, cast(i.{f} as string) as new_value
from matched m join incoming i on i.rec_id = m.rec_id join registry_named r on r.id = m.matched_id
where r.{f} is not null and i.{f} is not null and cast(r.{f} as string) <> '' and cast(i.{f} as string) <> '' and r.{f} <> i.{f}"""
    for f in SHARED_FIELDS)}


def _found(t):
    matches = mat.match_cascade(t.stored("incoming"), t.stored("registry_named"))
    return con.detect_conflicts(t.stored("registry_named"), t.stored("incoming"), matches)


@query("detect_conflicts", "select * from found", FOUND)
def detect_conflicts(t):
    return _found(t)


def fill_sql(field: str, number: bool = False) -> str:
    empty = f"r.{field} = 0" if number else f"cast(r.{field} as string) = ''"
    good = f"i.{field} <> 0" if number else f"cast(i.{field} as string) <> ''"
    offered = (f"select arg_min(i.{field}, i.rec_id) filter (where {good}) as best, arg_min(i.{field}, i.rec_id) filter (where i.{field} is not null) as any_value "
               f"from matched m join incoming i on i.rec_id = m.rec_id where m.matched_id = r.id")
    return f"case when r.{field} is null or {empty} then coalesce((select coalesce(best, any_value) from ({offered}) o), r.{field}) else r.{field} end as {field}"


@query("merge_fill_missing", f"""
select r.id, {fill_sql('registered_name')}, {fill_sql('weight', True)}, {fill_sql('color')}, {fill_sql('sire_name')}, {fill_sql('dam_name')} from registry_named r""", CASCADE)
def merge_fill_missing(t):
    matches = mat.match_cascade(t.stored("incoming"), t.stored("registry_named"))
    merged = con.merge_fill_missing(t.stored("registry_named"), t.stored("incoming"), matches)
    return merged.select("id", "registered_name", "weight", "color", "sire_name", "dam_name")


HELD = "select id, 'color' as field, case when id % 2 = 0 then 'source_b' else 'source_c' end as source, 'STORED' as value from registry where id % 3 = 0"


@query("accumulate_conflicts", f"""
select id, field, source, arg_max(value, position) as value from (
  select id, field, source, value, -1 as position from ({HELD}) h
  union all select id, field, old_source, old_value, rec_id * 2 from found union all select id, field, new_source, new_value, rec_id * 2 + 1 from found) x
group by id, field, source""", FOUND)
def accumulate_conflicts(t):
    return con.accumulate_conflicts(t.sql(HELD), _found(t))


@query("accumulate_conflicts_flags", """
select r.id, (r.has_conflicts or r.id in (select id from found)) as has_conflicts from registry_ext r""", FOUND)
def accumulate_conflicts_flags(t):
    return con.flag_conflicts(t("registry_ext"), con.conflict_rows(_found(t))).select("id", "has_conflicts")


STORED = "select id, 'color' as field, source, 'A' as value from registry where id % 5 = 0 union all select id, 'color', 'source_b', 'B' from registry where id % 5 = 0"


@query("resolve_conflicts", """
select r.id, coalesce(s.color, r.color) as color, coalesce(s.land_of_birth, r.land_of_birth) as land_of_birth,
  case when s.dog_id is not null then false else r.has_conflicts end as has_conflicts from registry_ext r left join resolution s on s.dog_id = r.id""")
def resolve_conflicts(t):
    return _resolved(t)[0].select("id", "color", "land_of_birth", "has_conflicts")


def _resolved(t):
    return con.resolve_conflicts(t("registry_ext"), t("resolution"), t.sql(STORED), F.to_date(F.lit("2026-01-01")))


LOG = f"""
select s.dog_id as log_id, s.dog_id, date '2026-01-01' as resolved_date, 'color' as field, r.color as old_value, s.color as new_value, 'value' as kind
from resolution s join registry_ext r on r.id = s.dog_id where s.color is not null
union all select s.dog_id, s.dog_id, date '2026-01-01', 'land_of_birth', r.land_of_birth, s.land_of_birth, 'value'
from resolution s join registry_ext r on r.id = s.dog_id where s.land_of_birth is not null
union all select c.id, c.id, date '2026-01-01', c.field, c.source, c.value, 'conflict' from ({STORED}) c where c.id in (select dog_id from resolution)"""


@query("resolve_conflicts_log", LOG)
def resolve_conflicts_log(t):
    return _resolved(t)[1].select("log_id", "dog_id", "resolved_date", "field", "old_value", "new_value", "kind")


@query("undo_merge", f"""
select r.id, case when r.id % 2 = 0 then r.color else coalesce(s.color, r.color) end as color,
  case when r.id % 2 = 0 then r.land_of_birth else coalesce(s.land_of_birth, r.land_of_birth) end as land_of_birth,
  case when s.dog_id is null then r.has_conflicts when r.id % 2 = 0 and r.id in (select dog_id from ({LOG}) l) then r.id % 5 = 0 else false end as has_conflicts
from registry_ext r left join resolution s on s.dog_id = r.id""")
def undo_merge(t):
    """Resolve everything, then undo the even-numbered half."""
    table, log, remaining = _resolved(t)
    requests = log.filter("dog_id % 2 = 0").select("log_id", "dog_id").distinct()
    return con.undo_merge(table, log, requests, remaining)[0].select("id", "color", "land_of_birth", "has_conflicts")


@query("undo_merge_conflicts", f"select id, field, source, value from ({STORED}) c where id % 2 = 0 or id not in (select dog_id from resolution)")
def undo_merge_conflicts(t):
    table, log, remaining = _resolved(t)
    requests = log.filter("dog_id % 2 = 0").select("log_id", "dog_id").distinct()
    return con.undo_merge(table, log, requests, remaining)[2]


CHOICES = """
select distinct id, field, case when id % 4 = 0 then 'other' when id % 4 = 1 then 'source_b' when id % 4 = 2 then 'source_a' else 'nowhere' end as chosen_source,
  case when id % 8 = 0 then ' ' else concat('custom', cast(id as string)) end as custom_value from"""
CONFLICTS = """
select id, 'color' as field, source, color as value from registry where color is not null
union all select id, 'color', 'source_b', 'AMENDED' from registry where color is not null
union all select id, 'weight', source, cast(weight as string) from registry where id % 2 = 1 and weight is not null
union all select id, 'weight', 'source_b', '99' from registry where id % 2 = 1 and weight is not null"""


@query("choose_resolution", f"""
select id, field, value from (
  select f.id, f.field, case when c.chosen_source = 'other' then case when trim(c.custom_value) <> '' then c.custom_value end else nullif(v.value, '') end as value,
    count(*) filter (where case when c.chosen_source = 'other' then case when trim(c.custom_value) <> '' then c.custom_value end else nullif(v.value, '') end is null) over (partition by f.id) as undecided
  from (select distinct id, field from ({CONFLICTS}) a) f left join ({CHOICES} ({CONFLICTS}) b) c on c.id = f.id and c.field = f.field
  left join ({CONFLICTS}) v on v.id = f.id and v.field = f.field and v.source = c.chosen_source) x where undecided = 0""")
def choose_resolution(t):
    return con.choose_resolution(t.sql(CONFLICTS), t.sql(f"{CHOICES} ({CONFLICTS}) b")).select("id", "field", "value")


@query("merge_history_diff", "select log_id, dog_id, field, old_value, new_value from merge_log where old_value is distinct from new_value")
def merge_history_diff(t):
    return con.merge_history_diff(t("merge_log")).select("log_id", "dog_id", "field", "old_value", "new_value")
