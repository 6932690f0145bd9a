"""Ancestor expansion, inbreeding and link reachability over the whole registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ancestry as anc, pedigrees as ped, relations as rel
from ..session import settle
from . import query

GENERATIONS = 5

EDGES = """
select c.id as child, 'S' as letter, c.sire_id as parent from registry c join registry p on p.id = c.sire_id
union all select c.id, 'D', c.dam_id from registry c join registry p on p.id = c.dam_id"""


def walk(generations: int) -> dict[str, str]:
    """SQL clauses: parent edges and every path of fewer than `generations` edges."""
    return {
        "edge": EDGES,
        "walk": f"""
select id as root, id as node, '' as path, 0 as gen from registry
union all select w.root, e.parent, concat(w.path, e.letter), w.gen + 1 from walk w join edge e on e.child = w.node where w.gen < {generations - 1}""",
    }


def reach(generations: int) -> dict[str, str]:
    """Adds the bounded members and every path among them, however long."""
    return walk(generations) | {
        "member": "select distinct root, node from walk",
        "reach": """
select e.child as root, e.letter as side, e.parent as node, e.letter as path from edge e join member m on m.root = e.child and m.node = e.parent
union all select r.root, r.side, e.parent, concat(r.path, e.letter) from reach r join edge e on e.child = r.node
  join member m on m.root = r.root and m.node = e.parent""",
        "first_path": "select root, side, node, min(translate(path, 'SD', '01')) as code from reach group by root, side, node",
        "shared_anc": """
select s.root, s.node, length(s.code) - 1 as n1, length(d.code) - 1 as n2, s.code as sire_code, d.code as dam_code
from first_path s join first_path d on s.root = d.root and s.node = d.node and s.side = 'S' and d.side = 'D'""",
    }


TREE_COLUMNS = ["root", "node", "path", "gen", "uuid", "registered_name", "sex", "color", "date_of_birth"]


@query("lineage_tree", """
select w.root, w.node, w.path, w.gen, r.uuid, r.registered_name, r.sex, r.color, r.date_of_birth from walk w join registry r on r.id = w.node""",
       walk(GENERATIONS), recursive=True)
def lineage_tree(t):
    return anc.lineage_tree(t("registry"), GENERATIONS).select(*TREE_COLUMNS)


@query("lineage_tree_by_uuid", """
select w.root, w.path, w.gen, r.registered_name from walk w join registry r on r.id = w.node
where w.root in (select id from registry where uuid in (select uuid from incoming))""", walk(4), recursive=True)
def lineage_tree_by_uuid(t):
    return anc.lineage_tree_by_uuid(t("registry"), t("incoming").select("uuid"), 4).select("root", "path", "gen", "registered_name")


@query("lineage_tree_detailed", """
select x.dog_id, x.relation, x.related_id, x.label from (
  select dog_id, 'title' as relation, id as related_id, short_name as label from title
  union all select l.dog_id, 'owner', o.id, o.name from dog_owner l join owner o on o.id = l.owner_id
  union all select l.dog_id, 'breeder', o.id, o.name from dog_breeder l join breeder o on o.id = l.breeder_id
  union all select dam_id, 'litter_as_dam', id, cast(date_of_birth as string) from litter
  union all select sire_id, 'litter_as_sire', id, cast(date_of_birth as string) from litter
  union all select l.dog_id, 'sibling', o.id, o.registered_name from sibling_link l join registry o on o.id = l.sibling_id
  union all select r.id, 'birth_litter', l.id, cast(l.date_of_birth as string) from registry r join litter l
    on l.dam_id = r.dam_id and l.sire_id = r.sire_id and l.date_of_birth = r.date_of_birth
) x where x.dog_id in (select distinct node from walk where root in (select rec_id from incoming))""", walk(GENERATIONS), recursive=True)
def lineage_tree_detailed(t):
    """Relations of every animal that appears in any tree, once per animal; trees and relations join on the animal."""
    dogs = t.stored("registry")
    members = anc.lineage_members(dogs, GENERATIONS, t("incoming").select(F.col("rec_id").alias("id")))
    animals = settle(dogs.join(members, "id", "left_semi"))
    profile = rel.entity_profile(
        animals, dogs, rel.join_people(animals, t("dog_owner"), t("owner"), "owner_id"),
        rel.join_people(animals, t("dog_breeder"), t("breeder"), "breeder_id"),
        t("sibling_link"), t("title"), t("medical_record"), t("litter"), t("merge_log"),
    )
    kinds = ["title", "owner", "breeder", "litter_as_dam", "litter_as_sire", "sibling", "birth_litter"]
    return profile.filter(F.col("relation").isin(kinds)).select("dog_id", "relation", "related_id", "label")


RELATED = """
select dog_id, 'title' as relation, id as related_id, short_name as label from title
union select l.dog_id, 'owner', o.id, o.name from dog_owner l join owner o on o.id = l.owner_id
union select l.dog_id, 'breeder', o.id, o.name from dog_breeder l join breeder o on o.id = l.breeder_id
union select l.dog_id, 'sibling', o.id, o.registered_name from sibling_link l join registry o on o.id = l.sibling_id
union select dam_id, 'litter_as_dam', id, cast(date_of_birth as string) from litter
union select sire_id, 'litter_as_sire', id, cast(date_of_birth as string) from litter
union select r.id, 'birth_litter', l.id, cast(l.date_of_birth as string) from registry r join litter l
  on l.dam_id = r.dam_id and l.sire_id = r.sire_id and l.date_of_birth = r.date_of_birth"""


def _documents(t):
    """Documents of every incoming record's animal, and the parts of all relations in them."""
    dogs = t.stored("registry")
    roots = settle(t("incoming").select(F.col("rec_id").alias("id")))
    animals = settle(dogs.join(anc.lineage_members(dogs, GENERATIONS, roots), "id", "left_semi"))
    profile = rel.entity_profile(
        animals, dogs, rel.join_people(animals, t("dog_owner"), t("owner"), "owner_id"),
        rel.join_people(animals, t("dog_breeder"), t("breeder"), "breeder_id"),
        t("sibling_link"), t("title"), t("medical_record"), t("litter"), t("merge_log"),
    )
    # The documents carry what a pedigree loads with each animal; parents are documents themselves.
    loaded = profile.where(~F.col("relation").isin("sire", "dam", "medical_record", "merge_log"))
    parts = settle(ped.relation_parts(loaded))
    return ped.pedigree_documents(dogs, parts, GENERATIONS, roots), parts


@query("lineage_documents", """
select w.root, w.path, w.gen, w.node, r.uuid, r.registered_name, r.call_name, r.sex, r.color, r.date_of_birth,
  cast(coalesce(c.n, 0) as bigint) as n_relations
from walk w join registry r on r.id = w.node left join (select dog_id, count(*) as n from related group by dog_id) c on c.dog_id = w.node
where w.root in (select rec_id from incoming)""", walk(GENERATIONS) | {"related": RELATED}, recursive=True)
def lineage_documents(t):
    """One row for each place of each nested document, with the number of relations that stand there."""
    documents, parts = _documents(t)
    # Counted before anything else: the lists don't move for their lengths.
    rows = ped.pedigree_rows(documents, GENERATIONS).withColumn("n_relations", F.size("relations").cast("bigint")).drop("relations")
    beyond = parts.where("part > 0").groupBy(F.col("dog_id").alias("node")).agg(F.sum(F.size("relations")).alias("more"))
    if not beyond.isEmpty():
        rows = rows.join(beyond, "node", "left").withColumn("n_relations", F.col("n_relations") + F.coalesce("more", F.lit(0)))
    return rows.select("root", "path", "gen", "node", *ped.FACTS, "n_relations")


@query("lineage_document_relations", """
select w.root, w.path, x.relation, count(*) as n_rows, cast(sum(x.related_id) as bigint) as sum_ids, min(x.label) as first_label, max(x.label) as last_label
from walk w join related x on x.dog_id = w.node where w.root in (select rec_id from incoming) group by w.root, w.path, x.relation""",
       walk(GENERATIONS) | {"related": RELATED}, recursive=True)
def lineage_document_relations(t):
    """The relations in the nested documents by root, path and kind."""
    documents, parts = _documents(t)
    totals = ped.pedigree_relations(ped.pedigree_rows(documents, GENERATIONS), parts, by_kind=True).drop("node")
    # An animal has one document unless an id has several records; only then places of one root must be brought together.
    repeated = t.stored("registry").groupBy("id").count().where("count > 1")
    return totals if repeated.isEmpty() else ped.merged_kinds(totals, "root", "path")


@query("lineage_list", """
select w.root, w.node, w.gen, replace(replace(array_to_string(string_split(w.path, ''), '.'), 'S', 'sire'), 'D', 'dam') as position,
  translate(w.path, 'DS', '01') as preorder from walk w""", walk(GENERATIONS), recursive=True)
def lineage_list(t):
    return anc.lineage_list(t("registry"), GENERATIONS).select("root", "node", "gen", "position", "preorder")


@query("lineage_nodes", "select root, node, min(gen) as gen from walk group by root, node", walk(GENERATIONS), recursive=True)
def lineage_nodes(t):
    return anc.lineage_nodes(t("registry"), GENERATIONS)


@query("lineage_bounded_set", """
select root, node, cast(length(max(translate(path, 'SD', '01'))) as int) as gen from walk group by root, node""", walk(GENERATIONS), recursive=True)
def lineage_bounded_set(t):
    return anc.lineage_bounded_set(t("registry"), GENERATIONS)


@query("lineage_closure", """
select distinct root, case when side = 'S' then 'sire' else 'dam' end as side, node from reach""", reach(4), recursive=True)
def lineage_closure(t):
    return anc.lineage_closure(anc.side_paths(t("registry"), 4))


@query("lineage_first_path", """
select root, case when side = 'S' then 'sire' else 'dam' end as side, node, translate(code, '01', 'SD') as path, cast(length(code) - 1 as int) as steps
from first_path""", reach(GENERATIONS), recursive=True)
def lineage_first_path(t):
    return anc.lineage_first_path(anc.side_paths(t("registry"), GENERATIONS))


@query("common_ancestors", """
select b.root, b.node, v.gen, r.registered_name from shared_anc b join registry r on r.id = b.node join (
  select root, node, cast(length(max(translate(path, 'SD', '01'))) as int) as gen from walk group by root, node) v on v.root = b.root and v.node = b.node""",
       reach(GENERATIONS), recursive=True)
def common_ancestors(t):
    dogs = t("registry")
    return anc.common_ancestors(anc.side_paths(dogs, GENERATIONS), anc.lineage_bounded_set(dogs, GENERATIONS), dogs)


@query("set_intersect_ancestors", """
select distinct root, node from reach where side = 'S' intersect select distinct root, node from reach where side = 'D'""", reach(4), recursive=True)
def set_intersect_ancestors(t):
    closure = anc.lineage_closure(anc.side_paths(t("registry"), 4))
    return closure.filter("side = 'sire'").select("root", "node").intersect(closure.filter("side = 'dam'").select("root", "node"))


SHARES = "select b.root, b.node, b.n1, b.n2, b.sire_code, b.dam_code, coalesce(r.coi, 0) as fa, r.registered_name as ancestor_name, pow(0.5, b.n1 + b.n2 + 1) * (1 + coalesce(r.coi, 0)) as contribution from shared_anc b join registry_ext r on r.id = b.node"
TOTALS = f"select r.id as root, round(coalesce(sum(contribution), 0), 12) as coi, count(contribution) as common_ancestors from registry r left join ({SHARES}) s on s.root = r.id group by r.id"


@query("inbreeding", TOTALS, reach(GENERATIONS), recursive=True)
def inbreeding(t):
    return anc.inbreeding(t.stored("registry_ext"), GENERATIONS).withColumn("coi", F.round("coi", 12))


@query("inbreeding_details", f"""
select root, node, ancestor_name, cast(n1 as int) as generations_to_sire, cast(n2 as int) as generations_to_dam, fa as ancestor_coi, round(contribution, 9) as contribution,
  (select string_agg(cast(p.node as string), '>' order by length(p.code)) from first_path p where p.root = s.root and starts_with(s.sire_code, p.code)) as sire_path,
  (select string_agg(cast(p.node as string), '>' order by length(p.code)) from first_path p where p.root = s.root and starts_with(s.dam_code, p.code)) as dam_path
from ({SHARES}) s""", reach(4), recursive=True)
def inbreeding_details(t):
    dogs = t.stored("registry_ext")
    rows = anc.inbreeding_details(anc.side_paths(dogs, 4), dogs)
    return rows.select(
        "root", "node", "ancestor_name", "generations_to_sire", "generations_to_dam", "ancestor_coi",
        F.round("contribution", 9).alias("contribution"),
        F.array_join(F.col("sire_path").cast("array<string>"), ">").alias("sire_path"),
        F.array_join(F.col("dam_path").cast("array<string>"), ">").alias("dam_path"),
    )


@query("inbreeding_batch", f"""
select q.root, x.coi, x.common_ancestors, x.root is not null as success from (
  select rec_id as root from incoming union select rec_id + 1000000000 from incoming where rec_id % 2 = 0) q left join ({TOTALS}) x on x.root = q.root""",
       reach(4), recursive=True)
def inbreeding_batch(t):
    ids = t.sql("select rec_id as id from incoming union select rec_id + 1000000000 from incoming where rec_id % 2 = 0")
    return anc.inbreeding_batch(t.stored("registry_ext"), ids, 4).withColumn("coi", F.round("coi", 12))


@query("inbreeding_writeback", f"""
select r.id, round(coalesce(x.coi, r.coi), 12) as coi, case when x.root is not null then date '2026-01-01' end as coi_updated_on
from registry_ext r left join (select * from ({TOTALS}) z where z.root in (select rec_id from incoming)) x on x.root = r.id""", reach(4), recursive=True)
def inbreeding_writeback(t):
    dogs = t.stored("registry_ext")
    values = anc.inbreeding(dogs, 4, t("incoming").select(F.col("rec_id").alias("id")))
    new = anc.inbreeding_writeback(dogs, values, F.to_date(F.lit("2026-01-01")))
    return new.select("id", F.round("coi", 12).alias("coi"), "coi_updated_on")


@query("inbreeding_after_changes", f"select * from ({TOTALS}) x where root in (select id from touched)", {
    "changed": "select id, dam_id, case when id % 97 <> 0 then sire_id when sire_id > 2 then sire_id - 2 end as sire_id from registry",
    **reach(4), "edge": EDGES.replace("registry", "changed"),
    "touched": "select id from registry where id % 97 = 0 union select e.child from touched t join edge e on e.parent = t.id"}, recursive=True)
def inbreeding_after_changes(t):
    """Every 97th animal gets another sire, or none; only it and its descendants are computed again."""
    hit = F.col("id") % 97 == 0
    dogs = t.stored("registry_ext")
    edited = settle(dogs.withColumn("sire_id", F.when(~hit, F.col("sire_id")).when(F.col("sire_id") > 2, F.col("sire_id") - 2)))
    return anc.inbreeding_after_changes(edited, edited.where(hit), 4).withColumn("coi", F.round("coi", 12))


@query("inbreeding_read", """
select id, registered_name, coi, round(nullif(coi, 0) * 100, 6) as coi_percentage, coi is not null as has_coi from registry_ext""")
def inbreeding_read(t):
    return anc.inbreeding_read(t("registry_ext")).withColumn("coi_percentage", F.round("coi_percentage", 6))


@query("crawl_frontier", """
select url, cast(min(depth) as int) as depth from front group by url""", {
    "front": """
select url, 0 as depth from (select distinct url from link_table where url not in (select link from link_table)) s
union select l.link, f.depth + 1 from front f join link_table l on l.url = f.url where f.depth < 5""",
}, recursive=True)
def crawl_frontier(t):
    links = t("link_table")
    seeds = links.select("url").distinct().join(links.select(F.col("link").alias("url")), "url", "left_anti")
    return anc.crawl_frontier(links, seeds, 5)


GRAPH_EDGES = """
select n.root, e.parent as from_id, n.node as to_id, case when e.letter = 'S' then 'sire' else 'dam' end as label
from (select distinct root, node from walk) n join edge e on e.child = n.node join (select distinct root, node from walk) m on m.root = n.root and m.node = e.parent"""


@query("sink_lineage_graph", GRAPH_EDGES, walk(GENERATIONS), recursive=True)
def sink_lineage_graph(t):
    return anc.lineage_graph(t("registry"), GENERATIONS)[1]


@query("sink_lineage_graph_nodes", """
select n.root, n.node, concat(coalesce(r.registered_name, ''), chr(10), 'ID: ', cast(n.node as string), chr(10), 'Sex: ', case when r.sex = 1 then 'M' else 'F' end,
  chr(10), 'Born: ', coalesce(cast(r.date_of_birth as string), '')) as label
from (select distinct root, node from walk) n join registry r on r.id = n.node""", walk(GENERATIONS), recursive=True)
def sink_lineage_graph_nodes(t):
    return anc.lineage_graph(t("registry"), GENERATIONS)[0]
