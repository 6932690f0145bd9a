"""A whole batch of pages into the registry: animals, parents, people, siblings, litters and conflicts.

Saving pages one after the other lets a page match an animal that an earlier page of the same batch made. Here the records
that match no animal are matched among themselves: equal names, identifiers, birth and parents, or similar names tie them
together, and each component becomes one animal, made from its lowest record. The others of the component, like the records
that match an animal of the registry, fill its gaps and raise conflicts. New animals get their ids level by level, parents
before children. Every relation of a record is then a lookup of the two animals its ends became.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import text as tx
from ..functions.text import blank_to_null
from ..session import settle
from . import conflicts as con, extraction as ex, mapping as mp, upsert as up
from .components import components
from .matching import NAME_THRESHOLD, match_birth_parents, match_cascade, match_exact_name, match_uuid
from .similar_names import similar_pairs
from ..functions.similarity import normal_name

SECTIONS = {"siblings": "sibling", "children": "puppy"}
LABELS_OF_PEOPLE = {"owner": ("владелец", "is_main_owner"), "breeder": ("заводчик", "is_breeder")}


@dataclass
class Batch:
    """What the pages of a batch say.

    records: rec_id and registry columns. relations: (rec_id, role, other_rec), role being sire, dam, sibling or puppy.
    people: (rec_id, role, position, uuid, name), role being owner or breeder.
    """

    records: DataFrame
    relations: DataFrame
    people: DataFrame


@dataclass
class State:
    """The tables a batch changes. Links are (dog_id, person_id) and (dog_id, sibling_id); conflicts (id, field, source, value)."""

    registry: DataFrame
    owners: DataFrame
    breeders: DataFrame
    owner_links: DataFrame
    breeder_links: DataFrame
    siblings: DataFrame
    litters: DataFrame
    conflicts: DataFrame


def read_pages(pages: DataFrame, base_url: str, source: str) -> Batch:
    """Pages (page_id, url, html) as a batch. A page's own slug is its key; links go to the page of that slug in the batch.

    Of several pages with one slug the lowest page_id stands for it; links to pages outside the batch are left out.
    """
    facts = settle(ex.page_facts(pages, tuple(SECTIONS)))
    table = ex.label_table(pages, facts)
    values, links = settle(ex.extract_label_values(pages, table)), settle(ex.extract_label_links(pages, base_url, table=table))
    slugs = settle(pages.select("page_id", blank_to_null(tx.slug_from_query(F.col("url"))).alias("slug")))
    own = slugs.where("slug is not null").select("page_id", F.lit(-2).alias("position"), F.lit("link_name").alias("label"), F.col("slug").alias("value"))
    mapped = mp.map_source_b(ex.label_map(values.unionByName(own), links), source).withColumnRenamed("page_id", "rec_id")
    records = settle(mapped.withColumns({c: F.col(c).cast("date") for c in ("date_of_birth", "date_of_death")}))

    page_of = slugs.where("slug is not null").groupBy("slug").agg(F.min("page_id").alias("other_rec"))
    parents = records.select("rec_id", F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_link_name").alias("slug")) for r in ("sire", "dam")])))
    sections = [_section(pages, section, base_url, facts).select("page_id", F.lit(role).alias("role"), "slug").withColumnRenamed("page_id", "rec_id") for section, role in SECTIONS.items()]
    named = reduce(DataFrame.unionByName, [parents, *sections])
    relations = named.join(page_of, "slug").where("rec_id != other_rec").select("rec_id", "role", "other_rec").distinct()

    people = []
    for role, (label, _) in LABELS_OF_PEOPLE.items():
        told = values.where(F.col("label") == label).select("page_id", "value")
        linked = links.where(F.col("label") == label).select("page_id", F.col("link_no").alias("position"), F.col("text").alias("name"))
        if role == "breeder":
            linked = linked.limit(0)
        unlinked = told.join(linked.select("page_id").distinct(), "page_id", "left_anti").select("page_id", F.lit(0).alias("position"), F.col("value").alias("name"))
        people.append(linked.unionByName(unlinked).select(F.col("page_id").alias("rec_id"), F.lit(role).alias("role"), "position", "name"))
    listed = reduce(DataFrame.unionByName, people).where(F.coalesce("name", F.lit("")) != "").withColumn("uuid", tx.surrogate_uuid(F.col("name")))
    return Batch(records, settle(relations), settle(listed))


def _section(pages: DataFrame, section: str, base_url: str, facts: DataFrame) -> DataFrame:
    found = ex.section_links(pages, section, base_url, facts)
    return found.select("page_id", tx.slug_from_query(F.col("url")).alias("slug")).where("slug is not null")


def batch_groups(records: DataFrame) -> DataFrame:
    """(rec_id, leader): records of one batch that match each other, with the lowest of them. Unnamed records stay alone."""
    named = settle(records.where(F.coalesce("registered_name", F.lit("")) != ""))
    held = named.withColumn("id", F.col("rec_id"))
    steps = [step(named, held).select(F.col("rec_id").alias("a"), F.col("matched_id").alias("b")) for step in (match_exact_name, match_uuid, match_birth_parents)]
    names = settle(named.select(normal_name(F.col("registered_name")).alias("name"), "rec_id").where("name <> ''").groupBy("name").agg(F.min("rec_id").alias("rec_id")))
    alike = similar_pairs(names.select("name"), names.select("name"), NAME_THRESHOLD).where("left_name < right_name")
    similar = alike.join(names.select(F.col("name").alias("left_name"), F.col("rec_id").alias("a")), "left_name").join(names.select(F.col("name").alias("right_name"), F.col("rec_id").alias("b")), "right_name").select("a", "b")
    same = named.select("rec_id", normal_name(F.col("registered_name")).alias("name")).join(names.withColumnRenamed("rec_id", "b"), "name").select(F.col("rec_id").alias("a"), "b")
    found = components(reduce(DataFrame.unionByName, [*steps, similar, same]))
    return records.select("rec_id").join(found.select(F.col("node").alias("rec_id"), "root"), "rec_id", "left").select("rec_id", F.coalesce("root", "rec_id").alias("leader"))


def insert_levels(animals: DataFrame, parents: DataFrame) -> DataFrame:
    """(key, level) of each of `animals` (key): 0 without parents in the table, else one more than the highest parent.

    `parents` has (key, parent), both ends among the animals. Each round drops the animals whose parents all have a level;
    animals on a circle of parents, which never get one, come last together.
    """
    open_edges, done, level = settle(parents.select("key", "parent").where("key != parent").distinct()), None, 0
    left = animals.select("key")
    while True:
        waiting = open_edges.select("key").distinct()
        ready = settle(left.join(waiting, "key", "left_anti").withColumn("level", F.lit(level)))
        stuck = ready.isEmpty()
        if stuck:
            ready = left.withColumn("level", F.lit(level))
        done = ready if done is None else done.unionByName(ready)
        left = settle(left.join(ready, "key", "left_anti"))
        if stuck or left.isEmpty():
            return done
        open_edges = settle(open_edges.join(ready.select(F.col("key").alias("parent")), "parent", "left_anti"))
        level += 1


def ids_by_level(rows: DataFrame, table: DataFrame, key: str, level: str) -> DataFrame:
    """Give rows the next free ids of `table`, by level and then by md5 of their unique key text.

    Rows are numbered inside the 256 hash prefixes of a level; only the sizes of these are summed up in one place.
    """
    keyed = rows.withColumn("_hash", F.md5(key)).withColumn("_prefix", F.substring("_hash", 1, 2))
    inside = keyed.withColumn("_n", F.row_number().over(Window.partitionBy(level, "_prefix").orderBy("_hash", key)))
    sizes = keyed.groupBy(level, "_prefix").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.withColumn("_start", F.sum("_size").over(Window.orderBy(level, "_prefix")) - F.col("_size")).drop("_size")
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("_top"))
    numbered = inside.join(starts, [level, "_prefix"]).crossJoin(F.broadcast(top))
    return numbered.withColumn("id", F.col("_top") + F.col("_start") + F.col("_n")).drop("_hash", "_prefix", "_n", "_start", "_top")


def resolve(state: State, batch: Batch) -> tuple[DataFrame, DataFrame]:
    """(rec_id, id, leads) for every record, `leads` marking those that make a new animal; and the new animals' rows with ids."""
    matches = settle(match_cascade(batch.records, state.registry))
    fresh = settle(batch.records.join(matches.where("matched_id is null").select("rec_id"), "rec_id", "left_semi"))
    groups = settle(batch_groups(fresh))
    of_parents = batch.relations.where("role in ('sire', 'dam')").select("rec_id", "other_rec")
    leader = groups.select(F.col("rec_id"), F.col("leader"))
    edges = of_parents.join(leader, "rec_id").join(leader.select(F.col("rec_id").alias("other_rec"), F.col("leader").alias("parent")), "other_rec").select(F.col("leader").alias("key"), "parent")
    leaders = settle(groups.where("rec_id = leader").select(F.col("leader").alias("key")))
    levels = insert_levels(leaders, edges).withColumnRenamed("key", "rec_id")
    key = F.coalesce(F.nullif(F.col("uuid"), F.lit("")), F.lit("")).alias("_uuid")
    rows = fresh.join(levels, "rec_id").withColumn("_key", F.concat(key, F.lit(" rec "), F.col("rec_id").cast("string")))
    added = settle(ids_by_level(rows, state.registry, "_key", "level").drop("_key", "level"))
    new_ids = groups.join(added.select(F.col("rec_id").alias("leader"), "id"), "leader").select("rec_id", "id", (F.col("rec_id") == F.col("leader")).alias("leads"))
    known = matches.where("matched_id is not null").select("rec_id", F.col("matched_id").alias("id"), F.lit(False).alias("leads"))
    return settle(known.unionByName(new_ids)), added


def ingest(state: State, batch: Batch) -> tuple[State, DataFrame]:
    """The tables after the batch, and (rec_id, id, leads), the animal of every record."""
    animals, added = resolve(state, batch)
    columns = [F.col(c).cast(kind).alias(c) if c in added.columns else F.lit(None).cast(kind).alias(c) for c, kind in state.registry.dtypes]
    grown = settle(state.registry.unionByName(added.select(*columns)))
    laid = settle(animals.where("not leads").select("rec_id", F.col("id").alias("matched_id")))
    conflicts = settle(con.accumulate_conflicts(state.conflicts, con.detect_conflicts(grown, batch.records, laid)))
    merged = con.flag_conflicts(con.merge_fill_missing(grown, batch.records, laid), conflicts)

    ends = batch.relations.join(animals.select("rec_id", "id"), "rec_id").join(animals.select(F.col("rec_id").alias("other_rec"), F.col("id").alias("other_id")), "other_rec")
    ends = settle(ends.where("id != other_id").select("rec_id", "role", "id", "other_rec", "other_id"))
    found = ends.where("role in ('sire', 'dam')").select("id", *[F.when(F.col("role") == r, F.col("other_id")).alias(f"{r}_id") for r in ("sire", "dam")])
    linked = settle(up.link_parents(merged, found))
    siblings = up.link_siblings(state.siblings, ends.where("role = 'sibling'").select(F.col("id").alias("dog_id"), F.col("other_id").alias("sibling_id")))

    tables = {}
    for role, people, links in (("owner", state.owners, state.owner_links), ("breeder", state.breeders, state.breeder_links)):
        flag = LABELS_OF_PEOPLE[role][1]
        named = batch.people.where(F.col("role") == role).join(animals.select("rec_id", "id"), "rec_id")
        # The first page that mentions a person writes the row.
        told = named.select("uuid", "name", F.lit(True).alias(flag), F.struct("rec_id", "position").alias("position"))
        tables[role] = settle(up.upsert_people(people, told.select(*[c for c in told.columns if c in people.columns or c == "position"]), update=False))
        by_uuid = tables[role].groupBy("uuid").agg(F.min("id").alias("person_id"))
        tables[f"{role}_links"] = up.link_people(links, named.join(by_uuid, "uuid").select(F.col("id").alias("dog_id"), "person_id"))

    litters, registry = _litters(state.litters, linked, batch, ends)
    return State(registry, tables["owner"], tables["breeder"], tables["owner_links"], tables["breeder_links"], siblings, litters, conflicts), animals


def _litters(held: DataFrame, registry: DataFrame, batch: Batch, ends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Puppies that a page lists, grouped by birth date, become litters of the page's animal; puppies point to their litter."""
    puppy = batch.records.select(F.col("rec_id").alias("other_rec"), "date_of_birth", "sex")
    listed = ends.where("role = 'puppy'").join(puppy.where("date_of_birth is not null"), "other_rec")
    one = listed.groupBy("id", "date_of_birth", "other_id").agg(F.min("sex").alias("sex"))
    counts = one.groupBy(F.col("id").alias("parent_id"), "date_of_birth").agg(F.count_if(F.col("sex") == 1).alias("male_count"), F.count_if(F.col("sex") == 2).alias("female_count"))
    rows = counts.withColumns({"sire_id": F.lit(None).cast("bigint"), "dam_id": F.lit(None).cast("bigint"), "position": F.lit(0)})
    placed = settle(up.set_litter_parent(rows, registry).drop("parent_id"))
    litters = settle(up.upsert_litters(held, placed))
    by_parent = litters.select(F.col("id").alias("litter_id"), "date_of_birth", F.coalesce("dam_id", "sire_id").alias("id")).where("dam_id is null or sire_id is null")
    puppies = one.join(by_parent, ["id", "date_of_birth"]).select(F.col("other_id").alias("puppy_id"), "litter_id")
    return litters, up.link_puppies(registry, puppies)
