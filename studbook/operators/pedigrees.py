"""Pedigrees as nested documents: every animal with its facts, its relations and the documents of its parents.

Trees are folded from the oldest level to the roots as lists of record numbers: the tree of an animal at one level is its own
number and the trees of its sire and dam from the level before. So each animal is joined once a level, however many paths lead
to it and however many roots share it. The records themselves, with their relations, move once, to every place of the trees of
each two parents; litter mates share what stands above them.

Relations go into documents in parts of bounded size. Part 0 stands in the document; what an animal has beyond it stays in
rows of its own, so an animal with a third of all relations is neither one group nor one oversized document.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .ancestry import parent_edges

PART_ROWS = 256
FACTS = ["uuid", "registered_name", "call_name", "sex", "color", "date_of_birth"]
RELATION = ["relation", "related_id", "label"]


def relation_parts(profile: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """(dog_id, part, parts, relations): relations in sorted lists of about `part_rows`, dealt by their hash.

    `profile` is the result of `entity_profile`. A relation that is stated several times is listed once; animals without
    relations and rows without an animal are left out.
    """
    rows = settle(profile.where("dog_id is not null and relation is not null").select("dog_id", *RELATION).distinct())
    parts = rows.groupBy("dog_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    dealt = rows.join(parts, "dog_id").withColumn("part", F.pmod(F.xxhash64(*RELATION), F.col("parts")).cast("int"))
    # Dealt anew by animal and part: the join's own partitions hold whole animals.
    return dealt.repartition("dog_id", "part").groupBy("dog_id", "part", "parts").agg(F.array_sort(F.collect_list(F.struct(*RELATION))).alias("relations"))


def pedigree_levels(dogs: DataFrame, generations: int, ids: DataFrame | None = None) -> list[DataFrame]:
    """For each generation the animals that some root has there, each once, as `id`; one written table a level."""
    level = dogs.select("id") if ids is None else dogs.select("id").join(ids.select("id"), "id", "left_semi")
    levels = [settle(level)]
    if generations > 1:
        up = settle(parent_edges(dogs).select(F.col("child").alias("id"), "parent"))
    for _ in range(generations - 1):
        levels.append(settle(levels[-1].join(up, "id").select(F.col("parent").alias("id")).distinct()))
    return levels


def pedigree_documents(dogs: DataFrame, parts: DataFrame, generations: int = 5, ids: DataFrame | None = None, facts: list[str] = FACTS, max_generations: int = 8) -> DataFrame:
    """(root, document): id, `facts`, relations, relation_parts, and down to the last generation sire and dam, null where unknown.

    `dogs` has one row per id, `parts` comes from `relation_parts`. Without `ids` every animal is a root; ids that are null
    or unknown give no row, and a parent that is no row of `dogs` is null.
    """
    if not 1 <= generations <= max_generations:
        raise ValueError(f"generations lies in 1..{max_generations}")
    levels = pedigree_levels(dogs, generations, ids)
    members = levels[0]
    for level in levels[1:]:
        members = members.unionByName(level)
    first = parts.where("part = 0").select(F.col("dog_id").alias("id"), "relations", F.col("parts").alias("relation_parts"))
    nothing = F.array().cast(parts.schema["relations"].dataType)
    own = settle(
        dogs.select("id", "sire_id", "dam_id", *facts).join(members, "id", "left_semi").join(first, "id", "left")
        .withColumns({"relations": F.coalesce("relations", nothing), "relation_parts": F.coalesce("relation_parts", F.lit(0)), "row": F.monotonically_increasing_id()}))
    record = ["id", *facts, "relations", "relation_parts"]
    records = own.select("row", F.struct(*record).alias("record"))
    if generations == 1:
        return own.join(levels[0], "id", "left_semi").select(F.col("id").alias("root"), F.struct(*record).alias("document"))
    couples, children = _couples(own.select("id", "row", "sire_id", "dam_id"), levels)
    places = _places(generations - 1)
    places = [role + path for role in "SD" for path in places]
    spots = couples.select("couple", F.posexplode("tree").alias("place", "row")).where("row is not null")
    held = spots.join(records, "row").select("couple", "place", "record").repartition("couple")
    held = held.groupBy("couple").agg(F.map_from_entries(F.collect_list(F.struct("place", "record"))).alias("held"))

    def nested(path: str) -> Column:
        at = F.col("held")[places.index(path)]
        below = [nested(path + letter).alias(role) for letter, role in (("S", "sire"), ("D", "dam"))] if len(path) < generations - 1 else []
        return F.when(at.isNotNull(), F.struct(*[at[c].alias(c) for c in record], *below))

    parents = held.select("couple", nested("S").alias("sire"), nested("D").alias("dam"))
    roots = children.join(records, "row").select("couple", "record")
    documents = roots.where("couple is not null").join(parents, "couple")
    alone = roots.where("couple is null").select("couple", "record", *[F.lit(None).cast(parents.schema[role].dataType).alias(role) for role in ("sire", "dam")])
    documents = documents.unionByName(alone)
    return documents.select(F.col("record.id").alias("root"), F.struct(*[F.col("record")[c].alias(c) for c in record], "sire", "dam").alias("document"))


def _places(generations: int) -> list[str]:
    """The paths of a tree in the order of its list: an animal, its sire's tree, its dam's tree."""
    return [""] + [role + path for role in "SD" for path in _places(generations - 1)] if generations else []


def _joined_trees(rows: DataFrame, trees: DataFrame, generations: int) -> DataFrame:
    """`rows` with the lists of their sires and dams, one after the other, as `above`; null where both parents are unknown."""
    trees = settle(trees)
    unknown = F.array_repeat(F.lit(None).cast("bigint"), len(_places(generations)))
    for role in ("sire", "dam"):
        rows = rows.join(trees.select(F.col("id").alias(f"{role}_id"), F.col("tree").alias(role)), f"{role}_id", "left")
    either = F.col("sire").isNotNull() | F.col("dam").isNotNull()
    return rows.withColumn("above", F.when(either, F.concat(F.coalesce("sire", unknown), F.coalesce("dam", unknown)))).drop("sire", "dam")


def _couples(own: DataFrame, levels: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(couple, tree) of every two parents of some root, tree listing the numbers of the records in the parents' trees, and (row, couple) of the roots.

    An id with several records has a tree for each, and roots a couple for each two trees of their parents.
    """
    trees, depth = own.join(levels[-1], "id", "left_semi").select("id", F.array("row").alias("tree")), 1
    for level in reversed(levels[1:-1]):
        rows = _joined_trees(own.join(level, "id", "left_semi"), trees, depth)
        unknown = F.array_repeat(F.lit(None).cast("bigint"), 2 * len(_places(depth)))
        trees, depth = rows.select("id", F.concat(F.array("row"), F.coalesce("above", unknown)).alias("tree")), depth + 1
    roots = own.join(levels[0], "id", "left_semi").select("row", "sire_id", "dam_id")
    couples = _joined_trees(roots.select("sire_id", "dam_id").distinct(), trees, depth).where("above is not null")
    couples = settle(couples.select("sire_id", "dam_id", F.monotonically_increasing_id().alias("couple"), F.col("above").alias("tree")))
    named = couples.select(F.col("sire_id").alias("sire"), F.col("dam_id").alias("dam"), "couple")
    children = settle(roots.join(named, F.col("sire_id").eqNullSafe(F.col("sire")) & F.col("dam_id").eqNullSafe(F.col("dam")), "left").select("row", "couple"))
    return couples.select("couple", "tree"), children


def pedigree_rows(documents: DataFrame, generations: int = 5) -> DataFrame:
    """The documents as rows: root, path (`SD` for the sire's dam), gen, node, the facts, relations and relation_parts."""
    def at(path: tuple[str, ...]) -> Column:
        node = F.col("document")
        for letter in path:
            node = node["sire" if letter == "S" else "dam"]
        return node
    record = [f.name for f in documents.schema["document"].dataType if f.name not in ("sire", "dam")]
    places = [path for gen in range(generations) for path in product("SD", repeat=gen)]
    nodes = F.array(*[F.struct(F.lit("".join(p)).alias("path"), F.lit(len(p)).alias("gen"), *[at(p)[c].alias(c) for c in record]) for p in places])
    return documents.select("root", F.inline(F.filter(nodes, lambda n: n["id"].isNotNull()))).withColumnRenamed("id", "node")


def _by_kind(relations: Column) -> Column:
    """For each kind in a list of relations: n_rows, sum_ids, first_label and last_label."""
    alike = F.transform(F.array_distinct(relations["relation"]), lambda kind: F.filter(relations, lambda r: r["relation"] == kind))
    def total(ids: Column) -> Column:
        return F.aggregate(ids, F.lit(None).cast("bigint"), lambda sum_, x: F.coalesce(sum_ + x, sum_, x))
    return F.transform(alike, lambda some: F.struct(
        some[0]["relation"].alias("relation"), F.size(some).cast("bigint").alias("n_rows"), total(some["related_id"]).alias("sum_ids"),
        F.array_min(some["label"]).alias("first_label"), F.array_max(some["label"]).alias("last_label")))


def merged_kinds(totals: DataFrame, *keys: str) -> DataFrame:
    """One row for each of `keys` and kind from the totals of several lists."""
    return totals.groupBy(*keys, "relation").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("sum_ids").alias("sum_ids"), F.min("first_label").alias("first_label"), F.max("last_label").alias("last_label"))


def pedigree_relations(rows: DataFrame, parts: DataFrame, by_kind: bool = False) -> DataFrame:
    """(root, path, node, relation, related_id, label) of every animal at every place, the parts beyond the documents included.

    With `by_kind`, n_rows, sum_ids, first_label and last_label of each kind at each place instead of its relations: every list is
    summed up where it stands, and only places with parts beyond the documents are grouped.
    """
    keys = ["root", "path", "node"]
    listed = F.inline(_by_kind(F.col("relations")) if by_kind else F.col("relations"))
    beyond = parts.where("part > 0").select(F.col("dog_id").alias("node"), listed)
    if beyond.isEmpty():
        return rows.select(*keys, listed)
    if not by_kind:
        beyond = rows.where("relation_parts > 1").select(*keys).join(parts.where("part > 0").select(F.col("dog_id").alias("node"), "relations"), "node")
        return rows.select(*keys, listed).unionByName(beyond.select(*keys, listed))
    more = rows.where("relation_parts > 1")
    beyond = more.select(*keys).join(settle(merged_kinds(beyond, "node")), "node")
    return rows.where("relation_parts <= 1").select(*keys, listed).unionByName(merged_kinds(more.select(*keys, listed).unionByName(beyond), *keys))
