"""Nested pedigree documents against plain recursion."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from studbook.operators import pedigrees as ped
from studbook.session import shared_folder

DOG = "id bigint, sire_id bigint, dam_id bigint, uuid string, registered_name string, call_name string, sex int, color string, date_of_birth date"
PROFILE = "dog_id bigint, relation string, related_id bigint, label string"


def cases(size, seed):
    """Random parents, some of them no rows; animal 3 holds a third of all relations, some relations are stated twice."""
    rng = random.Random(seed)
    def parent(i):
        return rng.choice([None, 999] + list(range(max(1, i - 6), i)) * 2) if i > 1 else None
    dogs = [(i, parent(i), parent(i), f"u{i}", None if i % 7 == 0 else f"n{i}", None, i % 2 + 1, None, None) for i in range(1, size + 1)]
    relations = [(3 if rng.random() < 0.33 else rng.randint(1, size), rng.choice(["owner", "title", "sibling"]), rng.randint(1, 50), rng.choice([None, "x", "y"])) for _ in range(200)]
    return dogs, relations + relations[:20] + [(None, "owner", 1, "x"), (2, None, None, None)]


def plain(dogs, relations, root, generations):
    table = {d[0]: d for d in dogs}
    listed = sorted({r[1:] for r in relations if r[0] is not None and r[1] is not None and r[0] == root}, key=lambda r: (r[0], r[1], r[2] is not None, r[2] or ""))
    if root not in table or generations == 0:
        return None
    found = {"id": root, "registered_name": table[root][4], "relations": listed}
    if generations > 1:
        found |= {role: plain(dogs, relations, parent, generations - 1) for role, parent in zip(("sire", "dam"), table[root][1:3])}
    return found


def shape(document):
    if document is None:
        return None
    listed = [(r["relation"], r["related_id"], r["label"]) for r in document["relations"]]
    found = {"id": document["id"], "registered_name": document["registered_name"], "relations": listed}
    return found | {role: shape(document[role]) for role in ("sire", "dam") if role in document}


@pytest.mark.parametrize("generations", [1, 2, 4])
def test_documents_equal_recursion(spark, generations):
    dogs, relations = cases(30, generations)
    parts = ped.relation_parts(spark.createDataFrame(relations, PROFILE), part_rows=1000)
    documents = ped.pedigree_documents(spark.createDataFrame(dogs, DOG), parts, generations)
    got = {r["root"]: shape(r["document"].asDict(recursive=True)) for r in documents.collect()}
    assert got == {d[0]: plain(dogs, relations, d[0], generations) for d in dogs}


def places(document, path=""):
    if document:
        yield path, document
        for letter, role in (("S", "sire"), ("D", "dam")):
            yield from places(document.get(role), path + letter)


def test_parts_beyond_the_documents_are_kept(spark):
    dogs, relations = cases(25, 9)
    parts = ped.relation_parts(spark.createDataFrame(relations, PROFILE), part_rows=4).cache()
    of_hot = [r for r in parts.collect() if r["dog_id"] == 3]
    assert len(of_hot) > 5 and max(len(r["relations"]) for r in of_hot) < 20
    chosen = spark.createDataFrame([(25,), (24,), (24,), (None,), (777,)], "id bigint")
    rows = ped.pedigree_rows(ped.pedigree_documents(spark.createDataFrame(dogs, DOG), parts, 4, chosen), 4)
    got = sorted(tuple(map(str, r)) for r in ped.pedigree_relations(rows, parts).collect())
    want = [(root, path, node["id"], *r) for root in (24, 25) for path, node in places(plain(dogs, relations, root, 4)) for r in node["relations"]]
    assert got == sorted(tuple(map(str, r)) for r in want)


@pytest.mark.parametrize("part_rows", [4, 1000])
def test_totals_by_kind_equal_the_grouped_relations(spark, part_rows):
    dogs, relations = cases(25, 9)
    relations += [(7, "owner", None, None), (8, "gift", None, "z"), (8, "gift", None, "a")]
    parts = ped.relation_parts(spark.createDataFrame(relations, PROFILE), part_rows=part_rows).cache()
    rows = ped.pedigree_rows(ped.pedigree_documents(spark.createDataFrame(dogs, DOG), parts, 4), 4)
    keys = ["root", "path", "node", "relation"]
    want = ped.pedigree_relations(rows, parts).groupBy(*keys).agg(F.count(F.lit(1)), F.sum("related_id"), F.min("label"), F.max("label"))
    got = ped.pedigree_relations(rows, parts, by_kind=True).select(*keys, "n_rows", "sum_ids", "first_label", "last_label")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_several_records_of_an_id_give_a_document_for_each_choice(spark):
    dogs = [(1, None, None, "u1", "a", None, 1, None, None), (1, None, None, "u1", "b", None, 1, None, None), (2, 1, 999, "u2", "c", None, 2, None, None), (3, 1, 2, "u3", "d", None, 1, None, None)]
    parts = ped.relation_parts(spark.createDataFrame([(1, "owner", 5, "x")], PROFILE))
    documents = ped.pedigree_documents(spark.createDataFrame(dogs, DOG), parts, 3)
    names = documents.where("root = 3").select("document.sire.registered_name", F.col("document.dam.sire.registered_name").alias("above"), F.size("document.dam.sire.relations").alias("n"))
    assert sorted(map(tuple, names.collect())) == [("a", "a", 1), ("a", "b", 1), ("b", "a", 1), ("b", "b", 1)]
    assert documents.where("root = 1 and document.sire is null and document.dam is null").count() == 2 and documents.where("root = 2").count() == 2


def test_relations_are_written_once_however_many_levels_hold_them(spark):
    dogs = [(i, i - 2 if i > 2 else None, i - 1 if i > 2 else None, None, None, None, 1, None, None) for i in range(1, 31)]
    rng = random.Random(4)
    parts = ped.relation_parts(spark.createDataFrame([(i, "owner", n, rng.randbytes(500).hex()) for i in range(1, 31) for n in range(20)], PROFILE)).cache()
    parts.count()
    def written():
        return {path: path.stat().st_size for path in Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet")}
    before = written()
    documents = ped.pedigree_documents(spark.createDataFrame(dogs, DOG), parts, 5)
    grown = sum(size for path, size in written().items() if path not in before)
    assert 300_000 < grown < 900_000, grown
    assert documents.where("root = 30").select(F.size("document.sire.dam.sire.dam.relations").alias("n")).first()["n"] == 20


def test_hot_animal_is_dealt_by_part(spark):
    """The grouping that makes the lists must not take over partitions of whole animals."""
    plan = ped.relation_parts(spark.createDataFrame(cases(5, 1)[1], PROFILE))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(dog_id" in plan and any("hashpartitioning(dog_id" in line and ", part" in line for line in plan.splitlines())


def test_empty_tables(spark):
    none = ped.relation_parts(spark.createDataFrame([], PROFILE))
    assert ped.pedigree_documents(spark.createDataFrame([], DOG), none, 3).count() == 0
    row = ped.pedigree_documents(spark.createDataFrame(cases(1, 1)[0], DOG), none, 3).select("document.relations", F.col("document.sire").isNull().alias("alone")).first()
    assert row["relations"] == [] and row["alone"]
    with pytest.raises(ValueError):
        ped.pedigree_documents(spark.createDataFrame([], DOG), none, 9)
