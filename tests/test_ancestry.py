"""Set-based ancestry against a direct depth-first reading of the rules, on random parent graphs."""

import random

import pytest
from pyspark.sql import functions as F

from studbook.operators import ancestry as anc


def random_dogs(size, seed):
    rng = random.Random(seed)
    dogs = []
    for i in range(1, size + 1):
        older = list(range(max(1, i - 9), i))
        sire = rng.choice(older) if older and rng.random() < 0.85 else None
        dam = rng.choice(older) if older and rng.random() < 0.85 else None
        dogs.append((i, f"n{i}", sire, dam, rng.choice([None, 0.0, 0.125, 0.25])))
    return dogs


def reading(dogs, root, generations):
    """Members, first paths and coefficient by plain recursion."""
    table = {d[0]: d for d in dogs}
    members = {}

    def visit(i, depth):
        if i not in table or depth >= generations:
            return
        members[i] = depth
        visit(table[i][2], depth + 1)
        visit(table[i][3], depth + 1)

    def first(start, target):
        if start not in members:
            return None
        if start == target:
            return [start]
        for parent in table[start][2:4]:
            if parent:
                tail = first(parent, target)
                if tail:
                    return [start] + tail
        return None

    visit(root, 0)
    sire, dam = table[root][2:4]
    paths = {(side, a): first(p, a) for side, p in (("sire", sire), ("dam", dam)) if p for a in members}
    paths = {k: v for k, v in paths.items() if v}
    total = 0.0
    if sire and dam:
        for a in members:
            if ("sire", a) in paths and ("dam", a) in paths:
                steps = len(paths["sire", a]) + len(paths["dam", a]) - 2
                total += 0.5 ** (steps + 1) * (1 + (table[a][4] or 0.0))
    return members, paths, total


@pytest.mark.parametrize("generations", [1, 2, 4, 5, 7])
def test_first_paths_and_coefficient(spark, generations):
    dogs = random_dogs(45, generations)
    frame = spark.createDataFrame(dogs, "id bigint, registered_name string, sire_id bigint, dam_id bigint, coi double")
    paths = anc.side_paths(frame, generations)
    steps = {(r.root, r.side, r.node): r.steps for r in anc.lineage_first_path(paths).collect()}
    values = {r.root: r.coi for r in anc.inbreeding_from(paths, frame, frame.select("id")).collect()}
    visits = {(r.root, r.node): r.gen for r in anc.lineage_bounded_set(frame, generations).collect()}
    lists = {(r.root, r.node): (r.sire_path, r.dam_path) for r in anc.inbreeding_details(paths, frame).collect()}
    for root, *_ in dogs:
        members, expected, total = reading(dogs, root, generations)
        assert {n: g for (r, n), g in visits.items() if r == root} == members
        assert {(s, n): k for (r, s, n), k in steps.items() if r == root} == {k: len(v) - 1 for k, v in expected.items()}
        assert values[root] == pytest.approx(total)
        for (r, node), (over_sire, over_dam) in lists.items():
            if r == root:
                assert (over_sire, over_dam) == (expected["sire", node], expected["dam", node])


def test_chosen_roots_equal_whole_table(spark):
    frame = spark.createDataFrame(random_dogs(40, 3), "id bigint, registered_name string, sire_id bigint, dam_id bigint, coi double")
    ids = frame.filter("id % 4 = 0").select("id")
    some = {tuple(r) for r in anc.lineage_tree(frame, 6, ids).select("root", "path", "node").collect()}
    whole = {tuple(r) for r in anc.lineage_tree(frame, 6).filter("root % 4 = 0").select("root", "path", "node").collect()}
    assert some == whole
    assert {tuple(r) for r in anc.inbreeding(frame, 5, ids).select("root", "coi").collect()} == {
        tuple(r) for r in anc.inbreeding(frame, 5).filter("root % 4 = 0").select("root", "coi").collect()}


def test_levels_stay_below_the_binary_bound(spark):
    frame = spark.createDataFrame(random_dogs(40, 5), "id bigint, registered_name string, sire_id bigint, dam_id bigint, coi double")
    counts = anc.lineage_tree(frame, 6).groupBy("root", "gen").count().collect()
    assert all(r["count"] <= 2 ** r["gen"] for r in counts)


def test_cycle_ends(spark):
    """A path that returns to an animal has that animal's path as its beginning, so it never beats it."""
    frame = spark.createDataFrame([(1, "a", 2, 3, None), (2, "b", 2, 1, None), (3, "c", None, None, None)],
                                  "id bigint, registered_name string, sire_id bigint, dam_id bigint, coi double")
    paths = anc.lineage_first_path(anc.side_paths(frame, 3))
    assert {(r.side, r.node) for r in paths.filter("root = 1").collect()} == {("sire", 2), ("sire", 1), ("sire", 3), ("dam", 3)}


def test_first_paths_have_no_longest_length(spark):
    """A chain whose first path of 69 edges is far longer than the generation bound."""
    dogs = [(i, f"n{i}", i - 1 if i > 1 else None, i - 9 if i > 9 else None, None) for i in range(1, 71)]
    frame = spark.createDataFrame(dogs, "id bigint, registered_name string, sire_id bigint, dam_id bigint, coi double")
    paths = anc.side_paths(frame, 20, frame.filter("id = 70").select("id"))
    found = {(r.side, r.node): r.path for r in anc.lineage_first_path(paths).collect()}
    # Going by sires alone reaches every member over the sire's side, and over the dam's side from the dam on.
    assert found["sire", 1] == "S" * 69 and found["dam", 1] == "D" + "S" * 60
    assert len(found) == 69 + 61


def test_batch_reports_unknown_ids(spark):
    frame = spark.createDataFrame(random_dogs(20, 9), "id bigint, registered_name string, sire_id bigint, dam_id bigint, coi double")
    ids = spark.createDataFrame([(20,), (999,)], "id bigint")
    rows = {r.root: r.success for r in anc.inbreeding_batch(frame, ids, 4).collect()}
    assert rows == {20: True, 999: False}


def test_frontier_visits_each_page_once(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c"), ("c", "d")], "url string, link string")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {tuple(r) for r in anc.crawl_frontier(links, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 1), ("d", 2)} - {("d", 3)}


def test_node_labels(spark):
    frame = spark.createDataFrame([(1, None, 1, None, None, None)], "id bigint, registered_name string, sex int, date_of_birth date, sire_id bigint, dam_id bigint")
    nodes, edges = anc.lineage_graph(frame, 3)
    assert nodes.select(F.col("label")).first()[0] == "\nID: 1\nSex: M\nBorn: " and edges.count() == 0


def test_recomputing_after_changes_equals_a_full_run(spark):
    """Random parents, random edits, circles included: what is not touched keeps its value."""
    rng = random.Random(12)
    parents = {i: (rng.choice([None, *range(1, i)][:40]) if i > 1 else None, rng.choice([None, *range(1, i)][-12:]) if i > 2 else None) for i in range(1, 70)}
    edited = dict(parents)
    changed = sorted(rng.sample(range(5, 70), 4))
    for i in changed:
        edited[i] = (rng.randrange(1, 70), rng.choice([None, rng.randrange(1, i)]))

    def table(rows):
        return spark.createDataFrame([(i, f"n{i}", s, d, 0.01 * (i % 3)) for i, (s, d) in rows.items()], "id bigint, registered_name string, sire_id bigint, dam_id bigint, coi double")

    def values(frame):
        return {r.root: (round(r.coi, 12), r.common_ancestors) for r in frame.collect()}

    before, after = table(parents), table(edited)
    ids = spark.createDataFrame([(i,) for i in [*changed, 1000]], "id bigint")
    some = values(anc.inbreeding_after_changes(after, ids, 4))
    below, open_ids = set(changed), list(changed)
    while open_ids:
        at = open_ids.pop()
        for child in [i for i, pair in edited.items() if at in pair and i not in below]:
            below.add(child)
            open_ids.append(child)
    assert set(some) == below
    assert values(anc.inbreeding(before, 4)) | some == values(anc.inbreeding(after, 4))
