"""Whole batches against plain readings of the rules."""

import random

import pytest

from studbook.operators import elements, ingest as ing
from studbook.operators.components import components

RECORD = ("rec_id bigint, registered_name string, uuid string, date_of_birth date, sex int, color string, sire_name string, dam_name string, source string")
DOG = ("id bigint, registered_name string, uuid string, date_of_birth date, sex int, color string, sire_name string, dam_name string, source string, "
       "sire_id bigint, dam_id bigint, has_conflicts boolean")
PERSON = "id bigint, name string, uuid string, is_main_owner boolean"


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.fixture()
def state(spark):
    def empty(schema):
        return spark.createDataFrame([], schema)
    dogs = spark.createDataFrame([(1, "Old Rex", "u1", None, 1, "red", None, None, "a", None, None, False), (2, "Old Bella", "u2", None, 2, None, None, None, "a", None, None, False)], DOG)
    owners = spark.createDataFrame([(7, "Ann", "ann", True)], PERSON)
    links = spark.createDataFrame([(1, 7), (2, 7)], "dog_id bigint, person_id bigint")
    litters = "id bigint, dam_id bigint, sire_id bigint, date_of_birth date, male_count bigint, female_count bigint"
    return ing.State(dogs, owners, empty(PERSON.replace("main_owner", "breeder")), links, empty(links.schema), empty("dog_id bigint, sibling_id bigint"), empty(litters), empty("id bigint, field string, source string, value string"))


def batch(spark, records, relations=(), people=()):
    from datetime import date
    full = [(i, n, u, date(2020, 1, d) if d else None, s, c, sire, dam, "b") for i, n, u, d, s, c, sire, dam in records]
    return ing.Batch(spark.createDataFrame(full, RECORD), spark.createDataFrame(list(relations), "rec_id bigint, role string, other_rec bigint"),
                     spark.createDataFrame([(i, r, p, n.lower(), n) for i, r, p, n in people], "rec_id bigint, role string, position int, uuid string, name string"))


def test_components_of_random_edges(spark):
    for seed in range(3):
        rng = random.Random(seed)
        edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(90 + 60 * seed)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(1, 80)]
        root = {x: x for e in edges for x in e}
        for _ in range(len(root)):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        expected = {(x, r) for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
        assert {tuple(r) for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == expected
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_records_of_a_batch_match_each_other(spark):
    """By equal name, identifier, birth and parents, and similar names in a chain; unnamed records stay alone."""
    records = batch(spark, [
        (1, "Polar Star", "a", None, 1, "", None, None), (2, "Polar Star", "b", None, 1, "", None, None), (3, "Other Name", "b", None, 1, "", None, None),
        (4, "First Pup", "c", 5, 1, "", "S", "D"), (5, "Whelp Two", "d", 5, 1, "", "S", None), (6, "Third", "e", 6, 1, "", "S", "D"),
        (7, "abcdefghij", "f", None, 1, "", None, None), (8, "abcdefghkk", "g", None, 1, "", None, None), (9, "abcdefkkkk", "h", None, 1, "", None, None),
        (10, "", "a", None, 1, "", None, None), (11, None, "a", None, 1, "", None, None), (12, " polar star ", "i", None, 1, "", None, None)]).records
    assert dict(rows(ing.batch_groups(records), "rec_id", "leader")) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 7, 10: 10, 11: 11, 12: 1}


def test_levels_put_parents_first_and_circles_last(spark):
    animals = spark.createDataFrame([(i,) for i in range(9)], "key bigint")
    edges = spark.createDataFrame([(1, 0), (2, 1), (2, 0), (3, 2), (5, 6), (6, 5), (7, 5), (8, 8), (2, 1)], "key bigint, parent bigint")
    assert dict(rows(ing.insert_levels(animals, edges), "key", "level")) == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0, 8: 0, 5: 4, 6: 4, 7: 4}
    assert ing.insert_levels(animals.limit(0), edges.limit(0)).count() == 0


def test_a_batch_of_relatives(spark, state):
    """A known sire, an unknown dam on two pages, their puppies, owners and siblings."""
    b = batch(spark, [
        (1, "Old Rex", "x1", None, 1, "black", None, None), (2, "New Luna", "x2", None, 2, "", None, None), (3, "New Luna", "x3", None, 2, "white", None, None),
        (4, "Pup One Alpha", "x4", 3, 1, "grey", "Old Rex", "New Luna"), (5, "Zweite Beta", "x5", 4, 2, None, "Old Rex", "New Luna")],
        [(4, "sire", 1), (4, "dam", 3), (5, "sire", 1), (5, "dam", 2), (4, "sibling", 5), (2, "puppy", 4), (3, "puppy", 4), (2, "puppy", 5), (2, "sibling", 3)],
        [(1, "owner", 0, "Bob"), (4, "owner", 0, "Ann"), (4, "owner", 1, "Cid"), (5, "breeder", 0, "Bob")])
    after, animals = ing.ingest(state, b)
    ids = {r.rec_id: r.id for r in animals.collect()}
    luna, one, two = ids[2], ids[4], ids[5]
    assert ids[1] == 1 and ids[3] == luna == 3 and {one, two} == {4, 5}
    dogs = {r.id: r for r in after.registry.collect()}
    assert sorted(dogs) == [1, 2, 3, 4, 5]
    assert (dogs[one].sire_id, dogs[one].dam_id, dogs[two].sire_id, dogs[two].dam_id) == (1, luna, 1, luna)
    assert dogs[luna].color == "white" and dogs[1].color == "red" and {i for i, d in dogs.items() if d.has_conflicts} == {1}
    assert rows(after.conflicts, "id", "field", "source", "value") == [(1, "color", "a", "red"), (1, "color", "b", "black")]
    owners = {r.id: r.name for r in after.owners.collect()}
    assert owners[7] == "Ann" and sorted(owners.values()) == ["Ann", "Bob", "Cid"]
    assert sorted((r.dog_id, owners[r.person_id]) for r in after.owner_links.collect()) == sorted([(1, "Bob"), (2, "Ann"), (one, "Ann"), (one, "Cid")])
    breeders = {r.id: r.name for r in after.breeders.collect()}
    assert [(r.dog_id, breeders[r.person_id]) for r in after.breeder_links.collect()] == [(two, "Bob")]
    assert rows(after.siblings, "dog_id", "sibling_id") == [(one, two)]
    litters = {r.id: (r.sire_id, r.dam_id, r.date_of_birth.day, r.male_count, r.female_count) for r in after.litters.collect()}
    assert sorted(litters.values()) == [(None, luna, 3, 1, 0), (None, luna, 4, 0, 1)]
    assert {i: litters[d.birth_litter_id][2] for i, d in dogs.items() if d.birth_litter_id} == {one: 3, two: 4}


def test_a_batch_given_twice_changes_nothing_more(spark, state):
    b = batch(spark, [(1, "Fresh Wind", "y1", 7, 2, "red", None, None), (2, "Little Gust", "y2", 9, 1, "red", None, "Fresh Wind")], [(2, "dam", 1), (1, "puppy", 2)], [(1, "owner", 0, "Ann")])
    once, _ = ing.ingest(state, b)
    again, _ = ing.ingest(once, b)
    for table in ("registry", "owners", "owner_links", "siblings", "litters", "conflicts"):
        first, second = getattr(once, table), getattr(again, table)
        assert rows(first, *sorted(first.columns)) == rows(second, *sorted(first.columns)), table


def test_an_empty_batch(spark, state):
    after, animals = ing.ingest(state, batch(spark, []))
    assert animals.count() == 0 and after.registry.count() == 2 and after.owner_links.count() == 2 and after.litters.count() == 0


def test_pages_of_a_batch_are_parsed_once(spark, monkeypatch):
    """Labels, people, siblings and puppies come from one pass over the pages."""
    passes, own = [], elements._parsed
    monkeypatch.setattr(elements, "_parsed", lambda *given: passes.append(given[1]) or own(*given))
    html = "<h1 itemprop=name>{0}</h1><div class=titlename><h1 itemprop=name>{0}</h1></div><div class=textLabel>Владелец:</div><div class=textDescription><a href=o>Ann</a></div><div class=siblings>{1}</div><div class=children>{2}</div>"
    link = "<a href='details.php?name={}'>x</a>".format
    own_pages = spark.createDataFrame([(1, "http://b/details.php?name=a", html.format("Rex", link("b"), "")), (2, "http://b/details.php?name=b", html.format("Bea", "", link("a") + link("c")))], "page_id bigint, url string, html string")
    b = ing.read_pages(own_pages, "http://b/", "s")
    assert len(passes) == 1
    assert {(r.rec_id, r.registered_name) for r in b.records.collect()} == {(1, "Rex"), (2, "Bea")}
    assert rows(b.relations, "rec_id", "role", "other_rec") == [(1, "sibling", 2), (2, "puppy", 1)]
    assert rows(b.people, "rec_id", "role", "name") == [(1, "owner", "Ann"), (2, "owner", "Ann")]
