"""Conflicts, merging, upserts, snapshots and streams."""

import pytest
from pyspark.sql import functions as F

from small_tables import SMALL
from studbook.operators import ancestry as anc, conflicts as con, incremental as inc, search, upsert as up
from studbook.session import new_folder
from studbook.sources import feeds, sinks
from studbook.sources.derived import Tables
from studbook.streaming import listing as ls

DOG = "id bigint, registered_name string, color string, weight double, source string, has_conflicts boolean"


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.fixture()
def dogs(spark):
    return spark.createDataFrame([(1, "A", "red", 0.0, "a", True), (2, "B", "", 12.5, None, False), (3, "C", None, None, "a", False)], DOG)


def test_every_animal_gives_one_incoming_record(spark):
    tables = Tables(spark, SMALL)
    held = [r.id for r in tables("registry").select("id").collect()]
    assert sorted(r.rec_id for r in tables("incoming").select("rec_id").collect()) == sorted(held)


def test_conflicts_and_merge(spark, dogs):
    records = spark.createDataFrame([(7, "A", "blue", 9.0, "b"), (8, "BB", "", 0.0, "b"), (9, "BB", "grey", 3.0, "c")],
                                    "rec_id bigint, registered_name string, color string, weight double, source string")
    matches = spark.createDataFrame([(7, 1), (8, 2), (9, 2)], "rec_id bigint, matched_id bigint")
    found = con.detect_conflicts(dogs, records, matches)
    assert rows(found, "id", "field", "old_source", "old_value", "new_source", "new_value") == [
        (1, "color", "a", "red", "b", "blue"), (1, "weight", "a", "0.0", "b", "9.0"), (2, "registered_name", "unknown", "B", "b", "BB"),
        (2, "registered_name", "unknown", "B", "c", "BB"), (2, "weight", "unknown", "12.5", "b", "0.0"), (2, "weight", "unknown", "12.5", "c", "3.0")]
    merged = con.merge_fill_missing(dogs, records, matches)
    assert rows(merged, "id", "color", "weight") == [(1, "red", 9.0), (2, "grey", 12.5), (3, None, None)]
    assert rows(con.merge_fill_missing(merged, records, matches), *merged.columns) == rows(merged, *merged.columns)
    held = con.accumulate_conflicts(spark.createDataFrame([(1, "color", "b", "old")], "id bigint, field string, source string, value string"), found)
    nested = {r.id: r.conflicts for r in con.as_map(held).collect()}
    assert nested[1]["color"] == {"a": "red", "b": "blue"}
    assert nested[2]["weight"] == {"unknown": "12.5", "b": "0.0", "c": "3.0"}


def test_resolve_then_undo_restores(spark, dogs):
    held = spark.createDataFrame([(1, "color", "a", "red"), (1, "color", "b", "blue")], "id bigint, field string, source string, value string")
    chosen = spark.createDataFrame([(1, "blue", None), (3, "white", 4.0)], "dog_id bigint, color string, weight double")
    table, log, left = con.resolve_conflicts(dogs, chosen, held, F.current_date())
    assert rows(table, "id", "color", "weight", "has_conflicts") == [(1, "blue", 0.0, False), (2, "", 12.5, False), (3, "white", 4.0, False)]
    assert left.count() == 0
    back, rest, conflicts = con.undo_merge(table, log, log.select("log_id", "dog_id").distinct(), left)
    assert rows(back, *dogs.columns) == rows(dogs, *dogs.columns)
    assert rest.count() == 0 and rows(conflicts, "id", "field", "source", "value") == rows(held, "id", "field", "source", "value")
    wrong = spark.createDataFrame([(1, 3)], "log_id bigint, dog_id bigint")
    assert rows(con.undo_merge(table, log, wrong, left)[0], *dogs.columns) == rows(table, *dogs.columns)


def test_two_resolutions_have_their_own_log(spark, dogs):
    held = spark.createDataFrame([(1, "color", "a", "red"), (1, "color", "b", "blue")], "id bigint, field string, source string, value string")
    first = spark.createDataFrame([(1, "blue"), (1, "azure")], "dog_id bigint, color string")
    table, log, left = con.resolve_conflicts(dogs, first, held, F.current_date())
    assert table.count() == 3 and rows(table.filter("id = 1"), "color") == [("blue",)]
    second = spark.createDataFrame([(1, "green", "X")], "dog_id bigint, color string, source string")
    table2, log2, left2 = con.resolve_conflicts(table, second, left, F.current_date(), held_log=log)
    assert not {r.log_id for r in log.collect()} & {r.log_id for r in log2.collect()}
    later = spark.createDataFrame([(1, "color", "b", "new")], left2.schema)
    # The undo of both restores a field outside the conflict list and replaces a conflict found since.
    whole = log.unionByName(log2)
    back, rest, conflicts = con.undo_merge(table2, whole, whole.select("log_id", "dog_id").distinct(), left2.unionByName(later))
    assert rows(back, *dogs.columns) == rows(dogs, *dogs.columns) and rest.count() == 0
    assert rows(conflicts, "id", "field", "source", "value") == rows(held, "id", "field", "source", "value")


def test_repeated_requests_keep_one_row_per_animal(spark, dogs):
    twice = spark.createDataFrame([(1, "x", 1), (1, "w", 2), (2, None, 1)], "id bigint, notes string, position int")
    assert rows(up.patch_notes(dogs, twice, "position"), "id", "notes") == [(1, "w"), (2, None), (3, None)]
    changed = up.update_overwrite(dogs, twice.withColumnRenamed("notes", "color"), ["color"], position="position")
    assert rows(changed, "id", "color") == [(1, "w"), (2, None), (3, rows(dogs.filter("id = 3"), "color")[0][0])]
    parents = dogs.withColumns({"sire_id": F.lit(None).cast("bigint"), "dam_id": F.lit(None).cast("bigint")})
    found = spark.createDataFrame([(1, 9, None), (1, None, 8), (1, 7, None)], "id bigint, sire_id bigint, dam_id bigint")
    assert rows(up.link_parents(parents, found), "id", "sire_id", "dam_id") == [(1, 7, 8), (2, None, None), (3, None, None)]
    values = spark.createDataFrame([(1, 0.5), (1, 0.5)], "root bigint, coi double")
    assert anc.inbreeding_writeback(dogs.withColumn("coi", F.lit(None).cast("double")), values, F.current_date()).count() == 3


def test_records_without_uuid_are_all_kept(spark):
    registry = spark.createDataFrame([(4, "u", "A")], "id bigint, uuid string, registered_name string")
    records = spark.createDataFrame([(1, None, "B"), (2, None, "C"), (3, "", "D"), (5, "v", "E"), (6, "v", "F")], "rec_id bigint, uuid string, registered_name string")
    matches = records.select("rec_id", F.lit(None).cast("bigint").alias("matched_id"))
    new = up.upsert_registry(registry, records, matches)
    assert rows(new, "registered_name") == [("A",), ("B",), ("C",), ("D",), ("E",)]
    assert sorted(r.id for r in new.collect()) == [4, 5, 6, 7, 8]


def test_positions_count_over_all_rows(spark):
    table = spark.range(1000).repartition(7).withColumn("name", F.when(F.col("id") % 10 != 0, F.col("id") % 13))
    placed = search.with_position(search.sort_dynamic(table, "name", "desc")).collect()
    want = sorted(((r.name is not None, -(r.name or 0), r.id) for r in placed))
    assert [r.id for r in sorted(placed, key=lambda r: r.position)] == [w[2] for w in want]
    assert sorted(r.position for r in placed) == list(range(1, 1001))


def test_upsert_twice_is_once(spark):
    table = spark.createDataFrame([(5, 1, None, "x", 1), (9, 1, "n1", "x", 2)], "id bigint, dog_id bigint, ofa_number string, registry string, age_in_months int")
    batch = spark.createDataFrame([(1, None, "late", 7, 2), (1, None, "early", 6, 1), (2, "n2", "new", 8, 3), (2, None, "new", 9, 4)],
                                  "dog_id bigint, ofa_number string, registry string, age_in_months int, position int")
    once = up.upsert_medical(table, batch)
    assert rows(once, "dog_id", "ofa_number", "registry", "age_in_months") == sorted(
        [(1, None, "late", 7), (1, "n1", "x", 2), (2, "n2", "new", 8), (2, None, "new", 9)], key=repr)
    assert sorted(r.id for r in once.collect()) == [5, 9, 10, 11]
    assert rows(up.upsert_medical(once, batch), *once.columns) == rows(once, *once.columns)


def test_new_ids_are_dense_and_unique(spark):
    fresh = spark.range(5000).select(F.col("id").cast("string").alias("uuid"))
    ids = up.assign_ids(fresh, spark.range(11), F.col("uuid")).agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    assert tuple(ids) == (11, 5010, 5000)


def test_snapshot_versions(spark):
    root = new_folder(spark, "versions")
    sinks.publish_snapshot(spark.range(3), root, 1)
    sinks.publish_snapshot(sinks.read_snapshot(spark, root).filter("id > 0"), root, 2)
    sinks.publish_snapshot(sinks.read_snapshot(spark, root, 1).filter("id > 0"), root, 2)
    assert sinks.current_version(spark, root) == 2
    assert sinks.read_snapshot(spark, root).count() == 2 and sinks.read_snapshot(spark, root, 1).count() == 3


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_stream_gives_the_same_table(spark, files_per_batch):
    data = spark.range(400).selectExpr("if(id % 41 = 0, null, cast(id % 37 as string)) as uuid", "id as pos", "if(id % 9 = 0, null, id % 50 - 20) as at", "id / 7.0D as ratio",
                                       "timestamp_micros(id * 1234567) as seen", "array(id, null) as list")
    columns = ["uuid", "pos", "at", "ratio", "seen", "list"]
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    for part in range(4):
        data.filter(f"pos % 4 = {part}").coalesce(1).write.mode("append").parquet(folder)
    ls.stream_listing(ls.file_stream(spark, folder, data.schema, files_per_batch), root, F.col("at"), "pos")
    got = rows(ls.current_listing(spark, root, data.schema), *columns)
    assert got == rows(inc.latest_per_key(data, "uuid", F.col("at"), "pos"), *columns)
    # Nothing new: the same state, and no batch that changes anything.
    before = ls.listing_changes(spark, root).count()
    ls.stream_listing(ls.file_stream(spark, folder, data.schema, files_per_batch), root, F.col("at"), "pos")
    assert rows(ls.current_listing(spark, root, data.schema), *columns) == got and ls.listing_changes(spark, root).count() == before


def test_a_restarted_stream_goes_on_and_batches_cost_what_they_bring(spark):
    """Each start takes in one more file; a batch changes the animals it brings later rows of, and nothing else."""
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    schema = "uuid string, pos bigint, at timestamp, status string"
    for start in range(4):
        data = spark.range(30).selectExpr(f"concat('u', id * {start + 1} % 40) as uuid", f"{start} * 1000 + id as pos", f"timestamp_seconds(if(id % 5 = 0, 0, {start} * 100 + id)) as at", f"'s{start}' as status")
        data.coalesce(1).write.mode("append").parquet(folder)
        ls.stream_listing(ls.file_stream(spark, folder, schema), root, F.col("at"), "pos")
        everything = spark.read.schema(schema).parquet(folder)
        assert rows(ls.current_listing(spark, root, everything.schema), "uuid", "pos", "status") == rows(inc.latest_per_key(everything, "uuid", F.col("at"), "pos"), "uuid", "pos", "status")
        brought = ls.listing_changes(spark, root).filter(f"status = 's{start}'")
        assert 0 < brought.count() <= 30 and brought.select("batch").distinct().count() == 1


def test_stream_distinct_within_watermark(spark):
    data = spark.range(60).selectExpr("cast(id % 7 as string) as uuid", "timestamp_seconds(id) as at")
    folder, root = new_folder(spark, "in"), new_folder(spark, "out")
    data.write.parquet(folder)
    ls.stream_distinct(ls.file_stream(spark, folder, data.schema), root, "uuid", "1 hour", "at")
    assert spark.read.parquet(f"{root}/rows").count() == 7


def test_take_until_cutoff_is_the_literal_rule(spark):
    texts = ["20/1/2024, 10:00", "n/a", "19/1/2024, 10:00", "1/1/2024, 10:00", "20/1/2024, 09:00"]
    feed = spark.createDataFrame(list(enumerate(texts)), "pos bigint, modified_text string")
    as_of = F.lit("2024-01-20 12:00:00").cast("timestamp_ntz")
    assert [r.pos for r in inc.incr_take_until_cutoff(feed, as_of, 2).orderBy("pos").collect()] == [0, 1, 2]
    assert [r.pos for r in inc.incr_recent_window(feed, as_of, 2).orderBy("pos").collect()] == [0, 1, 2, 4]


def test_nested_documents_keep_depth(spark):
    docs = spark.createDataFrame([(1, '{"n":1,"sire":{"n":2,"sire":{"n":3,"dam":{"n":4,"dam":{"n":5,"dam":{"n":6}}}}},"dam":null}')], "root bigint, body string")
    found = feeds.nested_ancestor_docs(docs).select("path", F.get_json_object("animal", "$.n").alias("n"))
    assert rows(found, "path", "n") == [("", "1"), ("S", "2"), ("SS", "3"), ("SSD", "4"), ("SSDD", "5"), ("SSDDD", "6")]
    assert feeds.nested_ancestor_docs(docs, depth=2).count() == 2


def test_search_wildcards_and_bounds(spark):
    table = spark.createDataFrame([(1, "100% Dog"), (2, "100 Dog"), (3, None)], "id bigint, registered_name string")
    assert [r.id for r in search.filter_search_text(table, "100\\% d").collect()] == [1]
    assert [r.id for r in search.filter_search_text(table, "1_0").collect()] == [1, 2]
    assert search.filter_search_text(table, "").count() == 3
    assert [r.id for r in search.sort_dynamic(table, "registered_name", "desc").collect()][0] == 3
    assert search.sort_dynamic(table, "no_such_column") is table
    with pytest.raises(ValueError):
        search.page_offset(table, 1, 101)
