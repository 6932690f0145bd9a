"""Upserts into tables stored by buckets."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from studbook.operators import upsert as up
from studbook.session import new_folder
from studbook.sources.bucketed import BucketedTable


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


@pytest.fixture()
def people(spark):
    table = BucketedTable(spark, new_folder(spark, "people"), ("uuid",), buckets=32)
    table.create(spark.range(1, 4001).selectExpr("id", "concat('u', id) as uuid", "concat('Name ', id) as name"))
    return table


def upsert(held, batch, top):
    return up.upsert_people(held, batch, update=True, top=top)


def files(table):
    return {p: p.stat().st_mtime_ns for p in Path(table.root.removeprefix("file:")).glob("rows/*/*.parquet")}


def scanned(frame):
    """Bytes and files that the scans of a frame read, by its SQL metrics."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame.collect()
    metrics = plan.collectLeaves().apply(0).metrics()
    return metrics.apply("numFiles").value(), metrics.apply("filesSize").value()


def test_a_batch_changes_what_plain_upserts_change(spark, people):
    batch = spark.createDataFrame([("u5", "New 5", 1), ("x1", "Added", 1), ("x2", "Added 2", 1), ("u5", "Newer 5", 2), (None, "Nobody", 1)], "uuid string, name string, position int")
    expected = rows(up.upsert_people(people.read(), batch, update=True), "id", "uuid", "name")
    people.apply(batch, upsert)
    assert rows(people.read(), "id", "uuid", "name") == expected
    again = people.read().count()
    people.apply(batch.where("uuid = 'x1'"), upsert)
    assert people.read().count() == again and people.top().first()[0] == 4003
    people.apply(spark.createDataFrame([("x3", "Third", 1)], batch.schema), upsert)
    assert rows(people.read().where("uuid = 'x3'"), "id", "name") == [(4004, "Third")]


def test_a_batch_reads_and_writes_the_buckets_it_hits(spark, people):
    whole = scanned(people.read())
    batch = spark.createDataFrame([("u5", "New", 1), ("u77", "New", 1)], "uuid string, name string, position int")
    hit = scanned(people.hit(batch))
    assert whole[0] == 32 and hit[0] == 2 and hit[1] < 0.15 * whole[1]
    before = files(people)
    people.apply(batch, upsert)
    after = files(people)
    assert len(set(before) & set(after)) == 30 and all(before[p] == after[p] for p in set(before) & set(after))
    text = people.hit(batch)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in text and "_bucket" in text.split("PartitionFilters")[1][:200]


def test_empty_batches_and_tables(spark):
    table = BucketedTable(spark, new_folder(spark, "none"), ("uuid",), buckets=4)
    table.create(spark.createDataFrame([(1, "a", "A")], "id bigint, uuid string, name string"))
    table.apply(spark.createDataFrame([], "uuid string, name string, position int"), upsert)
    assert rows(table.read(), "id", "uuid", "name") == [(1, "a", "A")] and table.top().first()[0] == 1
