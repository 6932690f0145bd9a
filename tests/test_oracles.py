"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from small_tables import SMALL
from studbook.plans.check import compare, duck

RUNS, SQL = {k: run for k, run in driver.queries().items() if k in driver.QUERIES}, driver.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(RUNS) <= set(SQL)


@pytest.mark.parametrize("key", sorted(RUNS))
def test_query(spark, connection, key):
    good, note = compare(spark, connection, SMALL, RUNS[key], SQL[key])
    assert good, note


def test_entry(spark):
    assert driver.entry(spark).columns == ["id", "registered_name", "color", "date_of_birth", "sire_name"]
