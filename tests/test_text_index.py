"""Search over stored grams: the same rows as the plain test, and few rows tested."""

import random

import pytest
from pyspark.sql import functions as F

from studbook.operators import search, text_index
from studbook.operators.search import SEARCH_COLUMNS

ROW = "id bigint, registered_name string, call_name string, dam_name string, gram string, held int"
TERMS = ["Arctic", "ab", "arc_ic", "b%c%A", "100\\%", "a\\_b", "\\\\x", "\\bca", "ÉTÉ", "straße", "İstan", "ΣΑΣ", "abcabcabcabcabcabc", "zzzz", "%", "___", "no such name", None, ""]


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    def text():
        return rng.choice([None, "", "a", "Arctic Fox", "ARCTIC", "100% true", "a_b", "axb", "\\x", "été ÉTÉ", "STRASSE Straße", "İstanbul istan", "σας ΣΑΣ", "".join(rng.choice("abcABC ") for _ in range(12))])
    rows = [(i, text(), text(), text(), "g", i) for i in range(400)] + [(None, "Arctic", None, None, "g", 0), (7, "again Arctic", None, None, "g", 0), (500, "abc" * 50_000, None, None, None, None)]
    return spark.createDataFrame(rows + rows[:3], ROW).cache()


@pytest.fixture(scope="module")
def index(table):
    return text_index.build_index(table)


@pytest.mark.parametrize("term", TERMS)
def test_same_rows_as_the_plain_test(table, index, term):
    got = sorted(map(tuple, text_index.search_text(table, index, term).collect()), key=repr)
    assert got == sorted(map(tuple, search.filter_search_text(table, term).collect()), key=repr)


def test_few_rows_are_tested(spark):
    """A term of six letters lets at most a twentieth of the rows through; grams are asked for in the scan."""
    letters = F.translate(F.md5(F.col("id").cast("string")), "0123456789", "ghijklmnop")
    dogs = spark.range(5000).select("id", F.concat(F.lit("Arctic "), letters).alias("registered_name"))
    index = text_index.build_index(dogs)
    term = dogs.where("id = 77").first()["registered_name"][10:16]
    found = text_index.candidates(spark, index, term)
    assert 1 <= found.count() <= 250
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString()
    assert text_index.search_text(dogs, index, term).where("id = 77").count() == 1


def test_literal_runs():
    assert text_index.literal_runs("%ab\\%c_d\\\\%%e") == ["ab%c", "d\\", "e"]


def test_empty_table_and_missing_columns(spark):
    none = spark.createDataFrame([], "id bigint, call_name string")
    index = text_index.build_index(none)
    assert index.columns == ["call_name"] and set(index.columns) < set(SEARCH_COLUMNS)
    assert text_index.search_text(none, index, "abc").count() == 0
