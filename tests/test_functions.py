"""Column functions on blank, null, malformed and non-padded values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from studbook.functions import dates, display, html, numbers, similarity, text


def values(spark, function, inputs):
    rows = [(i, v) for i, v in enumerate(inputs)]
    frame = spark.createDataFrame(rows, "n int, v string").select("n", function(F.col("v")).alias("out"))
    return [r.out for r in frame.orderBy("n").collect()]


@pytest.mark.parametrize("function, cases", [
    (dates.parse_date_multi, {
        "5 Dec 2022": datetime(2022, 12, 5), " 05/12/2022 ": datetime(2022, 12, 5), "2022-12-05": datetime(2022, 12, 5),
        "Dec 5, 2022": datetime(2022, 12, 5), "december 5, 2022": datetime(2022, 12, 5), "31/02/2020": None, "5 Dez 2022": None,
        "20221-1-1": None, "": None, None: None}),
    (dates.parse_datetime_us, {"2024-01-05": datetime(2024, 1, 5), "12/31/2024, 08:05": datetime(2024, 12, 31, 8, 5), "31/12/2024, 08:05": None}),
    (dates.parse_datetime_listing, {"22/6/2025, 20:24": datetime(2025, 6, 22, 20, 24), "6/22/2025, 20:24": None}),
    (dates.parse_date_ru, {"5 декабря 2022": datetime(2022, 12, 5), "5  Мая 2022": datetime(2022, 5, 5), "5 май 2022": None, "5 мая": None, "x мая 2022": None}),
    (dates.parse_date_dotted, {"05.12.2022.": datetime(2022, 12, 5), "5.1.2022": datetime(2022, 1, 5), "05.13.2022": None}),
    (dates.parse_date_cert, {"Jan 07 2020": datetime(2020, 1, 7), " Jan   7  2020 ": datetime(2020, 1, 7), "07 Jan 2020": None}),
    (numbers.parse_int, {" 12 ": 12, "-3": -3, "1.5": None, "": None, "99999999999": None, None: None}),
    (numbers.parse_float, {" 1.5 ": 1.5, "1.5d": None, "2e3": 2000.0, ".5": 0.5, "": None, "1,5": None}),
    (numbers.extract_inbreeding_text, {"F = 12.5%": 0.125, "F=3%": 0.03, "none": None, None: None}),
    (numbers.sex_code, {"Male": 1, "female": 2, "": 2}),
    (text.clean_text, {"\t a  b\n": "a b", "": ""}),
    (text.to_snake_case, {"OwnerName": "owner_name", "ABC": "a_b_c", "x": "x"}),
    (text.extract_call_name, {"Name (Rex) (b)": "Rex", "Name": None, "()": None}),
    (text.path_slug, {"/a/view/some-dog-720a0e40-3951-4538-b61d-3e2ba222c468": "some-dog", "/a/view/some-dog": None}),
    (text.slug_from_query, {"d.php?name=a&x=name=b": "b", "d.php": None}),
    (text.photo_medium_size, {"a_s.jpg": "a_m.jpg", "a_s.jpg?x": "a_s.jpg?x", None: ""}),
    (html.node_text, {" <b> a </b> &amp;lt; ": "a&lt;", "x&nbsp;": "x", None: None}),
])
def test_values(spark, function, cases):
    assert values(spark, function, list(cases)) == list(cases.values())


def test_next_page(spark):
    urls = ["http://x/r.php?a=1&name=&start=50&z=2", "http://x/r.php?a=1", "http://x/r.php?start=x"]
    assert values(spark, lambda c: text.next_page_url(c, 50), urls) == [
        "http://x/r.php?a=1&start=100&z=2", "http://x/r.php?a=1&start=50", None]


def test_similarity(spark):
    pairs = [("", ""), ("a", ""), (None, None), ("kitten", "sitting"), ("é", "e"), (" Rex ", "rex"), ("abcde", "abcdf")]
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "n int, a string, b string").select(
        "n", similarity.name_similarity(F.col("a"), F.col("b")).alias("s"), similarity.edit_distance(F.col("a"), F.col("b")).alias("d"),
        similarity.is_similar_name(F.col("a"), F.col("b"), 0.8).alias("like"))
    rows = frame.orderBy("n").collect()
    assert [round(r.s, 6) for r in rows] == [1.0, 0.0, 1.0, round(1 - 3 / 7, 6), 0.0, 0.4, 0.8]
    assert [r.d for r in rows] == [0, 1, 0, 3, 1, 3, 1]
    assert [bool(r.like) for r in rows] == [False, False, False, False, False, True, True]


def test_long_date(spark):
    frame = spark.sql("select timestamp_ntz '2022-05-05 14:30:00' as d")
    assert frame.select(dates.format_date_long(F.col("d"), True)).first()[0] == "5 мая 2022 г. в 14:30"
    assert frame.select(display.color_text(F.lit(""), F.lit("x"))).first()[0] == "—"
