"""Plans that must stay cheap at scale: pushed filters, pruned columns, no pairwise joins."""

import __spark_entry__ as driver
import pytest
from small_tables import SMALL
from studbook.operators import ancestry as anc, search, similar_names
from studbook.session import new_folder
from studbook.sources.derived import Tables


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    path = new_folder(spark, "registry")
    Tables(spark, SMALL)("registry_ext").write.parquet(path)
    return spark.read.parquet(path)


def test_search_pushes_filters_and_prunes(stored):
    page = search.registry_search(stored, land_of_birth="NATION_7", sex=2, year=(1991, 1999), per_page=20).select("id", "registered_name")
    text = plan(page)
    assert "TakeOrderedAndProject" in text
    assert "EqualTo(land_of_birth,NATION_7)" in text and "EqualTo(sex,2)" in text and "GreaterThanOrEqual(year_of_birth,1991)" in text
    assert "photo_url" not in text.split("ReadSchema")[1]


def test_edges_read_three_columns(stored):
    text = plan(anc.parent_edges(stored))
    assert "sire_id:bigint,dam_id:bigint" in text
    assert "registered_name" not in text


def test_tree_expansion_doubles(stored):
    paths = anc.ancestor_paths(anc.parent_edges(stored), 4)
    assert plan(paths).count("Join") <= 12


@pytest.mark.parametrize("key", ["inbreeding", "match_cascade", "upsert_medical", "join_medical_search", "crawl_frontier", "lineage_list"])
def test_no_pairwise_joins(spark, key):
    text = plan(driver.queries()[key](spark, SMALL))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text or key == "upsert_medical"


def test_similar_names_are_joined_on_keys(spark, stored):
    """The plan behind the settled pairs of names: equal keys and cells, the distance as a condition of that join."""
    names = stored.selectExpr("lower(registered_name) as name").distinct()
    text = plan(similar_names.similar_pairs(names, names, 0.8))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert any("levenshtein" in line and "key" in line for line in text.splitlines() if "Join" in line)


def test_third_feed_sends_no_pages_to_the_driver(spark):
    assert "BroadcastHashJoin" not in plan(driver.queries()["map_source_c"](spark, SMALL))
