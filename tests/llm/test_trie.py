"""The trie of conversation prefixes against plain dictionaries."""

import random

import pytest

from llm_small import SMALL, read
from plain_trie import expected, rebuilt
from studbook.llm import prefixtrie, queries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, digests array<binary>, words array<int>"


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables in many partitions, so that most nodes are merged across them."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def found(frame):
    return sorted([tuple(r) for r in frame.select(COLUMNS).collect()], key=repr)


def test_query_equals_plain_tries(spark):
    assert found(queries.op12_prefix_trie(spark, SMALL)) == expected(rebuilt(read("conversations", "conv_id", "turn", "role", "text")))


def sequences(spark, made):
    """Turns are numbers; turn k has k words."""
    rows = [(c, [t.to_bytes(16, "big") for t in turns], list(turns)) for c, turns in made.items()]
    return spark.createDataFrame(rows, SCHEMA)


def plain(made):
    return expected({c: [("r", "w " * t + f" \n") if t else ("", "") for t in turns] for c, turns in made.items()})


@pytest.mark.parametrize("seed", range(6))
def test_random_tries(spark, seed):
    """Few turn values give deep shared prefixes, conversations that end inside others, and many copies."""
    rng = random.Random(seed)
    made = {rng.randrange(-500, 100000): [rng.randrange(1, 2 + seed % 3) for _ in range(rng.randrange(0, 9))] for _ in range(300)}
    assert found(prefixtrie.trie(sequences(spark, made))) == plain(made)


def test_a_hot_conversation_and_a_giant_one(spark):
    made = {i: [1, 2, 3] for i in range(2000)} | {5000 + i: [1, 2, 3, *[4] * (i % 5)] for i in range(500)} | {9000: [1] * 3000, 9001: [1] * 2990, 9002: []}
    assert found(prefixtrie.trie(sequences(spark, made))) == plain(made)


def test_small_tables(spark):
    assert found(prefixtrie.trie(sequences(spark, {}))) == [] and found(prefixtrie.trie(spark.createDataFrame([], SCHEMA))) == []
    for made in ({1: []}, {1: [], 2: []}, {7: [1, 2]}, {1: [1], 2: [1, 1]}):
        assert found(prefixtrie.trie(sequences(spark, made))) == plain(made)


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(0, None, None, None), (0, 1, "user", "a\tb"), (0, 1, "user", "a\tb"), (0, 2, "", ""), (20, None, "user", None), (21, 3, "user", "x"), (23, 3, "user", "x"), (25, 3, "user", None), (25, 3, "assistant", "long " * 200000),
            (None, 1, "user", "x"), (-7, 1, "user", "neg"), (-20, 0, "user", "base"), (-1, 5, "é", "日本 語")]
    rows += [(40 + i, t, "user", "same text") for i in range(30) for t in range(i % 6)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, digest string")
    turns = prefixtrie.turn_digests(frame)
    heads = queries.trie_heads()
    got = prefixtrie.trie(prefixtrie.with_shared_heads(turns, *heads, most=3))
    # Ties of one turn go by role, then by digest; here equal turns differ by role or are equal rows.
    assert found(got) == expected(rebuilt(rows))


def test_sql_gives_the_same(spark):
    import duckdb
    from studbook.llm.conversation_sql import TRIE
    connection = duckdb.connect()
    connection.sql(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    assert sorted(connection.sql(TRIE).fetchall(), key=repr) == found(queries.op12_prefix_trie(spark, SMALL))
