"""Repair of turn structure against plain recursion and against all edits."""

import random

import pytest

from llm_small import SMALL, read
from plain_repair import damaged, edits, every_edit, expected, faults
from studbook.llm import queries, turnrepair

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
TURNS = "conv_id long, turn long, role string, text string, here boolean"


def found(frame):
    return sorted([tuple(r) for r in frame.select(COLUMNS).collect()], key=repr)


def test_query_equals_plain_repair(spark):
    got = found(queries.op13_structure_repair(spark, SMALL))
    assert got == expected(damaged(read("conversations", "conv_id", "turn", "role", "text"))) and any(r[6] for r in got)


def made(seed, conversations, most):
    rng = random.Random(seed)
    texts = ["", " \t", "No end", "Whole.", "Why?", "x. y", "Done!\n"]
    return {c: [(t, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]), rng.choice(texts)) for t in range(rng.randrange(1, most))] for c in range(conversations)}


def run(spark, conversations):
    rows = [(c, *row, True) for c, x in conversations.items() for row in x]
    random.Random(1).shuffle(rows)
    return found(turnrepair.repaired(spark.createDataFrame(rows, TURNS).repartition(5)))


def test_random_conversations(spark):
    conversations = made(3, 300, 14)
    assert run(spark, conversations) == expected(conversations)


def test_plain_recursion_tries_every_edit():
    for rows in made(4, 150, 5).values():
        assert edits(rows, faults(rows)) == every_edit(rows, faults(rows))


def test_state_goes_on_over_batches_and_steps_go_to_a_file(spark, monkeypatch):
    conversations = {c: x * 40 for c, x in made(5, 6, 14).items()}
    conversations = {c: [(t, role, f"{text} {t}." if t % 3 else text) for t, (_, role, text) in enumerate(x)] for c, x in conversations.items()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert run(spark, conversations) == expected(conversations)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")
    monkeypatch.setattr(turnrepair, "HELD_STEPS", 16)
    for c, rows in conversations.items():
        held = turnrepair.Conversation(c, turnrepair.Steps())
        for (turn, role, text), fault in zip(rows, faults(rows)):
            held.turn(turn, role, text, turnrepair.Fault[fault])
        assert held.file is not None and [held.row()] == expected({c: rows})


def test_a_giant_conversation(spark):
    rows = [(t, "user" if t % 2 else "assistant", f"Turn {t}" + "." * (t % 7 > 0)) for t in range(30_000)]
    got = run(spark, {1: rows})
    assert got[0][:6] == (1, 0, 0, 0, sum(t % 7 == 0 for t in range(30_000)), 0) and len(got[0][7]) >= 30_000
    assert run(spark, {1: rows[:900]}) == expected({1: rows[:900]})


@pytest.mark.parametrize("rows", [
    [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 0, "assistant", "b."), (1, None, "system", "Rules."), (1, None, None, None)],
    [(None, 1, "user", "a."), (None, None, "assistant", "b")], [(2, 2**60 + 1, "user", "a."), (2, 2**60 + 3, "user", "b."), (2, None, "user", "c.")],
    [(3, t, "user", "日本。 é!") for t in range(9)], [(4, 1, "", ""), (4, 2, "", "x.")], [(5, 1, "user", "word " * 300_000)], [(6, t, "user", "x.") for t in range(200)]])
def test_nulls_ties_repeats_and_long_texts(spark, rows):
    frame = spark.createDataFrame([(*r, 7, "z") for r in rows], "conv_id long, turn long, role string, text string, fault int, digest string")
    assert found(turnrepair.repaired(turnrepair.damaged(frame, queries.damage()))) == expected(damaged(rows))


def test_dropped_conversations_and_empty_tables(spark):
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    rows = spark.createDataFrame([(1, 1, "user", "a.", False), (1, 2, "user", "b.", False), (2, 1, "user", "a.", True)], TURNS)
    assert found(turnrepair.repaired(rows)) == [(1, 0, 0, 0, 0, 0, 0, "", empty), *expected({2: [(1, "user", "a.")]})]
    assert found(turnrepair.repaired(spark.createDataFrame([], TURNS))) == []


def test_sql_gives_the_same(spark):
    import duckdb
    from studbook.llm.conversation_sql import REPAIR
    connection = duckdb.connect()
    connection.sql(f"create view conversations as select * from '{SMALL}/conversations.parquet'")
    assert sorted(connection.sql(REPAIR).fetchall(), key=repr) == found(queries.op13_structure_repair(spark, SMALL))
