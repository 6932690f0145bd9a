"""The stages of the corpus pipeline on small tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from llm_small import SMALL, read
from studbook.llm import queries
from studbook.session import settle

STAGES = dict(pipe.STAGES)
WORDS = [f"{a}{b}" for a in ("bel", "tor", "min", "sal", "quin", "ver") for b in ("o", "ant", "ium", "eth", "aris", "ul", "ene")]
KEY = "AKIA" + "Q7" * 8


def prose(seed, count=120):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(count))


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty and repeated texts, near copies, a benchmark item, a secret, a text of a megabyte; columns beyond those of documents."""
    item = next(text for _, text in read("benchmark", "item_id", "text") if text and len(text.split()) >= 12)
    base = prose(1)
    rows = [(1, None), (2, ""), (3, base), (4, base), (5, base + " more"), (6, prose(2)), (7, f"{prose(3)} {item} {prose(4)}"), (8, f"{prose(5)} {KEY} end"), (9, " ".join(prose(6, 150_000).split())), (10, prose(7, 3))]
    frame = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return settle(frame.withColumns({"score": F.lit(1), "class_id": F.lit(2), "item": F.lit("x"), "piece": F.lit(0)}))


def run(spark, docs, name):
    return {r.doc_id: r.text for r in STAGES[name](spark, docs, SMALL).collect()}


def test_stage_names_and_columns(spark, docs):
    assert [name for name, _ in pipe.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    for name, stage in pipe.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == pipe.COLUMNS


def test_clean_documents_pass_the_first_stage(spark, docs):
    kept = run(spark, docs, "toxicity")
    assert set(kept) >= {1, 2, 3, 4, 6, 9, 10}


def test_one_document_of_each_group_stays(spark, docs):
    kept = run(spark, docs, "near_duplicates")
    # A null text is an empty one, so 1 and 2 are copies too.
    assert set(kept) == {1, 3, 6, 7, 8, 9, 10}


def test_documents_with_benchmark_items_go(spark, docs):
    assert set(run(spark, docs, "decontamination")) == set(range(1, 11)) - {7}


def test_secrets_are_replaced_and_documents_stay(spark, docs):
    kept = STAGES["secrets"](spark, docs, SMALL).collect()
    texts = {r.doc_id: r.text for r in kept}
    assert set(texts) == set(range(1, 11)) and KEY not in texts[8] and texts[8].startswith(prose(5)[:50]) and texts[6] == prose(2)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)


def test_pieces_fill_sequences_without_gaps(spark, docs):
    rows = STAGES["packing"](spark, docs, SMALL).collect()
    assert {r.doc_id for r in rows} == set(range(1, 11))
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:])) and sum(n for _, n in held) <= queries.CAPACITY


@pytest.mark.parametrize("name", list(STAGES))
def test_empty_tables(spark, docs, name):
    assert STAGES[name](spark, docs.limit(0), SMALL).count() == 0


def test_whole_pipeline_is_its_stages(spark):
    """run() gives what its stages give one after the other, written in between."""
    kept = spark.read.parquet(f"{SMALL}/documents.parquet")
    counts = [kept.count()]
    for _, stage in pipe.STAGES:
        kept = settle(stage(spark, kept, SMALL))
        counts.append(kept.select("doc_id").distinct().count())
    assert counts[:-1] == sorted(counts[:-1], reverse=True) and counts[-1] == counts[-2] > 0
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(tuple(r) for r in pipe.run(spark, SMALL).select(columns).collect()) == sorted(tuple(r) for r in kept.select(columns).collect())
