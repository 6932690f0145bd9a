"""Operators on whole tables: archives, token counts, packing."""

import base64
import hashlib
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers
from llm_small import SMALL, read
from studbook.llm import lengths, packing, queries, warc
from studbook.session import new_folder, settle


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected_archive(pages, least=0):
    groups = defaultdict(list)
    for key, _, html in pages:
        groups[html or ""].append(key)
    out = []
    for key, _, html in pages:
        keys = [k for k in groups[html or ""] if k is not None]
        size = len((html or "").encode())
        revisit = size >= least and bool(keys) and key != min(keys)
        out.append((key, size, digest(html), "revisit" if revisit else "response", min(keys) if revisit else None))
    return sorted(out, key=repr)


PAGES = [(1, "http://a/\r\nX: y", "<p>WARC/1.1\r\n\r\nWARC-Type: response\r\n\r\n</p>"), (2, "http://b/é", "same"), (3, None, "same"), (4, "http://c", None), (5, "http://d", ""), (6, "u", "日本\r\n\r\n\r\n"),
         (9, "u", "same"), (9, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (7, "u", "x" * 100000), (8, "u", "x" * 100000), (2, "http://b/é", "same")]


@pytest.mark.parametrize("least", [0, 5])
def test_archives_come_back(spark, least):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, payload_bytes int")
    found = warc.archive_round(pages, least)
    got = sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()], key=repr)
    assert got == expected_archive(PAGES, least)


def test_archive_stores_each_payload_once(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "y" * 5000) for i in range(50)], "page_id long, url string, html string")
    folder = new_folder(spark, "warc")
    warc.write_archives(pages, folder)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(folder).collect()]
    records = [r for f in files for r in warc.parse_records(f)]
    assert Counter(f["WARC-Type"] for f, _ in records) == {"response": 1, "revisit": 49} and sum(len(p) for _, p in records) == 5000
    assert {f["WARC-Refers-To"] for f, _ in records if f["WARC-Type"] == "revisit"} == {f["WARC-Record-ID"] for f, _ in records if f["WARC-Type"] == "response"}


def test_payloads_move_once_and_never_by_digest(spark):
    """Also where no table is small enough to be sent whole."""
    pages = spark.createDataFrame([(i, f"u{i}", "page not found" if i % 3 else f"page {i}") for i in range(60)], "page_id long, url string, html string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        typed = warc.typed_records(pages, archive_bytes=100)
        plan = typed._jdf.queryExecution().executedPlan().toString()
        assert typed.groupBy("record_type").count().collect() and typed.where("record_type = 'revisit'").count() == 39
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    moves = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moves) == 2 and all("hashpartitioning(record_id" in line for line in moves)


def test_archive_query(spark):
    pages = read("pages", "page_id", "url", "html")
    got = sorted([tuple(r) for r in queries.op3_warc_revisits(spark, SMALL).collect()], key=repr)
    assert got == expected_archive(pages)
    assert warc.archive_round(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_tokenizer():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found.encode_special_tokens = True
    return found


def expected_limits(sizes):
    out = []
    for limit in sorted(set(sizes)):
        kept = sum(min(s, limit) for s in sizes)
        out.append((limit, sizes.count(limit), sum(s > limit for s in sizes), sum(sizes), kept, sum(sizes) - kept, sum(s <= limit for s in sizes) / len(sizes)))
    return out


def test_every_context_limit(spark):
    sizes = [len(e.ids) for e in plain_tokenizer().encode_batch([t or "" for _, t in read("documents", "doc_id", "text")], add_special_tokens=False)]
    found = settle(queries.op4_token_counts(spark, SMALL))
    assert sorted(tuple(r) for r in found.collect()) == expected_limits(sizes)
    for limit in (0, 1, 77, 500, 10**7):
        assert lengths.kept_at(found, limit).first()[0] == sum(min(s, limit) for s in sizes)
    for share in (0.1, 0.5, 0.99, 1.0):
        assert lengths.quantile(found, share).first()[0] == sorted(sizes)[max(0, -(-int(share * 1000) * len(sizes) // 1000) - 1)]


def test_limits_of_odd_tables(spark, make_docs):
    def limits(rows):
        return sorted(tuple(r) for r in lengths.limits(lengths.histogram(lengths.encoded_lengths(make_docs(rows), queries.RANKS, queries.PATTERN))).collect())
    assert limits([]) == []
    assert [r[:2] for r in limits([(1, None), (1, ""), (None, "a"), (None, "a")])] == [(0, 2), (1, 2)]


def check_packing(rows, sizes, capacity):
    """Every piece placed, no overlap, no gap, documents cut as told; the number of sequences."""
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
    for key, size in sizes.items():
        own = sorted(pieces[key])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == size
        assert all(s == sum(n for _, _, n in own[:i]) for i, (_, s, _) in enumerate(own)) and all(n == capacity for _, _, n in own[1:]) and len(own) == -(-size // capacity)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing_query(spark):
    docs = read("documents", "doc_id", "text")
    ids = {k: [*e.ids, 2] for (k, _), e in zip(docs, plain_tokenizer().encode_batch([t or "" for _, t in docs], add_special_tokens=False))}
    rows = queries.op7_packing(spark, SMALL).collect()
    used = check_packing(rows, {k: len(v) for k, v in ids.items()}, 1024)
    for r in rows:
        assert r.ids_crc32 == crc32(np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes())
    assert used <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1


@pytest.mark.parametrize("seed", range(6))
def test_plan_on_random_histograms(seed):
    rng = random.Random(seed)
    capacity = 96
    top = [96, 40, 12, 33, 60, 96][seed]
    counts = Counter(rng.randint(1, top) for _ in range(500))
    runs = packing.plan_runs(counts, capacity)
    placed, filled = Counter(), defaultdict(list)
    for length, rank, pieces, first, each, offset in runs:
        assert placed[length] == rank
        placed[length] += pieces
        for i in range(pieces):
            filled[first + i // each].append((offset + i % each * length, length))
    assert placed == counts
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    # At most what first fit on sorted lengths needs.
    bins = []
    for length in sorted(counts.elements(), reverse=True):
        for i, free in enumerate(bins):
            if free >= length:
                bins[i] -= length
                break
        else:
            bins.append(capacity - length)
    assert len(filled) <= len(bins) + 1


def test_packing_odd_tables(spark, make_docs):
    docs = [(1, None), (2, ""), (3, "a " * 3000), (4, "b"), (4, "b"), (None, "c c c"), (None, None)]
    rows = packing.pack(make_docs(docs), queries.RANKS, queries.PATTERN, 1024, 2).collect()
    assert sum(r.length for r in rows) == 1 + 1 + 3002 + 2 + 2 + 4 + 1
    assert all(len(r.ids) == 4 * r.length for r in rows)
    seen = defaultdict(set)
    for r in rows:
        for at in range(r.offset, r.offset + r.length):
            assert at not in seen[r.sequence_id] and at < 1024
            seen[r.sequence_id].add(at)
    assert packing.pack(make_docs([]), queries.RANKS, queries.PATTERN, 1024, 2).count() == 0
