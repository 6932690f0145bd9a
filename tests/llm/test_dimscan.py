"""Nearest neighbours by tests on partial distances, against all inner products."""

import numpy as np
import pytest

from llm_small import SMALL, read
from studbook.llm import dimscan, queries

IS_QUERY = "vec_id % 20 = 0"


def usable(rows):
    width = max((len(v) for _, v in rows if v), default=0)
    out = []
    for key, v in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            out.append((key, np.array([*v, *[0.0] * (width - len(v))])))
    return out


def brute(rows, count=20):
    """query_id to its nearest lists of (vec_id, score); repeated ids give one list each."""
    kept, out = usable(rows), []
    for i, (q, a) in enumerate(kept):
        if q is None or q % 20:
            continue
        scored = sorted(((-(a * b).sum(), k is None, k or 0, j) for j, (k, b) in enumerate(kept) if j != i))
        out.append((q, [(None if null else k, -s) for s, null, k, _ in scored[:count]]))
    return out


def found(frame):
    return [tuple(r) for r in frame.select("query_id", "rank", "vec_id", "score").collect()]


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(k, v, 1, 2) for k, v in rows], f"vec_id long, embedding array<{kind}>, list int, row int").repartition(3)


def recall(got, expected):
    by_query = {}
    for q, _, v, _ in got:
        by_query.setdefault(q, set()).add(v)
    return np.mean([len(by_query[q] & {v for v, _ in near}) / len(near) for q, near in expected])


def test_query_has_recall_and_exact_scores(spark):
    rows = read("embeddings", "vec_id", "embedding")
    held, expected = dict(usable(rows)), brute(rows)
    got = found(queries.op11_adaptive_scan(spark, SMALL))
    assert len(got) == sum(len(near) for _, near in expected) and recall(got, expected) >= 0.95
    for query, rank, vec, score in got:
        assert query != vec and score == (held[query] * held[vec]).sum()
    for query in {g[0] for g in got}:
        own = sorted((g for g in got if g[0] == query), key=lambda g: g[1])
        assert [g[1] for g in own] == list(range(1, 21)) and own == sorted(own, key=lambda g: (-g[3], g[2]))


@pytest.mark.parametrize("shape", ["lengths", "outlier", "clusters", "copies"])
def test_recall_on_other_shapes(spark, shape):
    rng = np.random.default_rng(4)
    points = rng.standard_normal((1500, 40))
    if shape == "lengths":
        points *= rng.lognormal(0, 1, (1500, 1))
    elif shape == "outlier":
        points[7] *= 1e4
    elif shape == "clusters":
        points = points * 0.1 + rng.standard_normal((30, 40))[rng.integers(0, 30, 1500)]
    else:
        points[300:1100] = points[300]
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)]
    got, expected = found(dimscan.search(vectors(spark, rows, "double"), IS_QUERY)), brute(rows)
    if shape != "copies":
        assert recall(got, expected) >= 0.95
    else:
        # Ties go to the smaller id, so also among 800 equal vectors the rows are fixed.
        for query, near in expected:
            if 300 <= query < 1100:
                assert [g[2] for g in sorted(got) if g[0] == query] == [v for v, _ in near]


def test_small_blocks_and_few_columns_give_the_same(spark, monkeypatch):
    rows = read("embeddings", "vec_id", "embedding")
    monkeypatch.setattr(dimscan, "BLOCK", 40)
    assert recall(found(dimscan.search(vectors(spark, rows), IS_QUERY)), brute(rows)) >= 0.95


@pytest.mark.parametrize("rows", [
    [(0, None), (20, [0.0, 0.0]), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (100, []), (1, [1.0, 2.0]), (120, [1.0, 1.0]), (None, [3.0, 1.0])],
    [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.5, 1.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (None, [1.0, 0.0])],
    [(20, [1.0]), (1, [2.0, 5.0, 1.0]), (2, [-1.0])], [(20, [1.0, 1.0])], [(7, [1.0, 1.0])], [(i, [1.0, float(i % 3)]) for i in range(70)], [(i, [1.0, 1.0]) for i in range(41)]])
def test_every_candidate_of_small_tables(spark, rows):
    """Fewer candidates than asked for, ties, repeated rows, null ids, vectors that take no part and shorter ones."""
    got = sorted(found(dimscan.search(vectors(spark, rows), IS_QUERY)), key=repr)
    assert got == sorted(((q, k, v, s) for q, near in brute(rows) for k, (v, s) in enumerate(near, 1)), key=repr)


def test_empty_tables(spark):
    for rows in ([], [(0, None)], [(0, [0.0])]):
        assert found(dimscan.search(vectors(spark, rows), IS_QUERY)) == []


def test_share_of_a_distance_on_the_first_columns():
    """Of random vectors of length one at most LOSS exceed each bound, and bounds are not slack."""
    points = np.random.default_rng(2).standard_normal((200_000, 65))
    shares = np.cumsum(points**2, axis=1) / (points**2).sum(axis=1, keepdims=True)
    bounds = dimscan.beta_bounds(65, dimscan.LOSS)
    assert [b[:2] for b in bounds] == [(0, 16), (16, 32), (32, 48), (48, 65)] and bounds[-1][2] == 1
    assert [b[:2] for b in dimscan.beta_bounds(7, 0.1)] == [(0, 7)] and [b[:2] for b in dimscan.beta_bounds(32, 0.1)] == [(0, 16), (16, 32)]
    for _, end, bound in bounds[:-1]:
        assert 0.3 * dimscan.LOSS < (shares[:, end - 1] > bound).mean() < 1.5 * dimscan.LOSS
