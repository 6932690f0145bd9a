"""Repeated byte strings against a table of all windows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from llm_small import SMALL, read
from studbook.llm import queries, suffix


def expected(docs, length):
    counts = Counter()
    for _, text in docs:
        raw = (text or "").encode()
        counts.update(raw[i:i + length] for i in range(len(raw) - length + 1))
    out = []
    for key, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((key, len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def found(own, kept, length):
    return sorted([tuple(r) for r in suffix.digest_columns(own, kept, length).collect()], key=repr)


@pytest.mark.parametrize("length,together", [(400, 2000), (40, 2000), (40, 2), (5, 7)])
def test_equal_to_all_windows(make_docs, monkeypatch, length, together):
    monkeypatch.setattr(suffix, "TOGETHER", together)
    rng = random.Random(length)
    def prose(n):
        return "".join(rng.choice("abcdefghijé ") for _ in range(n))
    passages = [prose(length + n) for n in (-1, 0, 1, 30, 200)]
    docs = [(i, prose(rng.choice([0, 10, length * 2])) + rng.choice(passages) + prose(rng.choice([0, 3, length])) + rng.choice(passages) + prose(20)) for i in range(40)]
    near = prose(length * 3)
    docs += [(50 + i, near[:at] + "#" + near[at:]) for i, at in enumerate(range(0, length * 3, max(1, length // 3)))]
    docs += [(100, None), (101, ""), (102, "ab" * length), (103, "x" * (length * 2)), (104, "short"), (105, "short"), (106, passages[3]), (106, passages[3]), (None, passages[4]), (None, None), (107, "日" * length)]
    assert found(*suffix.without_repeats(make_docs(docs), length), length) == expected(docs, length)


def test_query(spark):
    docs = read("documents", "doc_id", "text")
    assert sorted([tuple(r) for r in queries.op2_suffix_dedup(spark, SMALL).collect()], key=repr) == expected(docs, 400)


def test_empty_table(make_docs):
    assert found(*suffix.without_repeats(make_docs([]), 40), 40) == []


@pytest.mark.parametrize("shallow", [0, 1, 4])
def test_deep_shallow_order(shallow):
    rng = np.random.default_rng(shallow)
    rows = rng.integers(0, 3, (300, 50)).astype(np.uint8)
    rows[:100, :40] = 1
    rows[100:120] = rows[0]
    groups = rng.integers(0, 4, 300)
    order, common = suffix.deep_shallow(rows, groups, shallow)
    assert [(groups[i], rows[i].tobytes()) for i in order] == sorted((groups[i], rows[i].tobytes()) for i in range(300))
    for at in range(1, 300):
        a, b = order[at - 1], order[at]
        same = next((i for i in range(50) if rows[a][i] != rows[b][i]), 50)
        assert common[at] == -1 if groups[a] != groups[b] else min(common[at], 50) == same
