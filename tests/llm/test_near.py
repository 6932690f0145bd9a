"""Near copies against brute force on whole multisets."""

import random
from collections import Counter

import numpy as np

from llm_small import SMALL, read
from studbook.llm import bagminhash, queries
from test_scans import WORDS, ascii_lower


def shingle_counts(text):
    words = WORDS.findall(ascii_lower(text))
    size = min(5, len(words))
    return Counter(tuple(words[i:i + size]) for i in range(len(words) - size + 1)) if size else Counter()


def overlap(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def classes_by_hand(docs, similarity=0.8):
    texts = sorted({t or "" for _, t in docs})
    bags = [shingle_counts(t) for t in texts]
    root = list(range(len(texts)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and overlap(bags[i], bags[j]) >= similarity:
                root[find(i)] = find(j)
    where = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for key, text in docs:
        if key is not None:
            least[where[text or ""]] = min(key, least.get(where[text or ""], key))
    return sorted(((key, least.get(where[text or ""])) for key, text in docs), key=repr)


def classes_found(frame):
    return sorted([(r.doc_id, r.class_id) for r in bagminhash.near_duplicates(frame).collect()], key=repr)


def varied(rng, words, changes):
    words = words[:]
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
    return " ".join(words)


def test_classes_equal_brute_force(make_docs):
    rng = random.Random(8)
    docs, key = [], 1000
    for _ in range(6):
        base = [f"w{rng.randrange(10**5)}" for _ in range(200)]
        for changes in [0, 0, 1, 2, 3, 6, 12, 30]:
            docs.append((key := key - 1, varied(rng, base, changes)))
    shared = [f"s{i}" for i in range(60)]
    docs += [(key := key - 1, " ".join(shared) + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))) for _ in range(40)]
    docs += [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "one two three"), (None, "one two"), (None, "nobody else has this text here"), (7, "a b c d e " * 50), (8, "a b c d e " * 48), (9, "a b c d e " * 20), (5, "One, two!")]
    assert classes_found(make_docs(docs)) == classes_by_hand(docs)


def test_query_on_the_small_table(spark):
    docs = read("documents", "doc_id", "text")
    assert sorted([tuple(r) for r in queries.op10_near_duplicates(spark, SMALL).collect()], key=repr) == classes_by_hand(docs)


def test_empty_table(make_docs):
    assert classes_found(make_docs([])) == []


def test_signatures_estimate_weighted_overlap():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 6, 400), rng.integers(0, 6, 400)
    b[:300] = a[:300]
    a[0], b[0] = 37, 21
    keys = rng.integers(1, 2**63, 400).astype(np.uint64)
    size = 4000
    rows = [bagminhash.signatures(keys[w > 0], np.zeros((w > 0).sum(), np.int64), w[w > 0], 1, size)[0] for w in (a, b)]
    assert abs((rows[0] == rows[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.025
