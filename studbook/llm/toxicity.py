"""Toxicity by a counterfactually regularised linear classifier.

Features are the words of a text and their beginnings, so inflected forms share weight. In each labelled sentence that
names a group, the name is swapped for other names of its kind; the squared change of the score over all such swaps is part
of the loss, so the model can't use a mention of a group as evidence by itself.

Fitted on at most SAMPLE labelled rows (those with the least hash of the id), so what reaches the driver is bounded: one
list of feature numbers for each sampled document. Scoring is one pass over all texts. Null and empty texts get the score
of a text without features. Rows without a label are not used; of repeated labels for one id the largest counts. Without
labels of both classes every score is the share of label 1 (0 without any).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .columns import slices

SAMPLE = 20_000
CANDIDATES = 20_000
VOCABULARY = 4_096
LEAST_DOCUMENTS = 5
BEGINNINGS = (4, 5, 6, 7, 8)
PENALTY = 4.0
RIDGE = 1e-5
STEPS = 1_000
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")

# Names of groups by kind; the names of one kind take each other's place.
GROUPS = {
    "faith": ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "protestant", "musulman", "chrétien", "juif", "musulmán", "cristiano", "judío", "muslimisch",
              "christlich", "jüdisch"],
    "faiths": ["muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos", "muslime", "christen", "juden"],
    "gender": ["woman", "man", "femme", "homme", "mujer", "hombre", "frau", "mann"],
    "genders": ["women", "men", "femmes", "hommes", "mujeres", "hombres", "frauen", "männer"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "transgender", "homosexuel", "homosexual", "schwul", "lesbisch"],
    "origin": ["black", "white", "asian", "african", "european", "american", "arab", "latino", "mexican", "chinese", "indian", "noir", "blanc", "asiatique", "negro", "blanco", "asiático",
               "schwarz", "weiß", "asiatisch"],
    "standing": ["immigrant", "immigrants", "refugee", "refugees", "migrant", "réfugié", "refugiado", "inmigrante", "flüchtling", "einwanderer"],
    "ability": ["disabled", "deaf", "blind", "elderly", "handicapé", "sourd", "discapacitado", "sordo", "behindert", "gehörlos"],
}
KIND_OF = {name: kind for kind, names in GROUPS.items() for name in names}


def word_features(word: str) -> list[str]:
    return [word] + [f"{word[:size]}*" for size in BEGINNINGS if len(word) > size]


def text_features(words: set[str]) -> set[str]:
    return {feature for word in words for feature in word_features(word)}


def found_words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def swaps(text: str) -> list[tuple[set[str], set[str]]]:
    """For each sentence that names a group: its features, and those with the name swapped, for every other name of the kind."""
    pairs = []
    for sentence in SENTENCE.split(text):
        words = found_words(sentence)
        for name in sorted(set(words) & KIND_OF.keys()):
            for other in GROUPS[KIND_OF[name]]:
                if other != name:
                    pairs.append((text_features(set(words)), text_features({other if word == name else word for word in words})))
    return pairs


@dataclass
class Model:
    """Weights by feature and the score of a text without any."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self):
        self.of_word: dict[str, tuple[str, ...]] = {}

    def score(self, text: str) -> float:
        features: set[str] = set()
        known = self.of_word
        if len(known) > 500_000:
            known.clear()
        for word in set(found_words(text)):
            some = known.get(word)
            if some is None:
                some = known[word] = tuple(f for f in word_features(word) if f in self.weights)
            if some:
                features.update(some)
        total = self.bias + sum(self.weights[f] for f in sorted(features))
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))


class _Rows:
    """Sparse 0/1 rows as flat lists."""

    def __init__(self, rows: list[np.ndarray]):
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        self.row = np.repeat(np.arange(len(rows)), sizes)
        self.column = np.concatenate([np.asarray(r, np.int64) for r in rows]) if len(rows) else np.zeros(0, np.int64)
        self.count = len(rows)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.column], self.count)

    def back(self, values: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.column, values[self.row], size)


def fit_weights(rows: list[list[int]], labels: np.ndarray, pairs: list[tuple[list[int], list[int]]], size: int, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Logistic loss (classes weighted alike), ridge, and the mean squared score change of the pairs, by Adam."""
    data, left, right = _Rows(rows), _Rows([a for a, _ in pairs]), _Rows([b for _, b in pairs])
    balance = np.where(labels == 1, 0.5 / max(1, labels.sum()), 0.5 / max(1, (1 - labels).sum()))
    weights, bias = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        wrong = balance * (1 / (1 + np.exp(-np.clip(data.times(weights) + bias, -40, 40))) - labels)
        slope = data.back(wrong, size) + RIDGE * weights
        if pairs:
            change = (left.times(weights) - right.times(weights)) * 2 * penalty / len(pairs)
            slope += left.back(change, size) - right.back(change, size)
        slope = np.append(slope, wrong.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, bias


def _candidates(sample: DataFrame) -> list[str]:
    """Features of at least LEAST_DOCUMENTS toxic sample texts, the most frequent CANDIDATES of them, counted on the executors."""
    def count(batches):
        seen: dict[str, int] = {}
        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                for feature in text_features(set(found_words(text))):
                    seen[feature] = seen.get(feature, 0) + 1
                if len(seen) > 200_000:
                    yield pa.record_batch({"feature": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
                    seen = {}
        yield pa.record_batch({"feature": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
    counts = sample.where("toxic = 1").select("text").mapInArrow(count, "feature string, n bigint").groupBy("feature").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= LEAST_DOCUMENTS).orderBy(F.desc("n"), "feature").limit(CANDIDATES).collect()
    return [row["feature"] for row in top]


def fit(docs: DataFrame, labels: DataFrame, use: Column | None = None, key: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, penalty: float = PENALTY) -> Model:
    """A model from labelled rows; `use` is a condition on `doc_id` that a row must meet to be learnt from."""
    named = labels.select(F.col(key).cast("bigint").alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    named = (named if use is None else named.where(use)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` short rows, so they are sent to every executor.
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    groups = sorted({feature for name in KIND_OF for feature in word_features(name)})
    candidates = sorted(set(_candidates(rows)) | set(groups))
    place = {feature: i for i, feature in enumerate(candidates)}
    known = docs.sparkSession.sparkContext.broadcast(place)

    def number(batches):
        place = known.value
        def numbers(features):
            return sorted(place[f] for f in features if f in place)
        for batch in slices(batches, "text"):
            out = {"toxic": [], "features": [], "others": []}
            for value, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out["toxic"].append(label)
                out["features"].append(numbers(text_features(set(found_words(value)))))
                out["others"].append(None)
                for before, after in swaps(value):
                    out["toxic"].append(None)
                    out["features"].append(numbers(before - after))
                    out["others"].append(numbers(after - before))
            yield pa.record_batch({"toxic": pa.array(out["toxic"], pa.int32()), "features": pa.array(out["features"], pa.list_(pa.int32())), "others": pa.array(out["others"], pa.list_(pa.int32()))})
    found = rows.select("text", "toxic").mapInArrow(number, "toxic int, features array<int>, others array<int>").toArrow()
    marks = found.column("toxic").to_pylist()
    lists, others = _arrays(found.column("features")), _arrays(found.column("others"))
    texts = [i for i, mark in enumerate(marks) if mark is not None]
    pairs = [(lists[i], others[i]) for i, mark in enumerate(marks) if mark is None]
    y = np.array([marks[i] for i in texts], float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model({}, 40.0 if share == 1 else -40.0)
    keep = _vocabulary([lists[i] for i in texts], y, len(candidates), [place[f] for f in groups])
    where = np.full(len(candidates), -1)
    where[keep] = np.arange(len(keep))
    def narrow(numbers):
        return where[numbers][where[numbers] >= 0]
    weights, bias = fit_weights([narrow(lists[i]) for i in texts], y, [(narrow(a), narrow(b)) for a, b in pairs], len(keep), penalty)
    return Model({candidates[old]: float(weights[new]) for new, old in enumerate(keep) if abs(weights[new]) > 1e-6}, float(bias))


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as slices of one array."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    values, bounds = whole.values.to_numpy(), whole.offsets.to_numpy()
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def _vocabulary(rows: list[np.ndarray], labels: np.ndarray, size: int, always: list[int]) -> list[int]:
    """The features whose share among toxic texts is furthest above that among others, by a two-sample score over 3."""
    data = _Rows(rows)
    n1, n0 = labels.sum(), (1 - labels).sum()
    p1, p0 = data.back(labels, size) / n1, data.back(1 - labels, size) / n0
    score = (p1 - p0) / np.sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0 + 0.25 / (n1 + n0) ** 2 + 1e-9)
    best = [int(i) for i in np.argsort(-score, kind="stable")[:VOCABULARY] if score[i] > 3]
    return sorted(set(best) | set(always))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score, 0 to 1, of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def rate(batches):
        model = Model(*shared.value)
        for batch in slices(batches, "text"):
            yield pa.record_batch({"doc_id": batch.column(0), "score": pa.array([model.score(x) for x in batch.column(1).to_pylist()], pa.float64())})
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(rate, "doc_id bigint, score double")


def with_score(docs: DataFrame, model: Model, column: str, text: str = "text") -> DataFrame:
    """The same rows and columns with the score added under `column`."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    place = docs.columns.index(text)

    def rate(batches):
        model = Model(*shared.value)
        for batch in batches:
            scores = [model.score(x or "") for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, column])
    from pyspark.sql.types import DoubleType, StructField, StructType
    return docs.mapInArrow(rate, StructType([*docs.schema.fields, StructField(column, DoubleType())]))
