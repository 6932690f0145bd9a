"""Secrets in whole texts: known shapes, and random strings found by their token efficiency.

Three shapes are matched by pattern. Beyond them, a run of key characters with a letter is taken for a random string when
the vocabulary needs a token for every MAX_RATIO characters or fewer: words and names compress well, random strings don't.
Known digests (hexadecimal or base-32 of a usual length), UUIDs and identifiers are left out; an identifier, cut at its
separators and changes of case, gives words of PART_TOKENS tokens or fewer that hold PART_RATIO letters a token in all.
Null text counts as empty; spans are in code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .columns import slices
from .tokens import encoder

# The shapes and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

KINDS = ["assign", "access", "hex", "random"]
MAX_RATIO = 2.2
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGEST = re.compile(r"[0-9A-Fa-f]+|[A-Z2-7]{32}")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
CLOSING = re.compile(r"v?[0-9]{1,4}[/_-]*$")
PART_TOKENS, PART_RATIO = 2, 1.7
SPANS = "array<struct<kind:int,start:int,end:int>>"


def shaped(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the three shapes, leftmost and not overlapping within a kind."""
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        for match in ASSIGN.finditer(text):
            if len(match[2]) >= LEAST_ASSIGNED:
                yield match.start(), 0, match.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for match in pattern.finditer(text):
            yield match.start(), kind, match.end()


def is_known(run: str) -> bool:
    """Digests and UUIDs."""
    return bool(DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run))


def is_identifier(run: str, encode) -> bool:
    """Words of few tokens each, with no digits but a short number at the end."""
    run = CLOSING.sub("", run)
    if any(c.isdigit() for c in run):
        return False
    parts = PART.findall(run)
    tokens = [len(encode(part)) for part in parts]
    return max(tokens, default=0) <= PART_TOKENS and sum(map(len, parts)) >= PART_RATIO * sum(tokens)


def is_random(run: str, encode, max_ratio: float = MAX_RATIO) -> bool:
    return any(c.isalpha() for c in run) and len(run) <= max_ratio * len(encode(run)) and not is_known(run) and not is_identifier(run, encode)


def secret_spans(text: str, encode, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) sorted; random strings are added only where no shape was found."""
    found = sorted(shaped(text))
    base = found[:]
    for match in RUN.finditer(text):
        start, end = match.span()
        if not any(a < end and start < b for a, _, b in base) and is_random(match[0], encode, max_ratio):
            found.append((start, 3, end))
    return sorted(found)


def _redact(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join(parts) + text[at:]


def scan(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per document: doc_id and the spans found, by start and then kind."""
    def find(batches):
        encode = encoder(path, pattern).encoding.encode_ordinary
        for batch in slices(batches, "text"):
            spans = [[{"kind": k, "start": a, "end": b} for a, k, b in secret_spans(x, encode, max_ratio)] for x in batch.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch({"doc_id": batch.column(0), "spans": pa.array(spans, kind)})
    return docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(find, f"doc_id bigint, spans {SPANS}")


def redacted(docs: DataFrame, path: str, pattern: str, text: str = "text", mark: str = "[SECRET]", max_ratio: float = MAX_RATIO) -> DataFrame:
    """The same rows and columns with every secret replaced by `mark`; null texts stay null."""
    place = docs.columns.index(text)

    def clean(batches):
        encode = encoder(path, pattern).encoding.encode_ordinary
        for batch in batches:
            new = []
            for value in batch.column(place).to_pylist():
                spans = secret_spans(value, encode, max_ratio) if value else []
                new.append(_redact(value, spans, mark) if spans else value)
            yield batch.set_column(place, batch.schema.field(place), pa.array(new, batch.schema.field(place).type))
    return docs.mapInArrow(clean, docs.schema)


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(name) for name in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def digest_columns(found: DataFrame) -> DataFrame:
    """Counts by shape, the digest of the shaped spans, and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
