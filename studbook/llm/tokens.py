"""Byte-level BPE ids of whole text columns.

A text is cut into pre-tokens by the vocabulary's published pattern, here with array operations over code points;
each distinct pre-token is then encoded once per worker and its ids are gathered for all its places. The ids equal
those of encoding each text on its own, since merges never cross pre-tokens.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from .columns import constants, plain, ragged, span_hashes

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
_CACHED_WORDS = 200_000
# The short endings that the pattern splits off after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            kinds[code] = LETTER if kind == "L" else NUMBER
    # The code points with the White_Space property.
    kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = SPACE
    return kinds


def pretoken_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where a pre-token begins: `points` are code points of several texts, `bounds` the beginning of each text and the end."""
    total = len(points)
    if not total:
        return np.zeros(0, np.int64)
    kinds = _classes()[points]
    edge = np.zeros(total + 1, bool)
    edge[bounds] = True
    starts = np.ones(total, bool)
    starts[1:] = (kinds[1:] != kinds[:-1]) | edge[1:-1]
    # The last blank before other characters stands apart from the blanks before it, and a plain one joins what follows.
    last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~edge[1:-1])
    starts[last] = True
    starts[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero((points[:-1] == 39) & starts[:-1] & (kinds[1:] == LETTER) & ~edge[1:-1])
    second = np.where(quote + 2 < total, points[np.minimum(quote + 2, total - 1)], 0)
    second[edge[np.minimum(quote + 2, total)]] = 0
    first = points[quote + 1]
    taken = np.zeros(len(quote), np.int64)
    for ending in ENDINGS:
        hit = first == ord(ending[0])
        if len(ending) == 2:
            hit &= second == ord(ending[1])
        taken[hit & (taken == 0)] = len(ending)
    quote, taken = quote[taken > 0], taken[taken > 0]
    starts[quote + 1] = False
    after = quote + 1 + taken
    after = after[after < total]
    starts[after] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of text columns under the ranks file at `path`, with the pre-token cache of one worker."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begins, self.counts, self.filled = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _add(self, key: int, text: str) -> int:
        found = self.encoding.encode_ordinary(text)
        place = len(self.known)
        if place == len(self.begins):
            self.begins, self.counts = np.resize(self.begins, 2 * place), np.resize(self.counts, 2 * place)
        while self.filled + len(found) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.filled: self.filled + len(found)] = found
        self.begins[place], self.counts[place] = self.filled, len(found)
        self.filled += len(found)
        self.known[key] = place
        return place

    def _places(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The cache place of each pre-token, and the first pre-token of each text."""
        if len(self.known) > _CACHED_WORDS:
            self.clear()
        texts = plain(column).to_pylist()
        joined = "".join(texts)
        bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = pretoken_starts(points, bounds)
        ends = np.append(starts[1:], len(points))
        hashes = span_hashes(points.astype(np.uint64) * constants(1, 5)[0] + constants(1, 6)[0], starts, ends)
        codes, distinct = pd.factorize(hashes)
        where = np.zeros(len(distinct), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        known = self.known
        places = np.empty(len(distinct), np.int64)
        for i, (key, at) in enumerate(zip(distinct.tolist(), where.tolist())):
            place = known.get(key)
            places[i] = self._add(key, joined[starts[at]: ends[at]]) if place is None else place
        return places[codes] if len(codes) else np.zeros(0, np.int64), np.searchsorted(starts, bounds)

    def lengths(self, column: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        places, first = self._places(column)
        sums = np.concatenate(([0], np.cumsum(self.counts[places])))
        return sums[first[1:]] - sums[first[:-1]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one text after the other, and the offset where each text begins (one more for the end)."""
        places, first = self._places(column)
        counts = self.counts[places]
        sums = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[ragged(self.begins[places], counts)], sums[first]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(path, pattern)
