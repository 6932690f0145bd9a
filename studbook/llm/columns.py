"""Reading text columns in bounded slices, and the words of a slice as arrays.

A word is a maximal run of ASCII letters or digits and of any characters beyond ASCII; A-Z count as a-z.
Everything works on the UTF-8 bytes of an Arrow column, so there is no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(count: int, seed: int) -> np.ndarray:
    """`count` fixed odd 64-bit numbers for a seed."""
    start = np.uint64(seed * 0x632BE59BD9B4E019 & _MASK)
    return mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_BASE) + start) | np.uint64(1)


class Powers:
    """Powers of an odd base modulo 2^64, and of its inverse, grown as far as they are asked for."""

    def __init__(self, base: int = _BASE | 1):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, count: int) -> None:
        if len(self.up) < count:
            size = max(count, 2 * len(self.up))
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, np.uint64(factor))
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


POWERS = Powers()
_CODES = np.arange(256)
WORD_BYTE = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
LOWER_BYTE = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)
BYTE_VALUE = constants(256, 1)
_WORD_VALUE = BYTE_VALUE[LOWER_BYTE]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, pairs in ascending order and disjoint."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + _BLOCK)))
        low, high = int(starts[at]), int(ends[to - 1])
        POWERS.reach(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[low:high] * POWERS.up[: high - low], out=sums[1:])
        out[at:to] = (sums[ends[at:to] - low] - sums[starts[at:to] - low]) * POWERS.down[starts[at:to] - low]
        at = to
    return mix(out)


def plain(column: pa.Array) -> pa.Array:
    """Text with nulls as empty strings, as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and the offset where each text begins (one more for the end)."""
    column = plain(column)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[bounds[0]: bounds[-1]], bounds - bounds[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about `limit` bytes; one longer text is a batch of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        place = batch.schema.get_field_index(text)
        batch = batch.set_column(place, pa.field(text, pa.large_string()), plain(batch.column(place)))
        _, bounds = text_bytes(batch.column(place))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of several texts: where each begins and ends in the bytes, its hash, and the first word of each text."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(column: pa.Array) -> Words:
    data, bounds = text_bytes(column)
    inside = WORD_BYTE[data]
    before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    cuts = bounds[1:-1]
    before[cuts[cuts < len(data)]] = False
    after[cuts[cuts > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(starts, ends, span_hashes(_WORD_VALUE[data], starts, ends), np.searchsorted(starts, bounds))


def grams(found: Words, size: int, seed: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of `size` consecutive words at every word, and whether the run stays inside its text."""
    total = len(found.hashes)
    out = np.zeros(total, np.uint64)
    for step, factor in enumerate(constants(size, seed)):
        out[: max(0, total - step)] += found.hashes[step:] * factor
    last = np.repeat(found.first[1:], np.diff(found.first))
    return mix(out), np.arange(total) + size <= last


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    total = int(counts.sum())
    jumps = np.repeat(starts - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) if total else np.zeros(0, np.int64)
    return jumps + np.arange(total)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of `size` words; a shorter text that has words is one shingle of all its words."""
    hashes, inside = grams(found, size)
    counts = np.diff(found.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    factors = constants(size, 2)
    for text in short:
        at = found.first[text]
        own = found.hashes[at: at + counts[text]]
        hashes[at] = mix((own * factors[: len(own)]).sum(keepdims=True))[0]
        inside[at] = True
    return hashes[inside], found.text_of()[inside]


def counted(hashes: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in order within each text, their texts, which are the first of their value, and the place among equal ones."""
    order = np.lexsort((hashes, texts))
    hashes, texts = hashes[order], texts[order]
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (texts[1:] != texts[:-1])
    heads = np.flatnonzero(fresh)
    place = np.arange(len(hashes)) - np.repeat(heads, np.diff(np.append(heads, len(hashes))))
    return hashes, texts, fresh, place
