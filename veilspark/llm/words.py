"""Words and word shingles of whole texts as 64-bit hashes, a batch of texts at a time.

Runs inside tasks. A batch is one byte array; word limits, hashes and shingles come from
array operations over it, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 256 << 10
"""Texts are handled in slices of about this many bytes; a longer text is a slice of its own.

Small ones, as workers share an executor's memory with its heap and keep what they once took.
"""

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_PLACE = _RNG.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have


@dataclass
class Words:
    """Words of consecutive texts: byte limits, hashes, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one longer than the texts
    total: np.ndarray  # running sums behind the hashes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def beginnings(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words longer than ``size`` bytes, and hashes of their first ``size`` bytes."""
        long = np.flatnonzero(self.end - self.start > size)
        at = self.start[long]
        h = (self.total[at + size] - self.total[at]) * _power(_INVERSE, len(self.data) + 1)[at]
        return long, mix(h ^ _PLACE[size])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first text, text after the last, bytes, offsets)`` of bounded runs of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    data, offsets = _bytes(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of a slice: runs of anything but blank, tab, line feed, and the like (0x09-0x0D)."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, none.astype(np.uint64), np.zeros(len(offsets), dtype=np.int64), none.astype(np.uint64))
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[data] * _power(_BASE, n)[:n], dtype=np.uint64, out=total[1:])
    hashes = mix((total[end] - total[start]) * _power(_INVERSE, n + 1)[start] + (end - start).astype(np.uint64))
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, hashes, first, total)


def shingles_of(w: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text, with repeats, and where each text begins.

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    counts = w.counts
    out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(out)])
    text = np.repeat(np.arange(len(counts)), out)
    at = w.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    length = np.minimum(counts, size)[text]
    h = length.astype(np.uint64)
    short = bool((counts < size).any())
    for k in range(size):
        if short:
            use = k < length
            h = h + np.where(use, w.hash[np.where(use, at + k, 0)] * _PLACE[k], np.uint64(0)) if len(w.hash) else h
        else:
            h = h + w.hash[at + k] * _PLACE[k]
    return mix(h), first


def distinct_within(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text begins among them."""
    parts = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:])]
    counts = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    return (np.concatenate(parts) if parts else h[:0]), np.concatenate([[0], np.cumsum(counts)])


def segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of each text's values; 0 where it has none."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def set_keys(distinct: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each text's set of hashes; sums, so the order does not matter."""
    return segment_sum(mix(distinct), first), segment_sum(mix(distinct ^ np.uint64(0xD6E8FEB86659FD93)), first)


def as_long(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's bigint."""
    return h.view(np.int64)
