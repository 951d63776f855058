"""Word shingles of whole texts as 64-bit hashes, for a slice of an Arrow batch at a time.

All words of a slice are hashed together: a polynomial over their bytes, read off prefix sums, then mixed. Two
different shingles share a hash with probability 2**-64; sets of hashes stand for sets of shingles throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """base ** i mod 2**64 for i < n or more."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        have = _powers[base] = np.multiply.accumulate(out)
    return have


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(at: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most `limit` bytes together (or one row that has more)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some rows, in order, and for each row the place of its first word (one more than rows)."""
    low = int(at[0])
    at, data = at - low, data[low : int(at[-1])]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    before = np.concatenate(([False], inside[:-1]))
    first = at[:-1][at[:-1] < at[1:]]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False]))
    after[at[1:][at[1:] > at[:-1]] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data))[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * _power(_INVERSE, len(data) + 1)[start]), np.searchsorted(start, at)


def shingle_sets(at: np.ndarray, data: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its shingles of `width` words; of fewer words, their sequence as one."""
    hashes, row = words(at, data)
    odd = mix(np.arange(1, width + 2, dtype=np.uint64)) | np.uint64(1)
    n = max(0, len(hashes) - width + 1)
    every = np.zeros(n, np.uint64)
    for k in range(width):
        every += hashes[k : k + n] * odd[k]
    every = mix(every)
    for a, b in zip(row[:-1].tolist(), row[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(every[a : b - width + 1])
        elif b > a:
            yield mix((hashes[a:b] * odd[: b - a]).sum(keepdims=True) + odd[width : width + 1] * np.uint64(b - a))
        else:
            yield hashes[:0]


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    at, data = utf8(column)
    for i, j in slices(at):
        yield from shingle_sets(at[i : j + 1], data, width)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that equal sets share."""
    return int(mix(s).sum().astype(np.int64)), int(np.bitwise_xor.reduce(mix(s ^ np.uint64(_BASE)), initial=np.uint64(0)).astype(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if not len(a) or not len(b):
        return 0
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class MinHash:
    """Signatures of `size` values: for each of as many random hash functions, 16 bits of the least hash of the set."""

    def __init__(self, size: int):
        seeds = mix(np.arange(1, 2 * size + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.a, self.b = (seeds[:size] | np.uint64(1))[:, None], seeds[size:][:, None]

    def __call__(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), np.uint64((1 << 64) - 1))
        for i in range(0, len(s), 2048):
            np.minimum(low, (self.a * s[None, i : i + 2048] + self.b).min(axis=1), out=low)
        return (low >> np.uint64(16)).astype(np.uint16).view(np.int16)  # not the upper bits, which are few in the least hash of a large set


def sketch(s: np.ndarray, bins: int) -> np.ndarray:
    """For each of `bins` (a power of two) equal ranges of hashes 8 bits of the least hash of the set in it; 0 for none, else 1 or more."""
    shift = np.uint64(65 - bins.bit_length())
    at = np.searchsorted(s, np.arange(bins, dtype=np.uint64) << shift)
    there = at < np.append(at[1:], len(s))
    out = np.zeros(bins, np.uint8)
    out[there] = (mix(s[at[there]]) >> np.uint64(48)) % np.uint64(255) + np.uint64(1)
    return out


def alike(sketches: np.ndarray, one: np.ndarray, least: float) -> np.ndarray:
    """Whether the share of ranges with equal hashes, of those that are not empty in both, is at least `least`."""
    same = (sketches == one) & (one != 0)
    return same.sum(axis=-1) >= least * ((sketches | one) != 0).sum(axis=-1)
