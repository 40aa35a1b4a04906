"""Vectorised word hashes and word windows of whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ledgerline.llm.common import text_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads every bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashed_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in order: a hash of each word, the number of words a row, and where each word's bytes start and end."""
    raw, at = text_bytes(column)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < len(raw)]
    first[rows] = inside[rows]
    kept = np.flatnonzero(inside)
    starts = np.flatnonzero(first)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(column), np.int64), none, none
    begin = np.searchsorted(kept, starts)  # of each word among the kept bytes
    size = np.diff(np.append(begin, len(kept)))
    place = np.arange(len(kept)) - np.repeat(begin, size)
    value = _BYTE[raw[kept]] * powers(_STEP, int(size.max()))[place]
    words = mix(np.add.reduceat(value, begin) + size.astype(np.uint64) * _GOLD)
    counts = np.diff(np.searchsorted(starts, at))
    return words, counts, starts, starts + size


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that start at each word (the last k-1 aren't windows)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * _STEP + words[i:i + n]
    return mix(h)


def shingled(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number a row) of the k-word shingles; a row of fewer words has one shingle of all, a row of none has none."""
    ends = np.cumsum(counts)
    starts = ends - counts
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    first = np.cumsum(n) - n
    at = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(starts, n)
    h = windows(np.concatenate([words, np.zeros(k - 1, np.uint64)]), k)[at]
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        part = np.concatenate([words[starts[r]:ends[r]], np.full(k - counts[r], _GOLD)])
        h[first[r]] = windows(part, k)[0]
    return h, n


def multiset(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row sorted hashes in which the j-th repeat of a hash has become a hash of its own, and the sorted hashes."""
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    repeat = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    again = np.flatnonzero(repeat)
    out = h.copy()
    out[again] = mix(h[again] + repeat[again].astype(np.uint64) * _GOLD)
    return out, h
