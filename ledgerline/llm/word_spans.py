"""Words of whole texts as Arrow strings, with their rows and the pieces they stand in."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ledgerline.llm.common import slices, text_bytes

#: Bytes of text that are cut into words at a time.
SLICE_BYTES = 4 << 20


def byte_kinds(separators: bytes, breaks: bytes = b"") -> np.ndarray:
    """256 kinds: 0 of a word, 1 between words, 2 between pieces (and words). ASCII bytes only may separate."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(separators)] = 1
    kinds[list(breaks)] = 2
    return kinds


@dataclass
class Words:
    text: pa.Array  # large strings, in order
    row: np.ndarray  # of each word
    first: np.ndarray  # whether a word begins a piece (of its row)


def words(column: pa.Array, kinds: np.ndarray) -> Words:
    """The maximal runs of bytes of kind 0 within each row; null rows are empty."""
    raw, at = text_bytes(column)
    kind = kinds[raw]
    inside = kind == 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    rows = at[:-1][at[:-1] < len(raw)]
    begins[rows] = inside[rows]
    starts = np.flatnonzero(begins)
    del begins
    if not len(starts):
        return Words(pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, bool))
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.add.reduceat(inside, starts, dtype=np.int64), out=offsets[1:])
    text = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    row = np.searchsorted(at, starts, "right") - 1
    first = np.ones(len(starts), bool)
    first[1:] = (np.maximum.reduceat(kind, starts)[:-1] == 2) | (row[1:] != row[:-1])
    return Words(text, row, first)


def in_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive rows of about ``most`` bytes of text (one row may have more), with the number of the first."""
    column = pa.concat_arrays([column]).cast(pa.large_string())
    lengths = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1])
    for a, b in slices(lengths, most):
        yield a, column.slice(a, b - a)
