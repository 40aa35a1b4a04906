"""Whole texts to token ids of a byte-level BPE file, each distinct chunk encoded once a task.

Texts are cut where the pre-tokenizer's pattern always has a boundary: before a space between two characters which are
surely no white space (a space belongs to the word after it), around a line feed between such characters, and between a
letter and one of ``.,;:!?``. So chunks are encoded one by one as they would be within the text. Files with a normalizer, another pre-tokenizer, or added tokens that swallow spaces are applied to whole texts.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from ledgerline.llm.common import text_bytes

#: Distinct chunks that are kept with their ids.
KNOWN_CHUNKS = 400_000
#: Each encoded chunk is a large object of the library until its ids are taken.
ENCODED_AT_ONCE = 2_000
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_TWO = np.zeros(256, bool)  # lead bytes of two-byte characters, none of which is white space from C3 on
_TWO[0xC3:0xE0] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


def splits_at_spaces(path: str) -> bool:
    """Whether chunks may be encoded one by one."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    return (spec.get("normalizer") is None and spec.get("post_processor") is None and pre.get("type") == "ByteLevel"
            and bool(pre.get("use_regex")) and not pre.get("add_prefix_space") and not spec.get("truncation") and not spec.get("padding")
            and all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"]) for t in spec["added_tokens"]))


@functools.cache
def shared_encoder(path: str) -> Encoder:
    """One encoder a worker process, with what it knows from earlier tasks."""
    return Encoder(path)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk = splits_at_spaces(path)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.first = np.zeros(1, np.int64)  # of each known chunk's ids, and their end
        self.ids = np.zeros(0, np.uint32)

    def vocabulary_size(self) -> int:
        return self.tokenizer.get_vocab_size(with_added_tokens=True)

    def _learn(self, chunks: pa.Array) -> None:
        sizes, ids = [], [self.ids]
        for at in range(0, len(chunks), ENCODED_AT_ONCE):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(chunks.slice(at, ENCODED_AT_ONCE).to_pylist(), add_special_tokens=False)]
            sizes += map(len, coded)
            ids.append(np.fromiter(itertools.chain.from_iterable(coded), np.uint32))
        self.known = pa.concat_arrays([self.known, chunks])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes, dtype=np.int64)])
        self.ids = np.concatenate(ids)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in a row, and how many each has; null is empty."""
        raw, at = text_bytes(column)
        cut = np.zeros(len(raw) + 1, bool)
        if self.by_chunk and len(raw):
            self._cut(raw, cut)
        cut[at] = True
        cuts = np.flatnonzero(cut)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(column), np.int64)
        chunks = pa.Array.from_buffers(pa.large_string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        place = pc.index_in(chunks.dictionary, value_set=self.known)
        new = pc.is_null(place).to_numpy(zero_copy_only=False)
        if new.any() and len(self.known) and len(self.known) + int(new.sum()) > KNOWN_CHUNKS:
            self._forget()
            new = np.ones(len(place), bool)
        at_known = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        if new.any():
            at_known[new] = len(self.known) + np.arange(int(new.sum()))
            self._learn(chunks.dictionary.filter(pa.array(new)))
        which = at_known[chunks.indices.to_numpy()]
        size = self.first[which + 1] - self.first[which]
        ends = np.cumsum(size)
        total = int(ends[-1])
        ids = self.ids[np.repeat(self.first[which] - (ends - size), size) + np.arange(total)]
        reach = np.append(0, ends)[np.searchsorted(cuts, at)]
        return ids, np.diff(reach)

    @staticmethod
    def _cut(raw: np.ndarray, cut: np.ndarray) -> None:
        """Mark the positions in front of which no token reaches across."""
        plain = _PLAIN[raw]
        gap = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
        gap = gap[(gap > 0) & (gap < len(raw) - 1)]
        after = plain[gap + 1] | _TWO[raw[gap + 1]]
        before = plain[gap - 1] | (_TWO[raw[np.maximum(gap - 2, 0)]] & (gap > 1) & (raw[gap - 1] >= 0x80))
        gap = gap[after & before]
        cut[gap] = True
        cut[gap[raw[gap] == 0x0A] + 1] = True
        cut[1:-1] |= _MARK[raw[1:]] & _LETTER[raw[:-1]]
