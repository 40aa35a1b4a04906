"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words that no piece can span (a space mark after any other character starts one), and the distinct
words of a slice are merged together in flat numpy arrays: one symbol per character, the rank of every adjacent pair,
the minimum rank of each word by a segmented reduction, all leftmost pairs of that rank merged at once, the arrays
compacted, until no word has a pair left. Ranks for which merging at once could differ from one merge at a time
(equal scores, or a piece that grows into a better-scored one) merge one pair a word and round.

Results: a null or empty text has only the begin and end ids; a character outside the vocabulary becomes its UTF-8
byte pieces (the unknown id where the model has none). Decoding drops control ids, strips the one leading space mark
that encoding adds, and replaces each invalid byte by U+FFFD. Rows are independent: nothing is shuffled, and a task
holds one Arrow batch, a slice of about ``SLICE_CHARS`` characters (or one longer text) and a bounded word table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import slices, tidily, with_schema, without

SLICE_CHARS = 1_000_000
ROUND_CHARS = 200_000
TABLE_WORDS = 200_000
NONE = np.int32(2**31 - 1)
MARK = "▁"


@dataclass
class Model:
    """Plain arrays of a model file; small enough (a few MB) to broadcast."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]  # 1 normal, 2 unknown, 3 control, 6 byte
    dummy_prefix: bool
    byte_fallback: bool
    unk: int
    bos: int
    eos: int
    unk_surface: str


def load_model(path: str) -> Model:
    """Read a SentencePiece BPE model with identity normalisation; any other kind is refused."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    t, n = m.trainer_spec, m.normalizer_spec
    if t.model_type != t.BPE or n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
        raise ValueError("only BPE models with identity normalisation are supported")
    if any(p.type not in (1, 2, 3, 6) for p in m.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    return Model([p.piece for p in m.pieces], [p.score for p in m.pieces], [p.type for p in m.pieces],
                 n.add_dummy_prefix, t.byte_fallback, t.unk_id, t.bos_id, t.eos_id, t.unk_surface)


class Encoder:
    """Lookup tables of a model and the merge rounds."""

    def __init__(self, model: Model):
        self.model, self.size = model, len(model.pieces)
        normal = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k == 1}
        self.symbol = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)  # outside the vocabulary: size + code point
        for p, i in normal.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.byte_id = np.full(256, model.unk, np.int32)
        for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
            if k == 6:
                self.byte_id[int(p[3:5], 16)] = i
        by_score = sorted({model.scores[i] for i in normal.values()}, reverse=True)
        place = {s: r for r, s in enumerate(by_score)}
        rank = {p: place[model.scores[i]] for p, i in normal.items()}
        shared = np.bincount(list(rank.values()), minlength=len(place))
        self.single = shared > 1  # by rank: merge one pair a word and round
        keys, merged = [], []
        joined: set[int] = set()
        crosses = False
        newline_inside = False
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                for part in (a, b):
                    if rank.get(part, -1) > rank[p]:
                        self.single[rank[part]] = True
                x = normal.get(a, self.size + ord(a) if k == 1 else None)
                y = normal.get(b, self.size + ord(b) if k == len(p) - 1 else None)
                if x is not None and y is not None:
                    keys.append(x << 21 | y)
                    merged.append(i)
                joined.add(self._bigram(np.int64(self.symbol[ord(p[k - 1])]), np.int64(self.symbol[ord(p[k])])))
                crosses |= p[k] == MARK and p[k - 1] != MARK
            newline_inside |= "\n" in p
        self.rank_of = np.full(self.size, NONE, np.int32)
        for p, i in normal.items():
            self.rank_of[i] = rank[p]
        self.joinable = np.zeros(1 << 20, bool)
        self.joinable[list(joined)] = True
        self._hash(np.array(keys, np.int64), np.array(merged, np.int32))
        word = " *[^ ]+| +" if newline_inside else " *[^ \n]+| +|\n"
        self.words = re.compile("(?s).+" if crosses else word)
        self.table: dict[str, bytes] = {}

    @staticmethod
    def _bigram(a, b):
        """Slot of two adjacent symbols among 2**20; a shared slot only joins words that could have been cut."""
        return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77)) >> 7 & 0xFFFFF

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several, the last stays
            placed = self.keys[at[left]] == keys[left]
            self.values[at[left[placed]]] = values[left[placed]]
            left = left[~placed]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Piece made of each pair of symbols, -1 where there is none."""
        key = left.astype(np.int64) << 21 | right
        at = self._slot(key)
        seen, out = self.keys[at], self.values[at]
        more = np.flatnonzero((seen != key) & (seen != -1))
        out[seen != key] = -1
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            seen = self.keys[at[more]]
            hit = seen == key[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (seen != -1)]
        return out

    def _ranks(self, piece: np.ndarray) -> np.ndarray:
        return np.where(piece >= 0, self.rank_of[np.maximum(piece, 0)], NONE)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words that already carry their space marks as spaces."""
        flat = "".join(words).replace(" ", MARK)
        if not flat:
            return [b""] * len(words)
        sym = self.symbol[np.frombuffer(flat.encode("utf-32-le"), np.uint32)]
        n = len(sym)
        word_len = np.fromiter(map(len, words), np.int64, len(words))
        word_end = np.cumsum(word_len)
        first = np.zeros(n, bool)
        first[1:] = ~self.joinable[self._bigram(sym[:-1].astype(np.int64), sym[1:].astype(np.int64))]
        first[(word_end - word_len)[word_len > 0]] = True
        out = np.full(n, -1, np.int32)  # symbols at the place of their first character
        pos = np.arange(n)
        starts = np.flatnonzero(first)
        lens = np.diff(np.append(starts, n))
        piece = np.full(n, -1, np.int32)
        inside = np.flatnonzero(~first[1:])
        piece[inside] = self.merged(sym[inside], sym[inside + 1])
        rank = self._ranks(piece)
        while len(sym):
            best = np.minimum.reduceat(rank, starts)
            over = best == NONE
            if over.any():
                gone = np.repeat(over, lens)
                out[pos[gone]] = sym[gone]
                keep = ~gone
                sym, pos, piece, rank = sym[keep], pos[keep], piece[keep], rank[keep]
                lens, best = lens[~over], best[~over]
                starts = np.cumsum(lens) - lens
                if not len(sym):
                    break
            segment = np.repeat(np.arange(len(lens)), lens)
            at = np.flatnonzero(rank == best[segment])
            new = np.ones(len(at), bool)
            new[1:] = at[1:] != at[:-1] + 1
            run = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            of = segment[at]
            head = np.ones(len(at), bool)
            head[1:] = of[1:] != of[:-1]
            at = at[np.where(self.single[best[of]], head, (at - run) % 2 == 0)]
            sym[at] = piece[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            lens = lens - np.bincount(segment[at], minlength=len(lens))
            at = at - np.arange(len(at))  # after compaction
            sym, pos, piece, rank = sym[keep], pos[keep], piece[keep], rank[keep]
            ends = np.cumsum(lens)
            starts = ends - lens
            last = np.zeros(len(sym), bool)
            last[ends - 1] = True
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            touched[at[at > 0] - 1] = True
            fresh = np.flatnonzero(touched)
            inner = fresh[~last[fresh]]
            piece[fresh] = -1
            piece[inner] = self.merged(sym[inner], sym[inner + 1])
            rank[fresh] = self._ranks(piece[fresh])
        at = np.flatnonzero(out >= 0)
        ids = out[at]
        ends = np.searchsorted(at, word_end)
        if (ids >= self.size).any():
            ids, ends = self._bytes(ids, ends)
        raw = ids.astype("<u4").tobytes()
        ends = (ends * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _bytes(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters outside the vocabulary as byte pieces, or the unknown id."""
        code = ids.astype(np.int64) - self.size
        if not self.model.byte_fallback:
            return np.where(code >= 0, self.model.unk, ids), ends
        n = np.where(code < 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
        to = np.cumsum(n)
        wide, code, size = np.repeat(ids, n), np.repeat(code, n), np.repeat(n, n)
        j = np.arange(len(wide)) - np.repeat(to - n, n)
        low = code >> (6 * (size - 1 - j))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
        byte = np.where(j == 0, lead | low, 0x80 | (low & 0x3F)) & 0xFF
        to = np.concatenate([[0], to])
        return np.where(code >= 0, self.byte_id[byte], wide), to[ends]

    def encode(self, texts: list[str], bos: bool, eos: bool) -> list[bytes]:
        """Ids of whole texts; the word table is emptied between slices once it is full."""
        if len(self.table) > TABLE_WORDS:
            self.table.clear()
        prefix = " " if self.model.dummy_prefix else ""
        split = [self.words.findall((prefix + t).replace(MARK, " ")) if t else [] for t in texts]
        missing = [w for w in dict.fromkeys(w for ws in split for w in ws) if w not in self.table]
        for a, b in slices(np.fromiter(map(len, missing), np.int64, len(missing)), ROUND_CHARS):
            self.table.update(zip(missing[a:b], self.encode_words(missing[a:b]), strict=True))
        head = np.array([self.model.bos] if bos else [], "<u4").tobytes()
        tail = np.array([self.model.eos] if eos else [], "<u4").tobytes()
        get = self.table.__getitem__
        return [head + b"".join(map(get, ws)) + tail for ws in split]


class Decoder:
    def __init__(self, model: Model):
        self.model = model
        surface = {1: lambda p: p.replace(MARK, " ").encode(), 2: lambda p: model.unk_surface.encode(),
                   3: lambda p: b"", 6: lambda p: bytes([int(p[3:5], 16)])}
        self.bytes = [surface[k](p) for p, k in zip(model.pieces, model.kinds, strict=True)]
        self.kinds = model.kinds
        self.control = {i for i, k in enumerate(model.kinds) if k == 3}

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        a, b = 0, len(ids)
        while a < b and ids[a] in self.control:
            a += 1
        while a < b and ids[b - 1] in self.control:
            b -= 1
        ids = ids[a:b]
        try:
            text = b"".join([self.bytes[i] for i in ids]).decode() if self.control.isdisjoint(ids) else self._repair(ids)
        except UnicodeDecodeError:
            text = self._repair(ids)
        return text[1:] if self.model.dummy_prefix and ids and self.kinds[ids[0]] == 1 and text[:1] == " " else text

    def _repair(self, ids: list[int]) -> str:
        """Byte runs are decoded on their own; each byte of no valid character becomes U+FFFD."""
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.kinds[i] == 6:
                run += self.bytes[i]
                continue
            while run:
                for n in range(1, 5):
                    try:
                        out.append(run[:n].decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    n = 1
                    out.append("�")
                run = run[n:]
            if i is not None:
                out.append(self.bytes[i].decode())
        return "".join(out)


_LIVE: dict[tuple[str, int], object] = {}


def _live(kind, shared):
    """One encoder or decoder a worker process and broadcast."""
    key = (kind.__name__, shared.id if hasattr(shared, "id") else id(shared))
    if key not in _LIVE:
        if len(_LIVE) > 1:
            _LIVE.clear()
        _LIVE[key] = kind(shared.value)
    return _LIVE[key]


def encode(df: DataFrame, model: str, text: str = "text", out: str = "ids", bos: bool = True, eos: bool = True, decoded: str | None = None) -> DataFrame:
    """Add ``out``: the ids of ``text`` packed as little-endian unsigned 32-bit integers. ``model``: path of the model file.

    ``decoded`` names a column for the text that the ids decode to, made in the same pass.
    """
    shared = df.sparkSession.sparkContext.broadcast(load_model(model))
    added = [(out, T.BinaryType())] + ([(decoded, T.StringType())] if decoded else [])
    schema = with_schema(df, added)
    names = [f.name for f in schema.fields[: -len(added)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _live(Encoder, shared)
        for batch in batches:
            column = batch.column("__text")
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_CHARS):
                packed = encoder.encode(column.slice(a, b - a).to_pylist(), bos, eos)
                made = [pa.array(packed, pa.binary())]
                if decoded:
                    made.append(pa.array([_live(Decoder, shared).decode(x) for x in packed], pa.string()))
                kept = [batch.column(n).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *made], schema.names)
        encoder.table.clear()

    return without(df.withColumn("__text", F.col(text).cast("string")), *(n for n, _ in added)).mapInArrow(tidily(run), schema)


def decode(df: DataFrame, model: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of the packed ids; null ids give null."""
    shared = df.sparkSession.sparkContext.broadcast(load_model(model))
    schema = with_schema(df, [(out, T.StringType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _live(Decoder, shared)
        for batch in batches:
            column = batch.column("__ids")
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_CHARS):
                texts = [None if x is None else decoder.decode(x) for x in column.slice(a, b - a).to_pylist()]
                kept = [batch.column(n).slice(a, b - a) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names, out])

    return without(df.withColumn("__ids", F.col(ids)), out).mapInArrow(tidily(run), schema)
