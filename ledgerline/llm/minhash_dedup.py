"""Near-duplicate groups by weighted MinHash.

A text's features are its five-word shingles with their repeats, weighted by term frequency times a damped inverse
document frequency: 1 + log((1 + N) / (1 + df)) / (2 log(1 + N)), in 16 levels, where df is the shingle's own
document frequency (by its 64-bit hash) over all documents. Shingles are dealt out by hash and counted; those of two
documents or more go back to the chunks of documents that have them, any other has a df of 1. Improved consistent weighted sampling draws
``SAMPLES`` samples a text; four make a band, and texts that share a band meet. Texts that agree on at least
``PLAUSIBLE`` of all samples (one byte each travels along) are joined to candidate groups, and inside these every pair
that shares a band is verified: two texts are linked when the weighted Jaccard similarity of their shingles is
``SIMILARITY`` or more. Classes are the connected components of the links; exact copies are folded first and unfolded
last.

No pairs are emitted: tasks hand on spanning forests. A candidate group beyond ``BLOCK`` texts is compared block by
block: every block with itself and with the first, then whatever isn't in the group's main class yet with all blocks,
so a large group of true copies costs a multiple of its size and loses no link. A band bucket beyond ``BUCKET`` texts
is taken as one candidate group without comparing samples. Texts are shuffled once,
compressed, into chunks of about ``CHUNK`` documents, and not again while the candidates can be broadcast (the bytes of
all rows that would be are checked).

Results: null texts and texts without words are each a class of their own, except rows of one id; a text of fewer than
five words has one shingle; rows that share an id share a class; rows without id get a null class; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import hinted, save, slices, tidily
from ledgerline.llm.components import components
from ledgerline.llm.shingles import hashed_words, mix, multiset, shingled

WORDS = 5
SIMILARITY = 0.8
PLAUSIBLE = 0.6
SAMPLES, ROWS = 64, 4
SLOT_BITS, LEVELS = 20, 16
POOL_BITS = 16
BLOCK, BUCKET, PACK = 512, 4096, 256
SLICE_BYTES = 1_500_000
CHUNK, BUCKET_SHINGLES, HELD_SHINGLES = 256, 1 << 20, 1 << 21
BROADCAST_BYTES = 64 << 20


def weight(level: np.ndarray) -> np.ndarray:
    return 1 + level / (2 * (LEVELS - 1))


def slot(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(lengths, SLICE_BYTES):
        yield column.slice(a, b - a)


def levels_of(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Weight level of each of 2**20 shingle slots, by the documents a slot has: an estimate that fades as input grows.

    ``near_duplicates`` counts shingles instead; while a slot has one shingle at most the levels are the same.
    """
    blocks, fan = 64, 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        df, n = np.zeros(1 << SLOT_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in _slices(batch.column(0)):
                h, per = shingled(*hashed_words(part)[:2], WORDS)
                key = np.unique(np.repeat(np.arange(len(per), dtype=np.int64), per) << SLOT_BITS | slot(h))
                df += np.bincount(key & ((1 << SLOT_BITS) - 1), minlength=1 << SLOT_BITS)
        group = TaskContext.get().partitionId() // fan
        yield pa.RecordBatch.from_arrays([pa.array([group] * blocks, pa.int32()), pa.array(range(blocks), pa.int32()), pa.array([n if b == 0 else 0 for b in range(blocks)]),
                                          pa.array([x.astype("<i8").tobytes() for x in np.split(df, blocks)], pa.binary())], ["grp", "block", "n", "df"])

    def add(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<i8") for x in rows.column("df").to_pylist())
        return pa.table({"grp": rows.column("grp")[:1], "block": rows.column("block")[:1], "n": [sum(rows.column("n").to_pylist())], "df": [total.tobytes()]})

    schema = "grp int, block int, n long, df binary"
    counts = docs.select(F.col(text).cast("string")).mapInArrow(tidily(count), schema)
    for keys in (("grp", "block"), ("block",)):  # partial sums of up to 256 partitions, then of those
        counts = counts.groupBy(*keys).applyInArrow(add, schema)
    rows = sorted(counts.collect(), key=lambda r: r["block"])
    if not rows:
        return np.zeros(1 << SLOT_BITS, np.uint8)
    n = sum(r["n"] for r in rows)
    df = np.concatenate([np.frombuffer(bytes(r["df"]), "<i8") for r in rows])
    return level(df, n)


def level(df: np.ndarray, n: int) -> np.ndarray:
    """Weight level of document frequencies among ``n`` documents."""
    idf = np.log((1 + n) / (1 + df)) / np.log(1 + n) if n else np.zeros(len(df))
    return np.rint(np.clip(idf, 0, 1) * (LEVELS - 1)).astype(np.uint8)


def shingle_levels(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Levels of the shingles that stand in two of ``n`` documents (chunk, text) or more, to every chunk that has them.

    Rows are (chunk, shingles, levels), a few for each chunk. A shingle counts once a document.
    """
    def bucket_of(h: np.ndarray) -> np.ndarray:
        place = h >> np.uint64(32)
        place *= np.uint64(buckets)
        place >>= np.uint64(32)
        return place.astype(np.int32)

    def packed(held: list) -> pa.RecordBatch:  # empties the list; what isn't read again goes at once
        h, doc, chunk = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(h, kind="stable")  # documents come in order, so repeats of one stand together
        h = h[order]
        doc = doc[order]
        del order
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h = h[first]
        chunk = chunk[doc[first]]
        del doc, first
        shared = np.zeros(len(h), bool)
        shared[1:] = h[1:] == h[:-1]
        shared[:-1] |= shared[1:]
        some, at = h[shared], chunk[shared]
        order = np.lexsort((at, some))
        some, at = some[order], at[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], (some[1:] != some[:-1]) | (at[1:] != at[:-1])])) if len(some) else np.zeros(0, np.int64)
        count = np.concatenate([np.ones(int((~shared).sum()), np.uint32), np.diff(np.append(first, len(some))).astype(np.uint32)])
        h = np.concatenate([h[~shared], some[first]])
        chunk = np.concatenate([chunk[~shared], at[first]])
        del some, at, first, shared
        bucket = bucket_of(h)
        order = np.lexsort((chunk, bucket))
        h = h[order]
        chunk, count, bucket = chunk[order].astype("<i4", copy=False), count[order].astype("<u4", copy=False), bucket[order]
        del order
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts = [0, *cuts.tolist()] if len(h) else []
        ends = [*cuts.tolist(), len(h)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()) if starts else pa.array([], pa.int32()),
                                           *(pa.array([x[a:b].tobytes() for a, b in zip(starts, ends, strict=False)], pa.binary()) for x in (h, chunk, count))],
                                          ["bucket", "shingles", "chunks", "counts"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        size = docs_held = 0
        for batch in batches:
            chunk = batch.column("chunk").to_numpy().astype(np.int32, copy=False)
            done = 0
            for part in _slices(batch.column("text")):
                h, per = shingled(*hashed_words(part)[:2], WORDS)
                held.append((h, np.repeat(np.arange(len(per), dtype=np.int32) + np.int32(docs_held), per), chunk[done:done + len(per)]))
                del h
                done, docs_held, size = done + len(per), docs_held + len(per), size + len(held[-1][0])
                if size >= HELD_SHINGLES:
                    yield packed(held)
                    size = docs_held = 0
        if held:
            yield packed(held)

    def count(rows: pa.Table) -> pa.Table:
        h, chunk, counts = (np.frombuffer(b"".join(rows.column(c).to_pylist()), t) for c, t in (("shingles", "<u8"), ("chunks", "<i4"), ("counts", "<u4")))
        order = np.argsort(h, kind="stable")
        h, chunk, counts = h[order], chunk[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        df = np.add.reduceat(counts, first, dtype=np.int64) if len(h) else first
        df = np.repeat(df, np.diff(np.append(first, len(h))))
        h, chunk, df = h[df > 1], chunk[df > 1], df[df > 1]
        order = np.lexsort((h, chunk))
        h, chunk, df = h[order], chunk[order], df[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (chunk[1:] != chunk[:-1])
        h, chunk, levels = h[new], chunk[new], level(df[new], n)
        cuts = (np.flatnonzero(np.diff(chunk)) + 1).tolist()
        spans = list(zip([0, *cuts], [*cuts, len(h)], strict=True)) if len(h) else []
        return pa.table({"chunk": pa.array([int(chunk[a]) for a, _ in spans], pa.int32()), "shingles": pa.array([h[a:b].tobytes() for a, b in spans], pa.binary()),
                         "levels": pa.array([levels[a:b].tobytes() for a, b in spans], pa.binary())})

    dealt = docs.select("chunk", "text").mapInArrow(tidily(deal), "bucket int, shingles binary, chunks binary, counts binary")
    return dealt.groupBy("bucket").applyInArrow(count, "chunk int, shingles binary, levels binary")


class Sampler:
    """Improved consistent weighted sampling with a pool of 2**16 variates, tabulated by weight level.

    For weight w and variates r, c ~ Gamma(2, 1), b ~ U(0, 1): t = floor(ln w / r + b), ln a = ln c - r (t - b) - r.
    The element of smallest a is drawn; its pool entry and the rest of its hash stand for (element, t).
    """

    def __init__(self, levels: np.ndarray | None = None):
        rng, n = np.random.default_rng(20), 1 << POOL_BITS
        r, c, b = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
        w = np.log(weight(np.arange(LEVELS)))[:, None]
        t = np.floor(w / r + b)
        log_a = np.log(c) - r * (t - b) - r
        order = np.unique(log_a, return_inverse=True)[1].reshape(-1)  # only the order counts
        self.rank = order.astype(np.uint64) << np.uint64(32)
        self.levels = levels
        self.seeds = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)

    def draw(self, shingles: np.ndarray, elements: np.ndarray, n: np.ndarray) -> np.ndarray:
        """rows x SAMPLES for rows with elements, of the levels that the sampler was made with."""
        return self.draw_at(self.levels[slot(shingles)], elements, n)

    def draw_at(self, levels: np.ndarray, elements: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The same for elements of the given levels."""
        row = levels.astype(np.int64) << POOL_BITS
        starts = np.cumsum(n) - n
        out = np.empty((len(n), SAMPLES), np.uint64)
        for k, seed in enumerate(self.seeds):
            x = elements * seed
            x ^= x >> np.uint64(29)
            key = self.rank[row | (x >> np.uint64(64 - POOL_BITS)).astype(np.int64)]
            key |= x & np.uint64(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat(key, starts)
        return out


@cache
def _sampler() -> Sampler:
    return Sampler()


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest, sketch, bands, levels) of all documents, the levels packed in the order of the sorted elements.

    Sketch, bands and levels are null where there are no words, and digest too where there is no id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n, chunks, buckets = size["n"], max(1, size["n"] // CHUNK), max(1, (size["bytes"] or 0) // (6 * BUCKET_SHINGLES))  # a word takes about 6 bytes
    rows = rows.withColumn("digest", F.md5("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(chunks)).cast("int"))
    single = int(level(np.ones(1), n)[0])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=3)
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "chunk")), pa.array([None if t is None else codec.compress(t, asbytes=True) for t in texts], pa.binary()),
                                              pa.array([0 if t is None else len(t) for t in texts], pa.int64())], ["doc_id", "digest", "chunk", "packed", "size"])

    def unpacked(texts: pa.Table) -> Iterator[pa.Array]:
        codec, size = pa.Codec("zstd"), texts.column("size").to_numpy()
        for a, b in slices(size, SLICE_BYTES):
            rows = zip(texts.column("packed").slice(a, b - a).to_pylist(), size[a:b].tolist(), strict=True)
            yield pa.array([None if t is None else codec.decompress(t, k, asbytes=True) for t, k in rows], pa.binary()).cast(pa.string())

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        sampler = _sampler()
        known = np.frombuffer(b"".join(found.column("shingles").to_pylist()), "<u8")
        order = np.argsort(known)
        known, known_level = known[order], np.frombuffer(b"".join(found.column("levels").to_pylist()), np.uint8)[order]
        sketches: list = []
        bands: list = []
        packed: list = []
        texts = texts.combine_chunks()
        for part in unpacked(texts):
            h, per = shingled(*hashed_words(part)[:2], WORDS)
            full = np.flatnonzero(per)
            elements, s = multiset(h, per)
            sketch, band, own = [None] * len(per), [None] * len(per), [None] * len(per)
            if len(full):
                levels = np.full(len(s), single, np.uint8)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    hit = known[at] == s
                    levels[hit] = known_level[at[hit]]
                drawn = sampler.draw_at(levels, elements, per[full])
                folded = mix(drawn)
                joint = np.zeros((len(full), SAMPLES // ROWS), np.uint64)
                for i in range(ROWS):
                    joint = mix(joint * np.uint64(0x9E3779B97F4A7C15) + folded[:, i::ROWS] + np.arange(SAMPLES // ROWS, dtype=np.uint64)[None, :])
                small = folded.astype(np.uint8)
                ends = np.cumsum(per)
                for i, r in enumerate(full.tolist()):
                    sketch[r], band[r] = small[i].tobytes(), joint[i].view(np.int64)
                    order = np.argsort(elements[ends[r] - per[r]:ends[r]])
                    own[r] = zlib.compress(levels[ends[r] - per[r]:ends[r]][order].tobytes(), 1)
            sketches += sketch
            bands += band
            packed += own
        return pa.table({"doc_id": texts.column("doc_id"), "digest": texts.column("digest"), "sketch": pa.array(sketches, pa.binary()),
                         "bands": pa.array(bands, pa.list_(pa.int64())), "levels": pa.array(packed, pa.binary())})

    schema = "doc_id long, digest string, sketch binary, bands array<long>, levels binary"
    named = rows.filter("doc_id IS NOT NULL").select("doc_id", "digest", "chunk", "text")
    named = named.mapInArrow(tidily(pack), "doc_id long, digest string, chunk int, packed binary, size long")  # the one shuffle of whole texts
    signed = named.groupBy("chunk").cogroup(shingle_levels(rows, n, buckets).groupBy("chunk")).applyInArrow(lambda a, b: run(a, b) if a.num_rows else _nothing(schema), schema)
    return signed.unionByName(rows.filter("doc_id IS NULL").select("doc_id"), allowMissingColumns=True)


def _nothing(schema: str) -> pa.Table:
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.table({name: pa.array([], types[kind]) for name, kind in (f.split(" ") for f in schema.split(", "))})


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each index's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    return label


def plausible_edges(buckets: DataFrame) -> DataFrame:
    """Forests (a, b) of the texts that share a band (band, node, sketch) and agree on enough samples."""

    def edges(node: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(node)
        if n > BUCKET:
            return node[1:], np.full(n - 1, node[0])
        left, right = [], []
        for i in range(n - 1):
            near = np.flatnonzero((sketch[i + 1:] == sketch[i]).sum(axis=1) >= PLAUSIBLE * SAMPLES) + i + 1
            left.append(np.full(len(near), i))
            right.append(near)
        a, b = np.concatenate(left), np.concatenate(right)
        label = _forest(n, a, b)
        away = np.flatnonzero(label != np.arange(n))
        return node[away], node[label[away]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            if not rows.num_rows:
                continue
            band = rows.column("band").to_numpy()
            last = int(np.searchsorted(band, band[-1])) if (band[:-1] <= band[1:]).all() else 0
            held = rows.slice(last)
            if held.num_rows > 4 * BUCKET:  # a huge bucket goes on; its rest joins its first text
                node = held.column("node").to_numpy()
                yield _pairs([(node[1:], np.full(len(node) - 1, node[0]))])
                held = pa.concat_tables([held.slice(0, 1)] * (BUCKET + 1)).combine_chunks()
            yield _pairs(buckets_of(rows.slice(0, last)))
        if held is not None:
            yield _pairs(buckets_of(held))

    def buckets_of(rows: pa.Table):
        band, node = rows.column("band").to_numpy(), rows.column("node").to_numpy()
        if not len(band):
            return
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(band), SAMPLES)
        first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        size = np.diff(np.append(first, len(band)))
        for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
            yield edges(node[a:a + n], sketch[a:a + n])

    def _pairs(found) -> pa.RecordBatch:
        found = list(found)
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return buckets.repartition("band").sortWithinPartitions("band", "node").mapInArrow(tidily(run), "a long, b long").filter("a != b").distinct()


def links(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Forests (a, b) of the verified links in each ``pack`` of (pack, side, grp, node, bands, elements, their levels).

    Pairs are those of one grp that share a band; with side 1 and 2 present only pairs across, of different label.
    """
    weights = weight(np.arange(LEVELS, dtype=np.float64))

    def verify(rows: pa.Table) -> pa.Table:
        group, node, side, label = (rows.column(c).to_numpy() for c in ("grp", "node", "side", "label"))
        packed = rows.column("elements").to_pylist()
        levels = rows.column("levels").to_pylist()
        bands = np.array(rows.column("bands").to_pylist(), np.int64)
        a_all, b_all = [], []
        order = np.argsort(group, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if len(at) < 2:
                continue
            i, j = _sharing(bands[at], side[at], label[at])
            if not len(i):
                continue
            e = [np.frombuffer(packed[x], np.uint64) for x in at]
            w = [weights[np.frombuffer(zlib.decompress(levels[x]), np.uint8)] for x in at]
            total = np.array([x.sum() for x in w])
            # the smaller total bounds the shared weight
            fits = np.minimum(total[i], total[j]) >= similarity * np.maximum(total[i], total[j]) * (1 - 1e-9)
            i, j = i[fits], j[fits]
            common = _common(e, w, i, j)
            yes = common >= similarity * (total[i] + total[j] - common) - 1e-9
            a_all.append(node[at[i[yes]]])
            b_all.append(node[at[j[yes]]])
        if not a_all:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        names, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _forest(len(names), inverse[:len(a)], inverse[len(a):])
        away = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": names[away], "b": names[root[away]]})

    return members.groupBy("pack").applyInArrow(verify, "a long, b long")


def _sharing(bands: np.ndarray, side: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j that share a band and are to be compared."""
    n = len(bands)
    across = side.max() > 0
    left, right = [], []
    for i in range(n - 1):
        near = (bands[i + 1:] == bands[i]).any(axis=1)
        if across:
            near &= (side[i + 1:] != side[i]) & (label[i + 1:] != label[i])
        at = np.flatnonzero(near) + i + 1
        left.append(np.full(len(at), i))
        right.append(at)
    return np.concatenate(left), np.concatenate(right)


def _common(e: list, w: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Weight of the shared elements of each pair: merges for few pairs, matrix products for many."""
    if len(i) <= 4 * len(e):
        return np.array([w[a][np.isin(e[a], e[b], assume_unique=True)].sum() for a, b in zip(i.tolist(), j.tolist(), strict=True)])
    row = np.repeat(np.arange(len(e)), [len(x) for x in e])
    names, column, count = np.unique(np.concatenate(e), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    held = count[column] > 1
    row, column, value = row[held], place[column[held]], np.concatenate(w)[held]
    order = np.argsort(column, kind="stable")
    row, column, value = row[order], column[order], np.sqrt(value[order])
    total = np.zeros((len(e), len(e)))
    width = 4096
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        x = np.zeros((len(e), width), np.float32)
        x[row[lo:hi], column[lo:hi] - a] = value[lo:hi]
        total += x @ x.T
    edge = total[i, j]
    return np.where(edge > 0, edge, 0.0)


def _with_elements(docs: DataFrame, members: DataFrame, text: str) -> DataFrame:
    """Candidates (node, digest, ...) with their sorted elements, read from the texts of the documents they stand for.

    The candidates, as often as they are compared, are broadcast if they take at most BROADCAST_BYTES; else both sides are
    shuffled by node.
    """
    size = members.agg(F.sum(F.octet_length("levels") + 8 * F.size("bands") + F.octet_length("pack") + 64)).first()[0] or 0
    few = F.broadcast(members) if size <= BROADCAST_BYTES else members
    rows = docs.select(F.col("doc_id").cast("long").alias("node"), F.col(text).cast("string").alias("text")).join(few, "node")
    rows = rows.filter(F.md5("text") == F.col("digest")).drop("digest")
    kept = [f for f in rows.schema.fieldNames() if f != "text"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements: list = []
            for part in _slices(batch.column("text")):
                h, n = shingled(*hashed_words(part)[:2], WORDS)
                e, _ = multiset(h, n)
                ends = np.cumsum(n).tolist()
                elements += [np.sort(e[a:b]).tobytes() for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(elements, pa.binary())], [*kept, "elements"])

    return rows.mapInArrow(tidily(run), schema + ", elements binary")


def near_duplicates(docs: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, n_class) of every row of ``docs``: the smallest doc_id of its class and the class's rows."""
    signed = save(signatures(docs, text), "minhash-signatures")
    texts = signed.filter("sketch IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("levels").alias("levels"))
    texts = save(texts, "minhash-texts")
    buckets = texts.select(F.explode("bands").alias("band"), "node", "sketch")
    groups = components(plausible_edges(buckets))
    sizes = groups.groupBy("root").count()
    grouped = groups.join(sizes, "root").join(texts.select("node", "digest", "bands", "levels"), "node")
    grouped = save(grouped.select("node", F.col("root").alias("grp"), "count", "digest", "bands", "levels"), "minhash-groups")
    n = grouped.count()
    packs = max(1, n // PACK)
    small = grouped.filter(F.col("count") <= BLOCK).select("node", "grp", "digest", "bands", "levels", F.lit(0).alias("side"), F.lit(0).cast("long").alias("label"),
                                                            F.concat_ws(":", F.lit("s"), F.pmod(F.xxhash64("grp"), F.lit(packs))).alias("pack"))
    blocks = F.ceil(F.col("count") / BLOCK)
    big = grouped.filter(F.col("count") > BLOCK).withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    same = big.select("node", "grp", "digest", "bands", "levels", F.lit(0).alias("side"), F.lit(0).cast("long").alias("label"), F.concat_ws(":", F.lit("b"), "grp", "block").alias("pack"))
    lead = big.filter("block = 0").withColumn("to", F.explode(F.sequence(F.lit(1).cast("long"), blocks - 1)))
    lead = lead.select("node", "grp", "digest", "bands", "levels", F.lit(1).alias("side"), F.lit(1).cast("long").alias("label"), F.concat_ws(":", F.lit("l"), "grp", "to").alias("pack"))
    rest = big.filter("block > 0").select("node", "grp", "digest", "bands", "levels", F.lit(2).alias("side"), F.lit(2).cast("long").alias("label"), F.concat_ws(":", F.lit("l"), "grp", "block").alias("pack"))
    first = small.unionByName(same).unionByName(lead).unionByName(rest)
    found = save(links(_with_elements(docs, first, text), similarity), "minhash-links")
    if big.select("node").limit(1).count():
        found = found.unionByName(_leftovers(docs, big, found, similarity, text))
    by_id = signed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e"))
    per_text = texts.select("digest", "node")
    classes = components(found.unionByName(_repeated_ids(signed, by_id, per_text)))
    named = per_text.join(classes, "node", "left").select("digest", F.coalesce("root", "node").alias("class"))
    out = signed.select("doc_id", "digest", F.col("sketch").isNotNull().alias("worded")).join(named, "digest", "left")
    out = out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.when(F.col("worded"), F.col("class")).otherwise(F.col("doc_id"))).alias("class_id"))
    sizes = out.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_class"))
    return out.join(sizes, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_class", F.lit(1)).cast("long").alias("n_class"))


def _repeated_ids(signed: DataFrame, by_id: DataFrame, per_text: DataFrame) -> DataFrame:
    """Edges between the texts of rows that share an id."""
    several = by_id.filter("d != e").select("doc_id")
    return signed.join(several, "doc_id").join(per_text, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))


def _leftovers(docs: DataFrame, big: DataFrame, found: DataFrame, similarity: float, text: str) -> DataFrame:
    """Links of the texts of large groups that aren't in their group's main class after the first round."""
    classes = components(found)
    now = big.join(classes, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root")
    per = now.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("m"))
    main = per.groupBy("grp").agg(F.max(F.struct("m", F.col("label"))).alias("x")).select("grp", F.col("x.label").alias("main"))
    now = save(now.join(main, "grp"), "minhash-large")
    left = now.filter("label != main")
    slots = left.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("k"))
    blocks = F.ceil(F.col("count") / BLOCK)
    ask = left.join(slots, "grp").withColumn("q", F.pmod(F.xxhash64(F.col("node"), F.lit(1)), F.col("k")))
    ask = ask.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    ask = ask.select("node", "grp", "digest", "bands", "levels", F.lit(1).alias("side"), "label", F.concat_ws(":", "grp", "q", "to").alias("pack"))
    held = now.join(slots, "grp").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    held = held.select("node", "grp", "digest", "bands", "levels", F.lit(2).alias("side"), "label", F.concat_ws(":", "grp", "q", "block").alias("pack"))
    return save(links(_with_elements(docs, ask.unionByName(held), text), similarity), "minhash-links")
