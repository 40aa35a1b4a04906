"""Removal of repeated word passages over a whole corpus, with suffix automata of reference shards.

A window is ``WINDOW`` consecutive words of one document; every word covered by a window whose word sequence also
starts earlier (in a smaller doc_id, or earlier in the same document) goes. Windows are judged on the input.

The reference is made of the passages that recur: every window that starts somewhere for the first time and stands
elsewhere again. It is cut into shards of about ``SHARD_WORDS`` words; a task builds the suffix automaton of a shard,
streams the passages of other documents that may be copies through it, and where the matching statistic reaches the
window and the state's first start is earlier, the window goes. Overlapping windows join to maximal spans. Since the
reference grows with the corpus, a shard goes to the tasks that need it instead of being broadcast to all;
``remove_known`` broadcasts the automaton of a reference of bounded size.

What recurs is found by anchors: each window is filed under the smallest hash of the 5-word groups inside it, the first
of equals. Equal windows have equal anchors, so one shuffled row for about nine windows (anchor hash, document, place,
and 32 bits of hash for each window) brings all repeats together. A task keeps only the first of the windows that it has
seen repeated itself, so a passage that stands in a third of all documents reaches the shuffle about once a task.
A copy goes to the shard that holds the document it is a copy of. Hashes only choose what is streamed; the
automaton compares words.

Results: null texts and texts under ``WINDOW`` words lose nothing; rows that share an id are taken as one document,
whose removed places go from each of them; rows without id neither lose words nor remove any; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.llm.common import WORD, hinted, save, slices, tidily, with_schema, without, word_count
from ledgerline.llm.shingles import hashed_words, windows
from ledgerline.llm.suffix_automaton import SuffixAutomaton

WINDOW = 20
GROUP = 5
SLICE_BYTES = 2_000_000
SEEN = 500_000
SHARD_WORDS = 200_000
STREAMED = 500_000     # windows that a task streams, about
BROADCAST_IDS = 500_000
_WORD = re.compile(WORD)
_BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.int64)


def anchors(words: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word of each window, its hash, place of its anchor) for the windows inside rows, and the groups' hashes."""
    ends = np.repeat(np.cumsum(counts), counts)
    at = np.flatnonzero(np.arange(len(words)) + window <= ends)
    g = windows(words, GROUP)
    span, best, reach = window - GROUP + 1, np.arange(len(g)), 1
    while reach < span:  # leftmost smallest of the next `reach` groups, doubled
        step = min(reach, span - reach)
        n = len(best) - step
        other = best[step:]
        best = np.where(g[other] < g[best[:n]], other, best[:n])
        reach += step
    return at, windows(words, window)[at], best[at], g


def _packed(value: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """32 bits of each kept hash, as bytes."""
    return (value[keep] >> np.uint64(32)).astype("<u4").view(np.uint8)


class _Combiner:
    """What a task has already seen repeated: window hashes and the smallest document that sent each on."""

    def __init__(self):
        self.hash, self.doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def later(self, value: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows that a smaller document of this task has sent on, or that stand earlier in this slice (sorted by
        document); the document that sent them; and the windows that others here are copies of."""
        order = np.argsort(value, kind="stable")
        v, d = value[order], doc[order]
        again = np.zeros(len(v), bool)
        again[1:] = v[1:] == v[:-1]
        first = np.maximum.accumulate(np.where(~again, np.arange(len(v)), 0))
        out, sender = np.zeros(len(v), bool), np.zeros(len(v), np.int64)
        out[order], sender[order] = again, d[first]
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
            known = (self.hash[at] == value) & (self.doc[at] < doc)
            out |= known
            sender = np.where(known, self.doc[at], sender)
        fresh = np.unique(first[again])
        copied = np.zeros(len(v), bool)
        copied[order[fresh]] = True
        if len(fresh) and len(self.hash) < SEEN:
            h, d = np.concatenate([self.hash, v[fresh]]), np.concatenate([self.doc, d[fresh]])
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            one = np.ones(len(h), bool)
            one[1:] = h[1:] != h[:-1]
            self.hash, self.doc = h[one], d[one]
        return out, sender, copied


#: sent: windows to be compared, with their hashes under the anchor as key; gone: copies of windows that ``ref`` sent.
ANCHORS = "key long, doc long, place int, sent int, gone int, copied int, ref long, hashes binary"


def _anchor_rows(column: pa.Array, doc: np.ndarray, combiner: _Combiner, window: int) -> pa.RecordBatch:
    words, counts, *_ = hashed_words(column)
    at, value, anchor, groups = anchors(words, counts, window)
    row = np.repeat(np.arange(len(counts)), counts)[at]
    place = at - (np.cumsum(counts) - counts)[row]
    later, sender, copied = combiner.later(value, doc[row])
    held = groups[anchor].view(np.int64)

    def rows_of(which: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first windows, masks, masks of the copied) of the runs of ``which`` with one anchor and one ``by``."""
        w = np.flatnonzero(which)
        new = np.ones(len(w), bool)
        new[1:] = (anchor[w[1:]] != anchor[w[:-1]]) | (row[w[1:]] != row[w[:-1]]) | (by[w[1:]] != by[w[:-1]])
        start = np.flatnonzero(new)
        if not len(start):
            return w, w, w
        bit = np.left_shift(1, place[w] - np.repeat(place[w[start]], np.diff(np.append(start, len(w)))))
        return w[start], np.add.reduceat(bit, start), np.add.reduceat(np.where(copied[w], bit, 0), start)

    s_at, s_mask, s_copied = rows_of(~later, anchor)
    g_at, g_mask, _ = rows_of(later, sender)
    kept = _packed(value, ~later)
    many = _BITS[s_mask & 0xFFFF] + _BITS[s_mask >> 16] if len(s_mask) else np.zeros(0, np.int64)
    offsets = np.concatenate([[0], np.cumsum(many) * 4, np.full(len(g_at), len(kept))]).astype(np.int32)
    hashes = pa.BinaryArray.from_buffers(pa.binary(), len(s_at) + len(g_at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    at_, none = np.concatenate([s_at, g_at]), np.zeros(len(g_at), np.int64)
    # what sends nothing on has no need to meet others: its document spreads it
    key = np.concatenate([held[s_at], doc[row[g_at]]])
    columns = [key, doc[row[at_]], place[at_].astype(np.int32), np.concatenate([s_mask, none]).astype(np.int32),
               np.concatenate([np.zeros(len(s_at), np.int64), g_mask]).astype(np.int32), np.concatenate([s_copied, none]).astype(np.int32),
               np.concatenate([np.zeros(len(s_at), np.int64), sender[g_at]])]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), hashes], ["key", "doc", "place", "sent", "gone", "copied", "ref", "hashes"])


def anchor_rows(docs: DataFrame, text: str, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        combiner = _Combiner()
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, SLICE_BYTES):
                doc = batch.column("doc").slice(a, b - a).to_numpy()
                order = np.argsort(doc, kind="stable")
                yield _anchor_rows(batch.column("text").slice(a, b - a).take(pa.array(order)), doc[order], combiner, window)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.filter(F.col("doc").isNotNull() & F.col("text").isNotNull()).mapInArrow(tidily(run), ANCHORS)


def _judge(rows: pa.Table, before: tuple) -> tuple[pa.RecordBatch, tuple]:
    """Windows of rows sorted by (key, doc, place), as (doc, place, mask, ref, held): held 1 where windows that recur
    stand as a reference, 0 where copies of windows of ``ref`` stand. ``before``: what was seen of the key that goes on."""
    key, doc, place, sent, gone, copied, ref = (rows.column(c).to_numpy() for c in ("key", "doc", "place", "sent", "gone", "copied", "ref"))
    value = np.frombuffer(b"".join(rows.column("hashes").to_pylist()), "<u4").astype(np.uint64)
    many = _BITS[sent & 0xFFFF] + _BITS[sent >> 16]
    row = np.repeat(np.arange(len(key)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    offset = _nth_bit(sent, row, nth)
    start = place[row].astype(np.int64) + offset
    d, k, twice = doc[row], key[row], (copied[row] >> offset) & 1 == 1
    if len(before[1]) and len(key) and key[0] == before[0]:
        n = len(before[1])
        value, k = np.concatenate([before[1], value]), np.concatenate([np.full(n, before[0]), k])
        d, start, twice = (np.concatenate([b, x]) for b, x in zip(before[2:], (d, start, twice), strict=True))
        row, offset = np.concatenate([np.full(n, -1), row]), np.concatenate([np.zeros(n, np.int64), offset])
    order = np.lexsort((value, k))  # stable: documents and places stay in order
    v, kk = value[order], k[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (kk[1:] != kk[:-1])
    group = np.cumsum(new) - 1
    head = order[new]  # first starts
    first = head[group]
    differs = (d[order] != d[first]) | (start[order] != start[first])
    recurs = np.zeros(len(head), bool)
    np.logical_or.at(recurs, group, differs)
    last = key[-1] if len(key) else 0
    recurs |= kk[new] == last  # a key that goes on in the next batch may find copies there
    basis = twice.copy()  # windows that a task has dropped copies of, and first starts
    basis[head[recurs]] = True

    def masks(which: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, mask, of) of windows, one for each row and value of ``of``."""
        which = which[np.lexsort((of[which], row[which]))]
        edge = np.ones(len(which), bool)
        edge[1:] = (row[which[1:]] != row[which[:-1]]) | (of[which[1:]] != of[which[:-1]])
        at = np.flatnonzero(edge)
        bits = np.add.reduceat(np.left_shift(1, offset[which]), at) if len(at) else at
        return row[which[at]], bits, of[which[at]]

    source = np.zeros(len(d), np.int64)
    source[order] = d[first]
    copies = masks(order[differs & (row[order] >= 0)], source)
    refs = masks(np.flatnonzero(basis & (row >= 0)), d)
    dropped = np.flatnonzero(gone)
    at = np.concatenate([copies[0], dropped, refs[0]])
    batch = pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(place[at]), pa.array(np.concatenate([copies[1], gone[dropped], refs[1]]).astype(np.int32)),
                                        pa.array(np.concatenate([copies[2], ref[dropped], refs[2]])), pa.array((np.arange(len(at)) >= len(at) - len(refs[0])).astype(np.int32))],
                                       ["doc", "place", "mask", "ref", "held"])
    on = new & (kk == last)
    goes = order[on]
    return batch, (last, v[on], d[goes], start[goes], twice[goes])


def _nth_bit(mask: np.ndarray, row: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Index of the nth set bit of each row's mask."""
    full = _BITS[mask & 0xFFFF] + _BITS[mask >> 16]
    out = nth.copy()
    holed = np.flatnonzero((mask + 1 != np.left_shift(1, full))[row])
    if len(holed):
        m, left, at = mask[row[holed]].astype(np.int64), nth[holed].copy(), np.zeros(len(holed), np.int64)
        open_ = np.ones(len(holed), bool)
        for b in range(32):
            here = open_ & ((m >> b) & 1 == 1)
            hit = here & (left == 0)
            at[hit] = b
            open_ &= ~hit
            left -= here
            if not open_.any():
                break
        out[holed] = at
    return out


def passages(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc, place, mask, ref, held): bit b set for the window at word ``place + b`` of ``doc``; held 1 where windows that
    recur stand as a reference (``ref`` is ``doc``), 0 where copies of windows of ``ref`` stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = (0, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
        for batch in batches:
            if batch.num_rows:
                out, before = _judge(pa.Table.from_batches([batch]), before)
                yield out

    rows = anchor_rows(docs, text, window).repartition("key").sortWithinPartitions("key", "doc", "place")
    return rows.mapInArrow(tidily(run), "doc long, place int, mask int, ref long, held int")


def _joined(runs: list[dict], window: int) -> Iterator[tuple[int, int, int, int]]:
    """(ref, held, first word, end) of the passages that the windows of one document make, joined where they touch."""
    last = None
    for ref, held, place, end in sorted((r["ref"], r["held"], r["place"], r["place"] + r["mask"].bit_length() - 1 + window) for r in runs):
        if last and last[:2] == (ref, held) and place <= last[3]:
            last = (ref, held, last[2], max(last[3], end))
        else:
            if last:
                yield last
            last = (ref, held, place, end)
    if last:
        yield last


def _words_of(docs: DataFrame, found: DataFrame, text: str, window: int) -> DataFrame:
    """(ref, held, doc, place, words): the passages of ``found``, from their documents' texts."""
    per = found.groupBy("doc").agg(F.collect_list(F.struct("ref", "held", "place", "mask")).alias("runs"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).cast("string").alias("text")).filter("text IS NOT NULL").join(per, "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = []
            for doc, t, runs in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words = _WORD.findall(t)
                out += [(ref, held, doc, a, " ".join(words[a:b])) for ref, held, a, b in _joined(runs, window)]
            columns = zip(*out, strict=True) if out else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["ref", "held", "doc", "place", "words"])

    return rows.select("doc", "text", "runs").mapInArrow(tidily(run), "ref long, held int, doc long, place int, words string")


def confirmed(docs: DataFrame, found: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc, place, n): the n consecutive windows of the copies in ``found`` that the automaton of their shard holds with an earlier start."""
    total = found.filter("held = 1").agg(F.sum(F.bit_count("mask"))).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    shard = F.pmod(F.xxhash64("ref"), F.lit(shards)).alias("shard")
    rows = _words_of(docs, found, text, window).withColumn("shard", shard)
    sizes = save(found.filter("held = 0").groupBy(shard).agg(F.ceil(F.sum(F.bit_count("mask")) / STREAMED).alias("parts")), "passage-shards")
    rows = rows.join(hinted(sizes, shards), "shard")
    mine = F.when(F.col("held") == 1, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "place"), F.col("parts"))))
    rows = rows.withColumn("part", F.explode(mine)).select("shard", "part", "doc", "place", "held", "words")

    def run(rows: pa.Table) -> pa.Table:
        held = rows.column("held").to_numpy()
        doc, place = (rows.column(c).to_numpy() for c in ("doc", "place"))
        words = rows.column("words").to_pylist()
        own = np.flatnonzero(held == 1)
        sam = SuffixAutomaton((((int(doc[i]), int(place[i])), words[i].split(" ")) for i in own[np.lexsort((place[own], doc[own]))]), window)
        out: list = []
        for i in np.flatnonzero(held == 0):
            d, a, run = int(doc[i]), int(place[i]), None
            for o, (other, base), there in sam.windows(words[i].split(" ")):
                if (other, base + there) < (d, a + o):
                    if run and run[1] + run[2] == a + o:
                        run[2] += 1
                    else:
                        out.append(run := [d, a + o, 1])
        columns = zip(*out, strict=True) if out else [[]] * 3
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["doc", "place", "n"])

    return rows.groupBy("shard", "part").applyInArrow(run, "doc long, place int, n int")


def cut(docs: DataFrame, found: DataFrame | None, text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words no removed window covers, joined by one space (null stays null)."""
    added = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType())]
    schema = with_schema(docs, added)
    names = [f.name for f in schema.fields[:-3]]
    rows = without(docs.withColumn("__text", F.col(text).cast("string")), *(n for n, _ in added))
    if found is None:
        rows = rows.withColumn("__gone", F.lit(None).cast("array<struct<place:int,n:int>>"))
    else:
        per = found.groupBy(F.col("doc").alias("__doc")).agg(F.collect_list(F.struct("place", "n")).alias("__gone"))
        rows = rows.join(per, F.col("doc_id").cast("long") == F.col("__doc"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = batch.column("__gone")
            total, away, kept = [], [], []
            for i, t in enumerate(batch.column("__text").to_pylist()):
                words = _WORD.findall(t) if t is not None else []
                total.append(len(words))
                if t is not None and gone[i].is_valid and words:
                    flat = gone[i].values
                    place, n = (flat.field(c).to_numpy().astype(np.int64) for c in (0, 1))
                    end = np.minimum(place + n - 1 + window, len(words))
                    inside = place + window <= len(words)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, place[inside], 1)
                    np.add.at(step, end[inside], -1)
                    left = np.flatnonzero(np.cumsum(step[:-1]) == 0)
                    away.append(len(words) - len(left))
                    words = [words[j] for j in left.tolist()]
                else:
                    away.append(0)
                kept.append(None if t is None else " ".join(words))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(total, pa.int64()), pa.array(away, pa.int64()), pa.array(kept, pa.string())],
                                             [*names, "n_words", "n_removed", "kept"])

    return rows.mapInArrow(tidily(run), schema)


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` with n_words, n_removed and kept. Texts are shuffled only for the documents that passages touch, as long
    as their ids can be broadcast (their number is checked), and for all beyond."""
    found = save(passages(docs, text, window), "passages")
    touched = save(found.select(F.col("doc").alias("__touched")).distinct(), "passage-docs")
    few = hinted(touched, n := touched.count(), BROADCAST_IDS)
    same = F.col("doc_id").cast("long") == F.col("__touched")
    gone = save(confirmed(docs.join(few, same, "left_semi"), found, text, window, shard_words), "passage-copies")
    if n > BROADCAST_IDS:
        return cut(docs, gone, text, window)
    rest = docs.join(few, same, "left_anti")
    return cut(docs.join(few, same, "left_semi"), gone, text, window).unionByName(cut(rest, None, text, window))


def _stream(docs: DataFrame, automaton, text: str, itself: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sam: SuffixAutomaton = automaton.value
        for batch in batches:
            doc, place = [], []
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for at, other, there in sam.windows(_WORD.findall(t)):
                    if not itself or (other, there) < (d, at):
                        doc.append(d)
                        place.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(np.ones(len(doc), np.int32))], ["doc", "place", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.filter(F.col("doc").isNotNull() & F.col("text").isNotNull()).mapInArrow(tidily(run), "doc long, place int, n int")


def remove_known(docs: DataFrame, reference: list[str], text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the words of windows that a text of ``reference`` (bounded: it is broadcast) holds."""
    sam = SuffixAutomaton(((i, _WORD.findall(t)) for i, t in enumerate(reference)), window)
    found = _stream(docs, docs.sparkSession.sparkContext.broadcast(sam), text, False)
    return cut(docs, found.distinct(), text, window)


def dedup_by_passes(docs: DataFrame, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """As ``dedup``, with every document passing the broadcast automaton of every shard of the corpus, one after the
    other: work grows with the square of the corpus."""
    spark = docs.sparkSession
    known = docs.filter(F.col("doc_id").isNotNull() & F.col(text).isNotNull())
    words = known.agg(F.sum(word_count(text))).first()[0] or 0
    shards = max(1, -(-words // shard_words))
    found = None
    for k in range(shards):
        part = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(shards)) == k).select(F.col("doc_id").cast("long").alias("d"), F.col(text).alias("t"))
        rows = sorted((r["d"], _WORD.findall(r["t"])) for r in part.distinct().collect())
        one = save(_stream(docs, spark.sparkContext.broadcast(SuffixAutomaton(rows, window)), text, True), "automaton")
        found = one if found is None else found.unionByName(one)
    return cut(docs, found.distinct(), text, window)
