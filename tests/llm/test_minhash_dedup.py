import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import components as cc
from ledgerline.llm import minhash_dedup as M
from ledgerline.llm import shingles as S
from ledgerline.llm.queries import QUERIES
from tests.conftest import SF_MID


def words_of(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles_of(text):
    w = words_of(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def test_hashed_words_split_like_the_pattern():
    r = random.Random(1)
    texts = [None, "", " ", "a", "  a\tb\n", "été\x0bx y", "日本 語"] + ["".join(r.choice("ab \n\t é") for _ in range(r.randint(0, 60))) for _ in range(300)]
    for cut in (0, 3):
        column = pa.array(texts, pa.string()).slice(cut)
        h, n, a, b = S.hashed_words(column)
        plain = [words_of(t) for t in texts[cut:]]
        assert n.tolist() == [len(p) for p in plain]
        raw = "".join(t or "" for t in texts[cut:]).encode()
        flat = [w for p in plain for w in p]
        assert [raw[x:y].decode() for x, y in zip(a, b, strict=True)] == flat
        assert len({(w, x) for w, x in zip(flat, h.tolist(), strict=True)}) == len(set(flat)) == len(set(h.tolist()))


def test_shingles_and_multisets():
    texts = ["a b c d e f", "a b", "", "x x x x x x x", None, "b a"]
    h, n = S.shingled(*S.hashed_words(pa.array(texts, pa.string()))[:2], 5)
    assert n.tolist() == [2, 1, 0, 3, 0, 1] and len(set(h.tolist())) == 5
    e, s = S.multiset(h, n)
    assert len(set(e.tolist())) == 7 and sorted(s.tolist()) == sorted(h.tolist())


def test_sampler_estimates_weighted_jaccard():
    rng = np.random.default_rng(8)
    levels = rng.integers(0, M.LEVELS, 1 << M.SLOT_BITS).astype(np.uint8)
    sampler = M.Sampler(levels)
    got, true = [], []
    for _ in range(60):
        x = rng.integers(0, 2**63, 300, dtype=np.int64).astype(np.uint64) * np.uint64(2)
        a, b = np.sort(x[:260]), np.sort(x[40:])
        drawn = sampler.draw(np.concatenate([a, b]), np.concatenate([a, b]), np.array([len(a), len(b)]))
        got.append((drawn[0] == drawn[1]).mean())
        w = M.weight(levels[M.slot(x)].astype(float))
        true.append(w[40:260].sum() / w.sum())
    assert abs(np.mean(got) - np.mean(true)) < 0.02


def brute(rows, similarity=0.8, linked=None):
    """Classes under plain or given pair similarity, every pair compared."""
    sets = [(i, shingles_of(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[k + 1:]:
            if a and b and linked(a, b) >= similarity:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def test_all_links_against_every_pair(spark, monkeypatch):
    """Weighted Jaccard of every pair, groups cut into small blocks, buckets taken whole: the same classes."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(4000)]
    rows = []
    for base in range(12):
        text = [r.choice(vocabulary) for _ in range(120)]
        for _ in range(1 + base * 3):
            copy = list(text)
            for _ in range(r.randint(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["one two", "one two", "one", "a b c d e", "a  b\nc d e", "x " * 40_000, "x " * 40_001])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    levels = M.levels_of(df)

    def linked(a, b):
        def weighted(c):
            column = pa.array([" ".join(s) for s in c], pa.string())
            h, _ = S.shingled(*S.hashed_words(column)[:2], 5)
            return {s: M.weight(float(levels[M.slot(h[k:k + 1])[0]])) for k, s in enumerate(c)}

        w = weighted(a | b)
        return sum(min(a[s], b[s]) * w[s] for s in w) / sum(max(a[s], b[s]) * w[s] for s in w)

    expected = brute(rows, linked=linked)
    for block, bucket in ((M.BLOCK, M.BUCKET), (8, 5)):
        monkeypatch.setattr(M, "BLOCK", block)
        monkeypatch.setattr(M, "BUCKET", bucket)
        got = {x["doc_id"]: x["class_id"] for x in M.near_duplicates(df).collect()}
        assert got == expected


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "same text here"), (5, "same text here"), (6, "same  text here"), (None, "same text here"), (None, None), (7, "u v w"), (7, "q r s")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, node int, class_id int")
    got = sorted(((x["doc_id"] or 0), x["class_id"], x["n_class"]) for x in M.near_duplicates(df).collect() if x["doc_id"] is not None)
    assert got == [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 3), (5, 5, 3), (6, 5, 3), (7, 7, 2), (7, 7, 2)]
    assert [x["class_id"] for x in M.near_duplicates(df.filter("doc_id IS NULL")).collect()] == [None, None]
    assert M.near_duplicates(df.limit(0)).count() == 0


def test_query_holds_clear_copies_together_and_others_apart(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op8_minhash_near_dedup"](spark, SF_MID).collect()}
    sets = {i: shingles_of(t) for i, t in rows}
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(i, j) for at in by.values() if len(at) < 60 for k, i in enumerate(at) for j in at[k + 1:]}
    for i, j in pairs:
        a, b = sets[i], sets[j]
        if sum((a & b).values()) >= 0.83 * sum((a | b).values()):
            assert found[i] == found[j]
    members = {}
    for i, c in found.items():
        members.setdefault(c, []).append(i)
    for c in (m for m in members.values() if len(m) > 1):
        for i in c:  # each has a near copy in its class
            assert max(sum((sets[i] & sets[j]).values()) / sum((sets[i] | sets[j]).values()) for j in c if j != i) > 0.75


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 230)] + [(5, 5)]
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    got = {x["node"]: x["root"] for x in cc.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    alone = {x for x in root if all(a == b for a, b in edges if x in (a, b))}
    assert got == {x: c for x, c in root.items() if x not in alone}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_levels_follow_each_shingle_s_own_document_frequency(spark, monkeypatch):
    """Several chunks and buckets: the levels are those of the exact frequencies."""
    monkeypatch.setattr(M, "CHUNK", 7)
    monkeypatch.setattr(M, "BUCKET_SHINGLES", 1000)
    monkeypatch.setattr(M, "HELD_SHINGLES", 3000)
    r = random.Random(4)
    passages = [" ".join(f"p{k}x{i}" for i in range(r.randint(5, 30))) for k in range(20)]
    texts = [" ".join([*(f"u{i}x{j}" for j in range(r.randint(0, 200))), *r.sample(passages[1:], r.randint(0, 4)), passages[0]]) for i in range(120)]
    texts += [texts[0], texts[0], None, "", "so few"]
    df = spark.createDataFrame([(i if i % 50 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    count = Counter(s for t in texts for s in shingles_of(t))
    n = len(texts)
    got = {x["doc_id"]: x["levels"] for x in M.signatures(df).filter("doc_id IS NOT NULL").collect()}
    assert len(got) == sum(i % 50 > 0 for i in range(n))
    for i, packed in got.items():
        own = shingles_of(texts[i])
        if not own:
            assert packed is None
            continue
        names = list(own)
        h = [int(S.shingled(*S.hashed_words(pa.array([" ".join(s)], pa.string()))[:2], 5)[0][0]) for s in names]
        expected = [int(M.level(np.array([count[s]]), n)[0]) for _, s in sorted(zip(h, names, strict=True))]
        assert list(zlib.decompress(packed)) == expected


@pytest.mark.parametrize(("size", "words", "changed"), [(2, 199, 17), (40, 193, 13)])
def test_pairs_near_the_threshold_do_not_depend_on_unrelated_documents(spark, size, words, changed):
    """Copies with one run of words changed, 0.8 to 0.84 alike without weights, beside nine million unrelated shingles:
    the weights of their own document frequencies keep them apart in a pair and in a large group."""
    rows = []
    for base in range(6 // size + size // 40):
        for k in range(size):
            copy = [f"b{base}w{i}" for i in range(words)]
            copy[60:60 + changed] = [f"c{base}x{k}x{i}" for i in range(changed)]
            rows.append((len(rows), " ".join(copy)))
    other = 66 - len(rows)
    count = Counter(s for _, t in rows for s in shingles_of(t))

    def linked(a, b):
        w = {s: M.weight(round(15 * np.log(67 / (1 + count[s])) / np.log(67))) for s in a | b}
        return sum(min(a[s], b[s]) * w[s] for s in w) / sum(max(a[s], b[s]) * w[s] for s in w)

    a, b = shingles_of(rows[0][1]), shingles_of(rows[1][1])
    assert 0.8 <= sum((a & b).values()) / sum((a | b).values()) < 0.84
    noise = spark.range(other).selectExpr("id + 1000 doc_id", f"array_join(transform(sequence(1, {9_000_000 // other}), i -> concat('n', id, 'x', i)), ' ') text")
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(noise)
    got = {x["doc_id"]: x["class_id"] for x in M.near_duplicates(df).collect()}
    assert {i: c for i, c in got.items() if i < 1000} == brute(rows, linked=linked) == {i: i for i, _ in rows}
    assert all(i == c for i, c in got.items())


def test_a_task_deals_its_shingles_out_in_bounded_memory(spark, monkeypatch):
    import tracemalloc

    held = 1 << 18
    monkeypatch.setattr(M, "HELD_SHINGLES", held)
    monkeypatch.setattr(M, "SLICE_BYTES", 100_000)  # so that what is held takes the most
    kept = []
    empty = spark.createDataFrame([], "chunk int, text string")
    monkeypatch.setattr(type(empty), "mapInArrow", lambda df, run, schema, *a: kept.append(run) or df.sparkSession.createDataFrame([], schema))
    M.shingle_levels(empty, 1200, 4)
    word = np.random.default_rng(1)
    batch = pa.record_batch({"chunk": pa.array(np.arange(1200) % 7, pa.int32()), "text": [" ".join(map(str, word.integers(0, 3000, 400))) for _ in range(1200)]})
    tracemalloc.start()
    try:
        assert sum(1 for _ in kept[0](iter([batch]))) == 2
        assert tracemalloc.get_traced_memory()[1] < 60 * held
    finally:
        tracemalloc.stop()
