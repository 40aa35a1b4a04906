import hashlib
import random
import re

import pytest

from ledgerline.llm import substring_dedup as D
from ledgerline.llm.queries import QUERIES
from tests.conftest import SF_MID


def plain(rows, window):
    """Kept words by document, windows compared as strings in the order of ids."""
    seen, out = {}, {}
    for doc, text in sorted(((i, t) for i, t in rows if i is not None), key=lambda x: x[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if seen.setdefault(tuple(w[i:i + window]), (doc, i)) < (doc, i):
                gone |= set(range(i, i + window))
        out[doc] = (len(w), len(gone), None if text is None else " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize(("window", "letters", "slice_bytes", "seen"), [(20, 2, 3000, 500_000), (20, 40, 10**6, 500_000), (8, 3, 2000, 5), (20, 1, 4000, 500_000)])
def test_random_repeats(spark, monkeypatch, window, letters, slice_bytes, seen):
    monkeypatch.setattr(D, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(D, "SEEN", seen)
    monkeypatch.setattr(D, "STREAMED", 300)
    monkeypatch.setattr(D, "BROADCAST_IDS", 500_000 if letters > 2 else 3)
    r = random.Random(window * letters)
    pool = [" ".join(f"w{r.randrange(letters)}" for _ in range(r.randint(1, 90))) for _ in range(25)]
    rows = [(i, r.choice([" ", "\n", "\t \n"]).join(r.choice(pool) for _ in range(r.randint(0, 5)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n"), (503, "a " * 30_000), (504, "b c " * 500), (505, "b c " * 501)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, doc int, KEPT int").repartition(5)
    out = D.dedup(df, window=window, shard_words=3000)
    assert out.columns == ["doc_id", "text", "doc", "n_words", "n_removed", "kept"]
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in out.collect()} == plain(rows, window)


def test_repeated_ids_and_missing_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted(((x["doc_id"] or 0), x["n_removed"]) for x in D.dedup(df).collect())
    assert got == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 30)]
    assert D.dedup(df.limit(0)).count() == 0


def test_query_over_all_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()]
    expected = {i: (n, gone, hashlib.sha256((kept or "").encode()).hexdigest()) for i, (n, gone, kept) in plain(rows, 20).items()}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in QUERIES["op6_substring_dedup"](spark, SF_MID).collect()} == expected


@pytest.mark.parametrize(("window", "letters", "shard"), [(20, 2, 10**6), (20, 30, 900), (6, 3, 500)])
def test_suffix_automata_remove_the_same(spark, window, letters, shard):
    r = random.Random(letters)
    pool = [" ".join(f"w{r.randrange(letters)}" for _ in range(r.randint(1, 60))) for _ in range(12)]
    rows = [(i, r.choice([" ", "\n"]).join(r.choice(pool) for _ in range(r.randint(0, 4)))) for i in range(50)] + [(90, None), (91, ""), (None, pool[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept"]) for x in D.dedup_by_passes(df, window=window, shard_words=shard).collect() if x["doc_id"] is not None}
    assert got == plain(rows, window)
    assert D.dedup_by_passes(df.limit(0)).count() == 0


def test_known_passages_go(spark):
    known = " ".join(f"k{i}" for i in range(25))
    rows = [(1, f"a b {known} c"), (2, " ".join(known.split()[:19])), (3, None), (4, known + " " + known)]
    out = {x["doc_id"]: x["kept"] for x in D.remove_known(spark.createDataFrame(rows, "doc_id long, text string"), [known, "x"]).collect()}
    assert out == {1: "a b c", 2: rows[1][1], 3: None, 4: ""}
