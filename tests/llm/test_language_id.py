import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from ledgerline.llm import language_id as L
from ledgerline.llm.queries import QUERIES
from tests.conftest import SF_MID


def test_presence_equals_sets_of_grams():
    def slots(text):
        out, low = set(), text.lower()
        for n in L.SIZES:
            for i in range(len(low) - n + 1):
                h = 0
                for c in low[i:i + n]:
                    h = (h * 0x01000193 & 0xFFFFFFFF) ^ ord(c)
                m = (h * 0x9E3779B1 + (0x85EBCA6B * n & 0xFFFFFFFF)) & 0xFFFFFFFF
                out.add((m ^ (m >> 15)) & (L.SLOTS - 1))
        return out

    texts = ["Été à l'école", "", "a", "ab" * 50, "日本語 text"]
    assert [set(np.flatnonzero(r)) for r in L.presence(texts)] == [slots(t) for t in texts]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = QUERIES["op3_language_id"](spark, SF_MID).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_only_text_is_looked_at_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    model = L.train(docs)
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 !?\n", "fr"), (4, "The and of the heat thing.", "de"), (4, "The and of the heat thing.", "de"), (None, "der die und " * 20_000, None)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, Lang_Pred string, score double")
    out = L.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = sorted(((r["doc_id"] or 0), r["lang_pred"], r["score"]) for r in out.collect())
    assert [x[1] for x in got] == ["de", "und", "und", "und", "en", "en"] and [x[2] for x in got[1:4]] == [0.0] * 3
    other = L.predict(df.withColumns({"lang": F.lit("es"), "doc_id": F.lit(9)}), model)
    assert sorted(r["score"] for r in other.collect()) == sorted(x[2] for x in got)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en"), (None, "text", "en")], "doc_id long, text string, lang string")
    assert L.train(df) is None
    assert {r["lang_pred"] for r in L.predict(df, None).collect()} == {"und"}
    assert L.predict(df.limit(0), None).count() == 0


def test_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"word{i} some text", "en") for i in range(300)], "doc_id long, text string, lang string")
    model = L.train(df, per_lang=10, landmarks=4)
    assert model.langs == ["en"] and model.landmarks.shape == (L.SLOTS, 4)


@pytest.mark.parametrize("n", [2, 4, 8])
def test_junk_goes_and_clean_texts_of_any_length_stay(spark, n):
    """Each language has syllables of its own letters or order; junk has letters of all, in no language's order."""
    r = random.Random(n)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tongues = [["".join(r.sample(letters, 3)) for _ in range(25)] for _ in range(n)]

    def prose(k, words):
        return " ".join("".join(r.choice(tongues[k]) for _ in range(r.randint(1, 2))) for _ in range(words))

    def junk(words):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(3, 8))) for _ in range(words))

    rows = [(k * 1000 + i, prose(k, 80), f"l{k}") for k in range(n) for i in range(40)]
    clean = [(20_000 + 10 * k + i, prose(k, words), None) for k in range(n) for i, words in enumerate((1, 2, 3, 10, 100, 60_000))]
    noise = [(30_000 + i, junk(words), None) for i, words in enumerate((20, 50, 300, 20_000))]
    docs = spark.createDataFrame(rows + clean + noise, "doc_id long, text string, lang string")
    stayed = {x["doc_id"] for x in P.identify(spark, docs, "").collect()}
    assert not stayed & {x[0] for x in noise}
    assert stayed == {x[0] for x in rows + clean}
