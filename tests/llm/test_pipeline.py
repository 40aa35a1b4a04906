"""The pipeline against a plain version of every stage, each on what the stage before it kept."""

import hashlib

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline as P
from ledgerline.llm import language_id as L
from ledgerline.llm.common import save
from ledgerline.llm.queries import piece_model
from tests.conftest import SF_SMALL
from tests.llm.test_line_dedup import plain as plain_lines
from tests.llm.test_minhash_dedup import brute, words_of
from tests.llm.test_mixing import plain_targets


def plain_jaccard(a, b):
    return sum((a & b).values()) / sum((a | b).values())


def plain_pipeline(spark, rows):
    """(doc_id, text) of what reaches the tokeniser, repeats counted."""
    df = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in rows], "doc_id long, text string, lang string")
    model = L.train(df)
    scores = L.kernel(L.presence([r["text"] or "" for r in rows]), model.landmarks, model.roots) @ model.weights + model.bias
    rows = [r for r, s in zip(rows, scores, strict=True) if any(c.isalpha() for c in r["text"] or "") and np.clip(s.max(), 0, 1) >= P.MIN_SCORE]
    cut = {doc: text for doc, _, _, text in plain_lines([(r["doc_id"], r["text"], r["source"]) for r in rows])}
    rows = [(r["doc_id"], cut[r["doc_id"]], r["source"]) for r in rows]
    classes = brute([(i, t) for i, t, _ in rows], linked=plain_jaccard)
    rows = [r for r in rows if classes[r[0]] == r[0]]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    target = plain_targets(sizes)
    out = []
    for i, t, s in rows:
        rate = target[s] / sizes[s] if sizes[s] else 0
        u = int(hashlib.md5(f"mix-1:{i}".encode()).hexdigest()[:8], 16) / 2**32
        out += [(i, t)] * (int(rate) + (u < rate - int(rate)))
    return out


def test_whole_run_equals_plain_version(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    got = sorted((r["doc_id"], r["text"], np.frombuffer(bytes(r["token_ids"]), "<u4").tolist()) for r in P.run(spark, SF_SMALL).collect())
    expected = sorted((i, t, lib.encode(t, add_bos=True, add_eos=True)) for i, t in plain_pipeline(spark, rows))
    assert got == expected


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0), (None, "The heat of the thing and that", "en", "a", 5), (4, "7 8 9", "en", "b", 5),
            (5, "The and of the heat thing is it", "en", "a", 5), (5, "The and of the heat thing is it", "en", "a", 5), (6, "Der und die von nicht ein " * 9000, "de", None, 5),
            (7, "The and of  the heat thing is it", "en", "a", 5)]
    extra = ["score", "LANG_PRED", "n_lines", "size", "copies", "__text", "node", "token_ids", "n tokens.x"]
    docs = spark.createDataFrame(
        [(*r, *range(len(extra))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in extra))
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, "")
        if k < 4:
            assert out.columns == docs.columns
            docs = save(out, "test-stage")
            if k == 0:
                assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 5, 5, 6, 7]
            if k == 2:
                assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 5, 6]
        else:
            assert all(r["round_trip"] for r in out.select("round_trip").collect())
            assert out.columns[: len(docs.columns)] == docs.columns


@pytest.mark.parametrize("k", range(5))
def test_empty_table(spark, k):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    assert P.STAGES[k][1](spark, docs, "").count() == 0
