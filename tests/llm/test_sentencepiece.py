import random

import numpy as np
import pytest
import sentencepiece

from ledgerline.llm import sentencepiece_codec as C
from ledgerline.llm.queries import QUERIES, piece_model
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def lib():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


@pytest.fixture(scope="module")
def coder():
    model = C.load_model(piece_model())
    return C.Encoder(model), C.Decoder(model)


def same(lib, coder, text):
    packed = coder[0].encode([text], True, True)[0]
    assert np.frombuffer(packed, "<u4").tolist() == lib.encode(text, add_bos=True, add_eos=True), text[:80]
    assert coder[1].decode(packed) == lib.decode(lib.encode(text)), text[:80]


def test_random_texts_equal_the_library(lib, coder):
    r = random.Random(5)
    parts = ["a", "e", "th", " ", "  ", "\n", "\t", "▁", "é", "ʘ", "日", "本", "\0", "😀", "<s>", "</s>", "<0x0A>", "==", "--", "1", "ing", "aaaa", "\r", "the"]
    for _ in range(1500):
        same(lib, coder, "".join(r.choice(parts) for _ in range(r.randint(0, 40))))
    for _ in range(60):
        same(lib, coder, "".join(chr(r.choice([r.randint(32, 126), r.randint(0x4E00, 0x9FFF), r.randint(0x400, 0x4FF)])) for _ in range(300)))


@pytest.mark.parametrize("text", ["", " ", "\n", "x" + " " * 300 + "y", "a" * 5000, "the" * 3000, "ab " * 60000, "é" * 999, "=" * 400])
def test_edges_equal_the_library(lib, coder, text):
    same(lib, coder, text)


def test_decoding_any_ids_equals_the_library(lib, coder):
    r = random.Random(2)
    for _ in range(1500):
        ids = [r.choice([r.randrange(32000), r.randint(3, 258), 0, 1, 2]) for _ in range(r.randint(0, 10))]
        assert coder[1].decode(np.array(ids, "<u4").tobytes()) == lib.decode(ids), ids


def test_word_table_is_bounded(coder, monkeypatch):
    monkeypatch.setattr(C, "TABLE_WORDS", 3)
    encoder = C.Encoder(C.load_model(piece_model()))
    first = encoder.encode(["a b c d e f"], True, True)
    assert encoder.encode(["x y z"], True, True) and encoder.encode(["a b c d e f"], True, True) == first


def test_frame_with_nulls_repeats_and_clashing_columns(spark, lib):
    df = spark.createDataFrame([(1, None, "i"), (1, "", "i"), (2, "Hello world", None), (2, "Hello world", None)], "doc_id int, text string, IDS string")
    out = C.decode(C.encode(df, piece_model()), piece_model())
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted((r["doc_id"], r["text"] or "", np.frombuffer(bytes(r["ids"]), "<u4").tolist(), r["decoded"]) for r in out.collect())
    hello = lib.encode("Hello world", add_bos=True, add_eos=True)
    assert got == [(1, "", [1, 2], "")] * 2 + [(2, "Hello world", hello, "Hello world")] * 2
    assert C.encode(df.limit(0), piece_model()).count() == 0
    assert C.decode(spark.createDataFrame([(None,)], "ids binary"), piece_model()).first()["decoded"] is None


def test_query_over_all_documents(spark, lib):
    import hashlib

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    rows = QUERIES["op1_sentencepiece"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = lib.encode(docs[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_other_model_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError):
        C.load_model(str(tmp_path / "m"))
