import functools
import random
import zlib

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import byte_bpe, token_files
from ledgerline.llm.queries import byte_vocabulary

ODD = ["", "a", " a", "  a", "a ", "a  b", "a  b", "a  b", "a\n b", "a \n b", "it's he'll I'd 'd x", "<|endoftext|>", "x<|endoftext|> y", "a <|endoftext|>b <|endof text|>",
       "é è ß x", "“q” r", "日本 語 テスト", "a　 b", "  a", "x \x85 y", "\x00 \x1f a", "🙂 🙂 a", "a\tb \t c", "1 2 33 4a", "...! ?? a", "ー a", "́ a ́", "A" * 5000, "w " * 9000, " " * 777 + "z"]


@functools.cache
def library():
    return Tokenizer.from_file(byte_vocabulary())


def plain(text):
    return library().encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    rng = random.Random(4)
    alphabet = ["a", "B", "zz", " ", " ", "  ", "\n", "\t", " ", " ", "é", "ñ", "ü", "語", "'s", "'ll", ".", ",", "!", "7", "12", "<|endoftext|>", "🙂", "\u0085", "́", "\r\n"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + [None]
    coder = byte_bpe.Encoder(byte_vocabulary())
    assert coder.by_chunk
    for column in (pa.array(texts, pa.string()), pa.array(texts[::-1], pa.large_string()), pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        ids, counts = coder.encode(column)
        expected = [plain(t) for t in column.to_pylist()]
        assert counts.tolist() == [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]


def test_few_known_chunks(monkeypatch):
    monkeypatch.setattr(byte_bpe, "KNOWN_CHUNKS", 3)
    coder = byte_bpe.Encoder(byte_vocabulary())
    for t in ["one two three four", "five six two", "one seven"]:
        assert coder.encode(pa.array([t]))[0].tolist() == plain(t)


def by_hand(rows):
    """(doc_id, ids) in the order of the files up to rows of one id."""
    return [(d, [*plain(t), token_files.END]) for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


@pytest.mark.parametrize(("length", "file_tokens"), [(16, 100), (2048, 1 << 27), (7, 1)])
def test_files_read_back(spark, tmp_path, length, file_tokens):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, "again"), (3, None), (500, None)] + [(7000, "same text")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("tie", "row", "ids", "start")}).repartition(5)
    folder = str(tmp_path / "out")
    (tmp_path / "out").mkdir()
    files = token_files.write(df, byte_vocabulary(), folder, length=length, file_tokens=file_tokens).collect()
    got = sorted((r.asDict() for r in token_files.read(spark, folder).collect()), key=lambda r: r["start"])
    assert sorted(map(repr, ((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got))) == sorted(map(repr, by_hand(rows)))
    order = [r["doc_id"] for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    starts = np.cumsum([0] + [r["n_tokens"] for r in got])
    assert [r["start"] for r in got] == starts[:-1].tolist() and sum(f["n_tokens"] for f in files) == starts[-1]
    # sequences of the files, padding masked, make the same stream; ids are views of the mapped file
    stream = []
    for f in sorted(files, key=lambda f: f["start"]):
        t = token_files.TokenFile(folder, f["stem"])
        assert len(stream) == f["start"]
        for i in range(f["n_sequences"]):
            ids, mask = t.sequence(i)
            assert len(ids) == len(mask) == length and not ids.flags.owndata
            stream += ids[mask].tolist()
    assert stream == [i for r in got for i in np.frombuffer(r["ids"], "<u4").tolist()]


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write(df, byte_vocabulary(), str(tmp_path)).count() == 0
    assert token_files.read(spark, str(tmp_path)).count() == 0


def test_query_equals_the_library(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL

    got = {r["doc_id"]: r for r in E.queries()["op12_token_files"](spark, SF_SMALL).collect()}
    start = 0
    for r in sorted(spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*plain(r["text"]), 0], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
