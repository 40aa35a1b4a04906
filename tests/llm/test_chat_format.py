import hashlib
import random

import pyarrow as pa

from ledgerline.llm import chat_format as C
from ledgerline.llm.queries import QUERIES
from tests.conftest import SF_SMALL

PARTS = ["<", "s>", "</s>", "[INST]", "[/INST]", "\\", "[", "/", "\n", "n", "é", "😀", "a", "INST]", "<s>"]


def test_batches_cut_anywhere_read_back():
    r = random.Random(3)
    for _ in range(600):
        n = r.randint(1, 12)
        ids = sorted((r.choice([None, 1, 2, 3]) for _ in range(n)), key=lambda x: x or 0)
        roles = [r.choice(["user", "assistant", None, "".join(r.choice(PARTS) for _ in range(4))]) for _ in range(n)]
        texts = [r.choice([None, "".join(r.choice(PARTS) for _ in range(r.randint(0, 9)))]) for _ in range(n)]
        batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roles, pa.string()), pa.array(texts, pa.string())], ["conv_id", "role", "text"])
        cut = r.randint(0, n)
        out = [x for b in C._run(iter([batch.slice(0, cut), batch.slice(cut)])) for x in b.to_pylist()]
        expected: dict = {}
        for i, role, text in zip(ids, roles, texts, strict=True):
            expected.setdefault(i, []).append((role or "", text or ""))
        assert [o["conv_id"] for o in out] == list(expected)
        for o in out:
            f = o["formatted"]
            turns = [(C._role_in(m[1]), C.unescaped(m[2])) for m in C._TURN.finditer(f)]
            assert turns == expected[o["conv_id"]] and o["n_turns"] == len(turns)
            assert "".join(m[0] for m in C._TURN.finditer(f)) == f
            assert [C.unescaped(f[a:b]) for a, b in zip(o["loss_starts"], o["loss_ends"], strict=True)] == [t for x, t in turns if x == "assistant"]


def test_order_repeats_long_texts_and_extra_columns(spark):
    rows = [(1, 1, "assistant", "b" * 300_000, 0), (1, 0, "user", "x", 0), (1, 0, "user", "x", 0), (None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, n_turns int")
    out = {r["conv_id"]: r for r in C.read_chats(C.format_chats(df)).collect()}
    assert [t["text"][:1] for t in out[1]["turns"]] == ["x", "x", "b"] and out[1]["loss_text"] == "b" * 300_000
    assert [tuple(t) for t in out[None]["turns"]] == [("", "")] and out[None]["loss_text"] == ""
    assert C.read_chats(C.format_chats(df.limit(0))).count() == 0


def test_query_equals_plain_version(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in QUERIES["op9_chat_format"](spark, SF_SMALL).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in sorted(x for x in rows if x[0] == conv)]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] > sum(len(b) for _, b in turns)
