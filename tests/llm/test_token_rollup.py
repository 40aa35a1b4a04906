import random
import uuid
from collections import Counter

import pytest
import sentencepiece

from ledgerline.llm.common import scratch
from ledgerline.llm.queries import QUERIES, piece_model
from ledgerline.llm.token_rollup import TokenRollup
from tests.conftest import SF_SMALL

SCHEMA = "kind string, source string, lang string, tokenizer string, n_tokens long, old_source string, old_lang string, old_tokenizer string, old_tokens long, n_docs string"


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}


def test_random_batches_equal_plain_sums(spark):
    r, rollup = random.Random(6), TokenRollup(spark, scratch(spark, "t"))
    docs, state, plain = {}, 0, {}
    for batch in range(4):
        rows = []
        for _ in range(40):
            key = (r.choice("ab") if r.random() > 0.1 else None, r.choice(["en", None]), "v1")
            if docs and r.random() < 0.3:
                old = docs.pop(i := r.choice(list(docs)))
                if r.random() < 0.5:
                    rows.append(("delete", *old[0], old[1], None, None, None, None, "x"))
                    continue
                docs[i] = (key, r.randint(0, 9))
                rows.append(("revise", *key, docs[i][1], *old[0], old[1], "x"))
            else:
                docs[state] = (key, r.choice([None, 0, 5]))
                docs[state] = (key, docs[state][1] or 0)
                rows.append(("insert", *key, docs[state][1] or None, None, None, None, None, "x"))
                state += 1
        changes = spark.createDataFrame(rows, SCHEMA)
        assert rollup.commit(f"b{batch}", changes) and not rollup.commit(f"b{batch}", changes)
        if batch == 1:
            rollup.compact()
            assert not rollup.commit("b0", changes)
        plain = {}
        for key, n in docs.values():
            d, t = plain.get(key, (0, 0))
            plain[key] = (d + 1, t + n)
        assert totals(rollup) == plain
    rollup.compact()
    assert totals(rollup) == plain and rollup.committed() == {f"b{i}" for i in range(4)}


def test_failed_attempts_empty_batches_and_bad_input(spark):
    path = scratch(spark, "t")
    rollup = TokenRollup(spark, path)
    assert totals(rollup) == {} and rollup.committed() == set()
    rows = spark.createDataFrame([("insert", "a", "en", "v", 3)] * 2, "kind string, source string, lang string, tokenizer string, n_tokens long")
    rollup.deltas(rows).write.parquet(f"{path}/batches/b1/0")
    fs, marker = rollup._fs(f"{path}/batches/b1/0/_SUCCESS")
    fs.delete(marker, False)  # as an attempt that was lost leaves it
    assert totals(rollup) == {}
    assert rollup.commit("b1", rows) and totals(rollup) == {("a", "en", "v"): (2, 6)}
    assert rollup.commit("empty", rows.limit(0)) and totals(rollup) == {("a", "en", "v"): (2, 6)}
    with pytest.raises(Exception, match="unknown kind"):
        rollup.commit(uuid.uuid4().hex, rows.replace("insert", "upsert"))
    with pytest.raises(ValueError):
        rollup.commit("../x", rows)
    assert rollup.commit("undo", rows.replace("insert", "delete")) and totals(rollup) == {}


def test_commit_during_a_compaction_counts_once(spark, monkeypatch):
    """A batch that lands between the listing and the sum of a compaction isn't folded into it."""
    rollup = TokenRollup(spark, scratch(spark, "t"))
    rows = spark.createDataFrame([("insert", "a", "en", "v", 3)], "kind string, source string, lang string, tokenizer string, n_tokens long")
    assert rollup.commit("one", rows)
    real, late = TokenRollup._sum, []

    def interleaved(self, state):
        if not late:
            late.append(1)
            assert TokenRollup(spark, rollup.path).commit("two", rows)
        return real(self, state)

    monkeypatch.setattr(TokenRollup, "_sum", interleaved)
    rollup.compact()
    monkeypatch.undo()
    assert totals(rollup) == {("a", "en", "v"): (2, 6)} and rollup.committed() == {"one", "two"}
    rollup.compact()
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v"): (2, 6)} and rollup._batches() == {} and not rollup.commit("one", rows)


def test_two_writers_of_one_id_count_once(spark):
    rollup = TokenRollup(spark, scratch(spark, "t"))
    rows = spark.createDataFrame([("insert", "a", "en", "v", 3)], "kind string, source string, lang string, tokenizer string, n_tokens long")
    for attempt in ("x", "y"):  # both wrote before either saw the other
        rollup.deltas(rows).write.parquet(f"{rollup.path}/batches/b/{attempt}")
    assert totals(rollup) == {("a", "en", "v"): (1, 3)} and not rollup.commit("b", rows)
    rollup.compact()
    assert totals(rollup) == {("a", "en", "v"): (1, 3)}


def test_query_equals_plain_counts(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    docs, tokens, seen = Counter(), Counter(), set()
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect():
        if r["text"] not in seen:
            seen.add(r["text"])
            for version, n in (("words-1", len(r["text"].split())), ("piece_bpe_32k", len(lib.encode(r["text"])) + 2)):
                docs[r["source"], r["lang"], version] += 1
                tokens[r["source"], r["lang"], version] += n
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in QUERIES["op5_token_counts"](spark, SF_SMALL).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}
