import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import mixing
from tests.conftest import SF_MID


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare the excess by weight until no source is above its cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: float(most * sizes[s]) for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_equal_the_loop(spark):
    r = random.Random(4)
    for _ in range(4):
        sizes = {s: r.choice([0, 1, 7, 100, 5000, 10**6]) for s in [*"zéaB😀"[: r.randint(1, 5)], "src10", "src9", None]}
        rows = [(s, n) for s, n in sizes.items()]
        got = {x["source"]: x["target"] for x in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        expected = plain_targets(sizes)
        assert got == pytest.approx(expected, abs=1e-6), sizes


def test_sizes_rates_and_copies(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(400)] + [(None, None, None), (7, "w " * 7, "b"), (900, "", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("size", "Target", "n", "weight")})
    mixed = mixing.mix(docs).collect()
    assert len(mixed) == len(rows)
    for r in mixed:
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 2 and r["size"] == (r["text"] or "").count("w")
    repeated = [r["copies"] for r in mixed if r["doc_id"] == 7]
    assert len(repeated) == 2 and len(set(repeated)) == 1
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixed))
    out = mixing.emit(mixing.mix(docs))
    assert out.count() == sum(r["copies"] for r in mixed) and out.columns == ["doc_id", "text", "source", "n", "weight"]
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in mixing.mix(nothing).collect()] == [(0.0, 0)] * 2


def test_taken_comes_near_the_target(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").withColumn("source", F.lit("one"))
    r = mixing.mix(docs).agg(F.sum("taken").alias("t"), F.first("target").alias("g")).first()
    assert abs(r["t"] / r["g"] - 1) < 0.1
