import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import learned_partitions as A
from ledgerline.llm import pivot_topk as P
from ledgerline.llm.queries import QUERIES
from tests.conftest import SF_MID

NAN, INF = float("nan"), float("inf")
ODD = [(1000, None), (1001, [1.0, None]), (1002, [1.0, NAN]), (1003, [INF, 0.0]), (None, [1.0, 2.0])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")


def plain_topk(rows, k):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    asked = {}
    for i, v in good:
        if i % 100 == 0:
            asked[i] = min(v, asked.get(i, v))
    for q, v in asked.items():
        near = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def test_exact_topk_with_ties_repeats_lengths_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 64)
    monkeypatch.setattr(P, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(0, 700, 3)] + [(i, [0.5] * 6) for i in range(1, 200, 2)]
    rows += ODD + [(300, rows[0][1]), (3, rows[1][1]), (5000, []), (5100, []), (5200, [1.0]), (5300, [1e6] * 6), (5400, [-9e5] * 6)]
    got = sorted(tuple(r) for r in P.search(P.quantised(frame(spark, rows)), F.col("vec_id") % 100 == 0).collect())
    assert got == plain_topk(rows, 10)


def test_exact_topk_of_little(spark):
    assert P.search(P.quantised(frame(spark, [])), F.lit(True)).count() == 0
    assert P.search(P.quantised(frame(spark, [(0, [1.0])])), F.lit(True)).count() == 0
    assert [tuple(r) for r in P.search(P.quantised(frame(spark, [(0, [1.0]), (7, [0.0])])), F.col("vec_id") == 0).collect()] == [(0, 1, 7, 0)]


def test_bounds_save_evaluations():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    centres = rng.standard_normal((20, 8)) * 1000
    x = np.rint(centres[rng.integers(0, 20, 3000)] + rng.standard_normal((3000, 8)) * 20)
    d = np.stack([np.sqrt(((x - x[p]) ** 2).sum(axis=1)) for p in range(24)], axis=1)
    table = pa.table({"vec_id": np.arange(3000), "vec": list(x), "dists": list(d), "dim": np.full(3000, 8, np.int32)})
    seen = []
    scores, P._scores = P._scores, lambda a, b, c: seen.append(len(a)) or scores(a, b, c)
    try:
        out = P.eliminate(table.slice(0, 50), table, 10)
    finally:
        P._scores = scores
    best = np.sort(np.where(np.eye(50, 3000, dtype=bool), -np.inf, x[:50] @ x.T), axis=1)[:, -10:]
    assert sorted(out.column("score").to_pylist()) == sorted(best.ravel().astype(int).tolist())
    assert sum(seen) < 0.5 * 50 * 3000


def plain_nearest(x, ids, q, k):
    s = (x * x[ids == q][0]).sum(axis=1)
    at = np.lexsort((ids, -s))
    return [ids[i] for i in at if ids[i] != q][:k]


@pytest.mark.parametrize("sf_dir", [SF_MID])
def test_recall_of_learned_partitions(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    found = {}
    for r in QUERIES["op10_learned_partitions"](spark, sf_dir).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 20 == 0]
    assert set(found) == set(asked)
    hits = 0
    for q in asked:
        f = sorted(found[q])
        assert [r for r, _, _ in f] == list(range(1, 21)) and [(-s, i) for _, i, s in f] == sorted((-s, i) for _, i, s in f)
        assert all(s == (x[ids == i][0] * x[ids == q][0]).sum() for _, i, s in f)
        hits += len({i for _, i, _ in f} & set(plain_nearest(x, ids, q, 20)))
    assert hits / (20 * len(asked)) >= 0.9


def test_recall_grows_with_a_larger_index(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    out = A.search(frame(spark, rows), F.col("vec_id") % 60 == 0, sample=2048)
    x = x.astype(np.float32).astype(np.float64)
    ids, hits, n = np.arange(6000), 0, 0
    found = {}
    for r in out.collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q in range(0, 6000, 60):
        hits, n = hits + len(found[q] & set(plain_nearest(x, ids, q, 20))), n + 20
    assert hits / n >= 0.9


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(5)
    x = np.repeat(np.eye(8), 64, axis=0) + rng.standard_normal((512, 8)) * 0.05
    graph = A.neighbour_graph(x, 10)
    part = A.balanced_parts(graph, 8)
    assert set(np.bincount(part)) == {64}
    within = graph[part[:, None] == part[None, :]].sum() / graph.sum()
    assert within > 0.95


def test_few_ties_repeats_lengths_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 50)
    rows = [(i, [1.0, 0.0, 0.0]) for i in range(150)] + [(i, [0.0, float(i), 1.0]) for i in range(150, 300)]
    rows += [(i, v) for i, v in ODD if i is None or i > 0] + [(400, [0.0] * 3), (500, [1.0]), (520, [2.0]), (0, [1.0, 0.0, 0.0])]
    out = A.search(frame(spark, rows), F.col("vec_id") % 20 == 0)
    found = {}
    for r in out.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {*range(0, 300, 20), 500, 520}
    assert [i for _, i, _ in sorted(found[40])] == [0, 0, *range(1, 19)] and found[500] == [(1, 520, 2.0)]
    assert A.search(frame(spark, []), F.lit(True)).count() == 0
    assert A.search(frame(spark, [(0, [1.0])]), F.lit(True)).count() == 0
