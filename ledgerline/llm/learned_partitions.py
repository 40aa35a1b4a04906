"""Approximate nearest neighbours by learned partitions.

On a bounded sample (``SAMPLE`` rows of smallest id hash) the inner-product neighbour graph is cut into equal parts by
recursive bisection: the second eigenvector of the graph splits at its median, and swaps across the cut that save edges
refine it. A small network learns, from each sample vector, the parts of its graph neighbours. It then files every row
of the table under its most probable part and sends every query to the most probable ``PROBE_SHARE`` of the parts, where inner
products in double precision rank all rows found.

Rows meet in blocks of at most ``BLOCK`` rows of a part (counted first), so a part that holds most rows is spread over
many tasks. Results: vectors that are null, zero or hold null or non-finite components, and rows without id, take no
part; a vector of a length other than the sample's most common one is compared with all of its length; a query whose
parts hold fewer than ``k`` rows besides its own probes on until they do, or all are probed; a query id that stands on
several rows is asked once, with its smallest vector; repeated candidate rows are each a candidate; ties go to the
smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import save, tidily

SAMPLE = 4096
PARTS = 64
PART_SAMPLE = 16  # sample rows a part at least
NEIGHBOURS = 16
PROBE_SHARE = 0.75  # of the parts
BLOCK = 8192
HIDDEN = 96
EPOCHS = 50


@dataclass
class Router:
    """Weights of the network, for vectors of one length."""

    dim: int
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return self.w2.shape[1]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def valid(vector: str, zero: bool = True) -> Column:
    """Neither null nor holding null or non-finite components; with ``zero`` also not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return good & F.exists(vector, lambda x: x != 0) if zero else good


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as doubles; all have length ``dim``."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Symmetric 0/1 matrix: each row linked with its k largest inner products."""
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    near = np.argpartition(-s, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(x), 0), int)
    a = np.zeros((len(x), len(x)), np.float32)
    np.put_along_axis(a, near, 1, axis=1)
    return np.maximum(a, a.T)


def bisect(a: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Halves of a graph: True for the second."""
    n = len(a)
    root = np.sqrt(a.sum(axis=1) + 1e-9)
    m = a / root[:, None] / root[None, :]
    v = rng.standard_normal(n).astype(np.float32)
    flat = root / np.linalg.norm(root)
    for _ in range(60):
        v = m @ v + v
        v -= flat * (flat @ v)
        v /= np.linalg.norm(v) + 1e-12
    side = np.zeros(n, bool)
    side[np.argsort(v / root, kind="stable")[(n + 1) // 2:]] = True
    for _ in range(20):  # swap the pairs that save most edges, as long as they do
        sign = np.where(side, 1, -1).astype(np.float32)
        gain = -sign * (a @ sign)
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        t = min(len(left), len(right), max(1, n // 50))
        swap = gain[left[:t]] + gain[right[:t]] > 2
        if not swap.any():
            break
        before, was = (sign @ a @ sign), side.copy()
        side[left[:t][swap]], side[right[:t][swap]] = True, False
        sign = np.where(side, 1, -1).astype(np.float32)
        if sign @ a @ sign <= before:
            side = was
            break
    return side


def balanced_parts(a: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """Part of each node; ``parts`` is a power of two and sizes differ by one a level at most."""
    rng = np.random.default_rng(seed)
    out = np.zeros(len(a), np.int64)
    while parts > 1:
        parts //= 2
        finer = 2 * out
        for p in np.unique(out):
            at = np.flatnonzero(out == p)
            finer[at] += bisect(a[np.ix_(at, at)], rng)
        out = finer
    return out


def fit(x: np.ndarray, parts: int = PARTS, neighbours: int = NEIGHBOURS, seed: int = 7) -> Router:
    """Partition the sample's neighbour graph and learn to route (Adam on the cross entropy, full batches)."""
    while parts > 1 and len(x) // parts < PART_SAMPLE:
        parts //= 2
    dim, rng = x.shape[1], np.random.default_rng(seed)
    graph = neighbour_graph(x, neighbours)
    label = balanced_parts(graph, parts, seed)
    target = (graph + np.eye(len(x), dtype=np.float32)) @ np.eye(parts, dtype=np.float32)[label]
    target /= target.sum(axis=1, keepdims=True)
    scale = 1 / (np.sqrt(np.mean(x * x)) + 1e-12)
    w = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / max(dim, 1)) * scale, np.zeros(HIDDEN),
         rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
    rate = [0.01 * scale, 0.01, 0.01, 0.01]
    m, v = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w]
    for step in range(1, EPOCHS + 1 if parts > 1 else 1):
        h = np.maximum(x @ w[0] + w[1], 0)
        z = h @ w[2] + w[3]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        d = (z / z.sum(axis=1, keepdims=True) - target) / len(x)
        dh = (d @ w[2].T) * (h > 0)
        for i, g in enumerate((x.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            w[i] = w[i] - rate[i] * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-12)
    return Router(dim, *w)


def fit_sample(rows: DataFrame, sample: int = SAMPLE, parts: int = PARTS) -> Router | None:
    """Router fitted on the rows of smallest id hash, at most ``sample``; None for an empty table."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").toArrow().column("vec").combine_chunks()
    lengths = np.diff(picked.offsets.to_numpy()) if len(picked) else np.zeros(0, int)
    if not len(lengths):
        return None
    dim = int(np.bincount(lengths).argmax())
    return fit(matrix(picked.filter(pa.array(lengths == dim)), dim), parts)


def _route(rows: DataFrame, shared, probes: int, counts: dict[int, int] | None = None, k: int = 0) -> DataFrame:
    """Add ``parts``: the ``probes`` most probable parts, and more until they hold over ``k`` rows; [-1] for other lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router: Router = shared.value
        for batch in batches:
            vec = batch.column("vec")
            fits = np.diff(vec.offsets.to_numpy()) == router.dim
            x = matrix(vec.filter(pa.array(fits)), router.dim)
            order = np.argsort(-router.scores(x), axis=1, kind="stable")
            need = np.full(len(x), probes)
            if counts is not None:
                held = np.cumsum(np.array([counts.get(p, 0) for p in range(router.parts)])[order], axis=1)
                need = np.maximum(need, (held <= k).sum(axis=1) + 1)
            found = iter([o[:n].tolist() for o, n in zip(order, need, strict=True)])
            parts = [next(found) if f else [-1] for f in fits]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.int32()))], [*batch.schema.names, "parts"])

    return rows.mapInArrow(tidily(run), "vec_id long, vec array<double>, parts array<int>")


def rerank(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The ``k`` rows of largest inner product for each query, without those of its own id."""
    dim = len(rows.column("vec")[0])
    q, x = (matrix(t.column("vec").combine_chunks(), dim) for t in (queries, rows))
    qid, xid = (t.column("vec_id").to_numpy() for t in (queries, rows))
    order = np.argsort(xid, kind="stable")
    x, xid = x[order], xid[order]
    far = 1e-12 * np.sqrt((x * x).sum(axis=1).max())  # matrix products may round equal rows differently
    out = []
    for a in range(0, len(q), 256):
        s = q[a:a + 256] @ x.T
        s[qid[a:a + 256, None] == xid[None, :]] = -np.inf
        edge = np.full(len(s), -np.inf) if len(xid) <= k else -np.partition(-s, k - 1, axis=1)[:, k - 1]
        for i, v in enumerate(q[a:a + 256]):
            near = np.flatnonzero((s[i] >= edge[i] - far * np.sqrt(v @ v)) & (s[i] > -np.inf))
            exact = (x[near] * v).sum(axis=1)
            best = np.argsort(-exact, kind="stable")[:k]
            out.append((np.full(len(best), qid[a + i]), xid[near[best]], exact[best]))
    ids, found, score = (np.concatenate(c) if out else np.zeros(0) for c in zip(*out, strict=True))
    return pa.table({"query_id": ids.astype(np.int64), "vec_id": found.astype(np.int64), "score": score.astype(np.float64)})


def search(rows: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", sample: int = SAMPLE, parts: int = PARTS,
           probe_share: float = PROBE_SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of all rows for the rows where ``is_query`` holds."""
    spark = rows.sparkSession
    good = rows.filter(F.col("vec_id").isNotNull() & valid(vector))
    vectors = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    queries = good.filter(is_query).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.col(vector).cast("array<double>")).alias("vec"))
    router = fit_sample(vectors, sample, parts)
    if router is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = spark.sparkContext.broadcast(router)
    index = save(_route(vectors, shared, 1).select("vec_id", "vec", F.col("parts")[0].alias("part"), F.size("vec").alias("dim")), "ann-index")
    sizes = index.groupBy("part").count().collect()  # one row a part
    counts = {r["part"]: r["count"] for r in sizes}
    blocks = F.create_map([F.lit(v) for r in sizes for v in (r["part"], -(-r["count"] // BLOCK))])
    asked = _route(queries, shared, max(1, int(np.ceil(probe_share * router.parts))), counts, k)
    asked = asked.select("vec_id", "vec", F.size("vec").alias("dim"), F.explode("parts").alias("part"))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(blocks[F.col("part")], F.lit(1)) - 1)))
    held = index.withColumn("block", F.pmod(F.monotonically_increasing_id(), blocks[F.col("part")]).cast("int"))
    pairs = asked.groupBy("dim", "part", "block").cogroup(held.groupBy("dim", "part", "block"))

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        return rerank(left, right, k)

    best = pairs.applyInArrow(found, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
