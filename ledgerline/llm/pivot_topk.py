"""Exact top-k inner products by pivot-table elimination.

Each row carries its distances to ``PIVOTS`` pivot rows (those of smallest id hash). For a query q and a row x the
largest |d(q, p) - d(x, p)| over the pivots is a lower bound b of their distance, so (|q|^2 + |x|^2 - b^2) / 2 is an
upper bound of their inner product. Rows are evaluated in the order of that bound, in growing chunks, until the k-th
best score is above the next bound.

Rows meet in blocks (``BLOCK`` rows by ``QUERY_BLOCK`` queries); each block pair gives its own k best and a second step
ranks those. Vectors hold integers in doubles: scores use matrix products while every sum stays below 2**53, and
Python integers beyond. Results: vectors that are null or hold null or non-finite components, and rows without id,
take no part; vectors of different lengths are never compared; an empty vector scores 0 with its like; a query id that
stands on several rows is asked once, with its smallest vector; repeated candidate rows are each a candidate; ties go to
the smaller id; an empty table gives an empty result; scores beyond 64 bits are
reported as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerline.llm.common import save, tidily
from ledgerline.llm.learned_partitions import matrix, valid

PIVOTS = 24
BLOCK = 4096
QUERY_BLOCK = 1024
FIRST_CHUNK = 64
SCHEMA = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of every component, as whole doubles, of the rows that take part."""
    good = rows.filter(F.col("vec_id").isNotNull() & valid(vector, zero=False))
    whole = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("vec"))


def with_pivots(rows: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """Add ``dists`` (to the pivots of the vector's length) and ``dim``. At most ``pivots`` rows pass the driver."""
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(pivots).select("vec").collect()
    table: dict[int, list] = {}
    for r in picked:
        table.setdefault(len(r["vec"]), []).append(r["vec"])
    shared = rows.sparkSession.sparkContext.broadcast({d: np.array(v, np.float64).reshape(len(v), d) for d, v in table.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vec")
            dims = np.diff(vec.offsets.to_numpy())
            dists: list = [[]] * len(dims)
            for d in np.unique(dims):
                if (p := shared.value.get(int(d))) is not None:
                    at = np.flatnonzero(dims == d)
                    x = matrix(vec.take(pa.array(at)), int(d))
                    far = np.stack([np.sqrt(((x - v) ** 2).sum(axis=1)) for v in p], axis=1)
                    for i, row in zip(at.tolist(), far.tolist(), strict=True):
                        dists[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), vec, pa.array(dists, pa.list_(pa.float64())), pa.array(dims.astype(np.int32))],
                                             ["vec_id", "vec", "dists", "dim"])

    return rows.select("vec_id", "vec").mapInArrow(tidily(run), "vec_id long, vec array<double>, dists array<double>, dim int")


def _scores(x: np.ndarray, q: np.ndarray, wide: bool) -> np.ndarray:
    if not wide:
        return x @ q
    return np.array([sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x], object)


def eliminate(queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a block for each query, rows of its own id excluded."""
    dim = rows.column("dim")[0].as_py()
    q, x = (matrix(t.column("vec").combine_chunks(), dim) for t in (queries, rows))
    pivots = len(rows.column("dists")[0])
    dq, dx = (matrix(t.column("dists").combine_chunks(), pivots) for t in (queries, rows))
    qid, xid = queries.column("vec_id").to_numpy(), rows.column("vec_id").to_numpy()
    most = [float(np.abs(m).max()) if m.size else 0.0 for m in (q, x)]
    wide = most[0] * most[1] * max(dim, 1) >= 2.0**53
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    out_q, out_x, out_s = [], [], []
    for i in range(len(q)):
        low = np.zeros(len(x))
        for p in range(pivots):
            np.maximum(low, np.abs(dx[:, p] - dq[i, p]), out=low)
        bound = (qq[i] + xx - low * low) / 2
        bound += 1e-9 * (qq[i] + xx) + 1e-6  # rounding of distances and squares
        bound[xid == qid[i]] = -np.inf
        order = np.argsort(-bound)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, object if wide else np.float64)
        a, step = 0, max(FIRST_CHUNK, k)
        while a < len(order) and bound[order[a]] > -np.inf and (len(ids) < k or bound[order[a]] >= float(scores[-1])):
            near = order[a:a + step]
            near = near[bound[near] > -np.inf]
            ids, scores = np.concatenate([ids, xid[near]]), np.concatenate([scores, _scores(x[near], q[i], wide)])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            a, step = a + step, step * 2
        out_q.append(np.full(len(ids), qid[i]))
        out_x.append(ids)
        out_s.append(np.array([min(max(int(s), -(2**63)), 2**63 - 1) for s in scores], np.int64))
    return pa.table({"query_id": np.concatenate(out_q).astype(np.int64), "vec_id": np.concatenate(out_x).astype(np.int64), "score": np.concatenate(out_s).astype(np.int64)})


def search(rows: DataFrame, is_query: Column, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of all rows of (vec_id, vec) for those where ``is_query`` holds."""
    index = save(with_pivots(rows, pivots), "pivot-index")
    blocks = max(1, -(-index.count() // BLOCK))
    asked = index.filter(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "vec", "dists")).alias("v")).select("vec_id", "v.*")
    query_blocks = max(1, -(-asked.select("vec_id").count() // QUERY_BLOCK))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = index.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    held = held.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).withColumn("query_block", F.col("query_block").cast("long"))
    keys = ("dim", "query_block", "block")

    def found(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        return eliminate(left, right, k)

    best = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(found, SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
