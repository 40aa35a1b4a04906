"""Shipment isolation forest (A2), after Liu, Ting & Zhou (2008), for every tenant at once.

* Fit: every (tenant, tree) takes the 256 rows of smallest hash(row key, tree), so the sample doesn't depend on how
  the rows are laid out. A row is offered only to the trees for which its hash is small enough to be among them (a bound
  from the tenant's row count), then the smallest are kept per (tenant, tree); each tree is grown from its own group.
* Score: the forests are a table. Each tenant's rows are dealt into buckets of about ``BUCKET_ROWS`` and meet their
  forest there, so a large tenant is many tasks and nothing passes through the driver. Rows go down a tree in chunks that
  stay in a core's cache, all of them one level at a time. The scored rows are kept in the shared folder, as they are read
  twice.
* Threshold: the exact percentile of each tenant's scores, linearly interpolated between neighbouring ranks, which
  distributed prefix sums over the distinct scores find.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.functions.metrics import prefix_sums
from ledgerline.session import new_folder

N_TREES = 100
MAX_SAMPLES = 256
CONTAMINATION = 0.05
MIN_ROWS = 15
OFFERED = 420        # rows offered to a tree on average; fewer than 256 has a chance under 1e-12
BUCKET_ROWS = 50_000
CHUNK_ROWS = 8_192   # rows that go down the trees together
SEED = 42
FEATURES = ("distance_km", "weight_kg", "quantity")
EULER = 0.5772156649015329

TREE_SCHEMA = T.StructType([
    T.StructField("company_id", T.IntegerType()),
    T.StructField("tree", T.IntegerType()),
    T.StructField("psi", T.IntegerType()),
    T.StructField("feature", T.ArrayType(T.IntegerType())),
    T.StructField("threshold", T.ArrayType(T.DoubleType())),
    T.StructField("left", T.ArrayType(T.IntegerType())),
    T.StructField("right", T.ArrayType(T.IntegerType())),
    T.StructField("leaf_value", T.ArrayType(T.DoubleType())),
])


def c_factor(n):
    """Average path length of an unsuccessful BST search among n points."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Arrays of one isolation tree; ``leaf_value`` = depth + c(leaf size) at leaves."""
    feat, thr, left, right, leaf = [], [], [], [], []

    def node(idx, depth):
        i = len(feat)
        feat.append(-1), thr.append(0.0), left.append(-1), right.append(-1), leaf.append(0.0)
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            leaf[i] = depth + float(c_factor([len(idx)])[0])
            return i
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            leaf[i] = depth + float(c_factor([len(idx)])[0])
            return i
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        feat[i], thr[i] = f, t
        go_left = sub[:, f] < t
        left[i] = node(idx[go_left], depth + 1)
        right[i] = node(idx[~go_left], depth + 1)
        return i

    node(np.arange(len(x)), 0)
    return feat, thr, left, right, leaf


def _fit_tree(pdf: pd.DataFrame) -> pd.DataFrame:
    cid, tree = int(pdf["company_id"].iloc[0]), int(pdf["tree"].iloc[0])
    x = pdf.sort_values("rank")[list(FEATURES)].to_numpy(dtype=np.float64)
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    f, th, lt, rt, lv = grow_tree(x, np.random.default_rng([SEED, cid, tree]), limit)
    return pd.DataFrame([(cid, tree, len(x), f, th, lt, rt, lv)], columns=[c.name for c in TREE_SCHEMA.fields])


def fit_forests(rows: DataFrame, key: str = "shipment_key") -> DataFrame:
    """Trees per tenant with at least ``MIN_ROWS`` rows (features null -> 0); ``key`` identifies a row."""
    x = rows.select(F.col("company_id").cast("int").alias("company_id"), F.col(key).cast("string").alias("_key"),
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURES])
    counts = x.groupBy("company_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_ROWS)
    unit = 1 << 40

    def draw(tree):
        return F.pmod(F.xxhash64("_key", tree, F.lit(SEED)), F.lit(unit))

    bound = F.least(F.lit(1.0), F.lit(float(OFFERED)) / F.col("_n")) * unit
    # every (row, tree) is drawn in generated code: filtering an array of trees would be interpreted
    trees = F.explode(F.array(*[F.lit(t) for t in range(N_TREES)]))
    offered = x.join(F.broadcast(counts), "company_id").withColumn("_bound", bound).withColumn("tree", trees).where(draw(F.col("tree")) < F.col("_bound"))
    rank = F.row_number().over(Window.partitionBy("company_id", "tree").orderBy(draw(F.col("tree")), "_key"))
    sample = offered.withColumn("rank", rank).where(F.col("rank") <= MAX_SAMPLES)
    return sample.select("company_id", "tree", "rank", *FEATURES).groupBy("company_id", "tree").applyInPandas(_fit_tree, TREE_SCHEMA)


def _path_lengths(forest: list, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row; a leaf is its own child, so all rows of a chunk take the same steps."""
    total = np.zeros(len(x))
    trees = []
    for feat, thr, lt, rt, lv in forest:
        here, inner = np.arange(len(feat)), feat >= 0
        child = np.column_stack([np.where(inner, rt, here), np.where(inner, lt, here)]).reshape(-1)
        depth, at = 0, np.zeros(1, np.int64)
        while inner[at].any():
            at, depth = np.unique(child.reshape(-1, 2)[at]), depth + 1
        trees.append((np.where(inner, feat, 0), thr, child, lv, depth))
    for a in range(0, len(x), CHUNK_ROWS):
        part = np.ascontiguousarray(x[a:a + CHUNK_ROWS])
        flat, first = part.reshape(-1), np.arange(len(part)) * x.shape[1]
        for feat, thr, child, lv, depth in trees:
            node = np.zeros(len(part), np.int64)
            for _ in range(depth):
                value = flat.take(feat.take(node) + first)
                node = child.take(2 * node + (value < thr.take(node)))
            total[a:a + CHUNK_ROWS] += lv.take(node)
    return total / len(forest)


def score_rows(rows: DataFrame, forests: DataFrame, keep: Sequence[str], key: str = "shipment_key") -> DataFrame:
    """score_samples = -2^(-E[h(x)] / c(psi)) for every row of every fitted tenant: company_id, ``keep`` and if_score."""
    kept = [c for c in keep if c != "company_id"]
    x = rows.select(F.col("company_id").cast("int").alias("company_id"), *kept, F.xxhash64(F.col(key).cast("string")).alias("_hash"),
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(FEATURES)])
    buckets = x.groupBy("company_id").agg(F.ceil(F.count(F.lit(1)) / BUCKET_ROWS).alias("_buckets"))  # a row a tenant
    x = x.join(F.broadcast(buckets), "company_id").withColumn("_bucket", F.pmod("_hash", "_buckets")).drop("_buckets", "_hash")
    f = forests.join(F.broadcast(buckets), "company_id").withColumn("_bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_buckets") - 1)))
    out_schema = T.StructType([x.schema["company_id"], *[x.schema[c] for c in kept], T.StructField("if_score", T.DoubleType())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["company_id", *kept])
        if not left.num_rows or not right.num_rows:
            return out.slice(0, 0).append_column("if_score", pa.array([], pa.float64()))
        array = lambda v, kind: np.array(v, dtype=kind)
        forest = [(array(r["feature"], np.int64), array(r["threshold"], float), array(r["left"], np.int64), array(r["right"], np.int64), array(r["leaf_value"], float))
                  for r in right.sort_by("tree").to_pylist()]
        h = _path_lengths(forest, np.column_stack([left.column(f"_x{j}").to_numpy() for j in range(len(FEATURES))]))
        psi = max(right.column("psi").to_pylist())
        return out.append_column("if_score", pa.array(-np.power(2.0, -h / float(c_factor([psi])[0]))))

    return x.groupBy("company_id", "_bucket").cogroup(f.groupBy("company_id", "_bucket")).applyInArrow(run, out_schema)


def score_quantile(scored: DataFrame, share: float) -> DataFrame:
    """(company_id, _offset): the exact ``share`` quantile of each tenant's scores, interpolated linearly between ranks."""
    distinct = scored.groupBy("company_id", "if_score").agg(F.count(F.lit(1)).alias("_c"))
    placed = prefix_sums(distinct, ["company_id"], "if_score", ["_c"])  # _cum__c: rows of smaller score
    total = distinct.groupBy("company_id").agg((F.lit(share) * (F.sum("_c") - 1)).alias("_at"))
    low, up = F.floor("_at"), F.ceil("_at")

    def of(rank):
        return F.max(F.when((F.col("_cum__c") <= rank) & (rank < F.col("_cum__c") + F.col("_c")), F.col("if_score")))

    ends = placed.join(total, "company_id").groupBy("company_id", "_at").agg(of(low).alias("_a"), of(up).alias("_b"))
    return ends.select("company_id", (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - low)).alias("_offset"))


def shipment_anomalies(shipments: DataFrame, contamination: float = CONTAMINATION,
                       forests: DataFrame | None = None) -> DataFrame:
    """A2: anomalous shipments per tenant with score = min(1, 2|decision|) and severity tiers.

    ``forests`` (from ``fit_forests``) may be passed in to reuse a fitted model.
    """
    keep = ["shipment_key", "order_date", "quantity"]
    forests = forests if forests is not None else fit_forests(shipments)
    path = new_folder(shipments.sparkSession, "scored")  # scored once for the quantile and the rows
    score_rows(shipments, forests, keep).write.mode("overwrite").parquet(path)
    scored = shipments.sparkSession.read.parquet(path)
    offset = score_quantile(scored, contamination)  # a row a tenant
    j = scored.join(F.broadcast(offset), "company_id").withColumn("decision", F.col("if_score") - F.col("_offset"))
    an = j.where(F.col("decision") < 0)
    score = F.least(F.lit(1.0), F.abs("decision") * 2)
    return an.select(
        "company_id", F.lit("shipment").alias("entity_type"), F.col("shipment_key").alias("entity_id"),
        F.col("shipment_key").alias("record_id"), F.col("order_date").cast("date").alias("date"),
        F.lit("shipment_profile").alias("metric"), F.round(F.coalesce("quantity", F.lit(0.0)), 2).alias("value"),
        F.round(score, 4).alias("score"),
        F.when(score > 0.8, "CRITICAL").when(score > 0.5, "HIGH").otherwise("MEDIUM").alias("severity"),
        F.lit("Shipment profile is multidimensionally anomalous compared to historical averages "
              "(IsolationForest).").alias("explanation"))
