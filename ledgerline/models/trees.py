"""Regression forests and boosted trees grown on Spark from histograms of binned features.

Every row of the training table takes part. Features are cut once at approximate quantiles into at most ``BINS`` bins and
kept as packed blocks of bytes (one Arrow row for some ten thousand table rows) in the shared folder. From there

* a **forest** grows all its trees level by level, one job a level: each task sums weight and label of its rows by
  (tree, node, feature, bin), Spark adds these sums up by (tree, block of nodes), and the best split of a node is found
  where its sums meet. Only splits, whose number the trees' depth bounds, return to the driver. Bootstrap weights are
  Poisson draws from a hash of the row's key and the tree, so they don't depend on the cluster;
* **boosting** needs three short sums a tree, one after the other. Its blocks are a persisted RDD of arrays (a job a level
  without planning a query). Residuals are made anew after ``LATE_TREES`` trees, or after each where tasks hold many rows;
  until then a job takes the trees since off by itself. Every ``SAVED_TREES`` trees the residuals are checkpointed in the
  shared folder, so a lost executor costs at most so many updates.

A table of at most ``HELD_ROWS`` rows is broadcast in its packed form instead, and its trees grow without a job a level: a
forest's trees are dealt over the tasks, a boosted fit is one task. The sums are the same, so are the trees.

Both fit classes, too, on rows with sample weights: a forest of labels 0 and 1 (its squared error is half the Gini impurity,
so a leaf's value is the share of class 1; each node draws ``subset`` of the features), and boosting of the logistic loss
with the steps of MLlib's ``GBTClassifier``. Then a third sum counts rows, and the least size of a leaf is in rows.

Trees are heap-ordered arrays (children of node i at 2i+1 and 2i+2) with a row a tree in ``Forest.table``: a row goes left if
x <= threshold; NaN goes right. Gains are reductions of the squared error; ties take the first feature and the lowest cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import checkpoint_root, new_folder

BINS = 32
BLOCK_ROWS = 65_536
TASK_ROWS = 2_000_000  # rows a task holds while it sums
HELD_ROWS = 1_500_000  # rows of a table that is broadcast, so that tasks grow whole trees on it
HELD_TASKS = 4  # of a forest on such a table, for each core
CHUNK_ROWS = 131_072  # rows whose sums are made at once: their arrays stay in a core's cache
JOINT_CELLS = 8_192  # most cells (nodes x bins) that features share in a pass over the rows
NODES = 32  # of a level that are summed together
SAVED_TREES = 20
LATE_TREES = 5  # trees after which boosting makes new residuals; divides SAVED_TREES
LATE_ROWS = 50_000  # rows a task up to which that is cheaper than storing them after each tree
FAN_IN = 256  # parts that one task adds up
TABLE = "tree int, kind string, base double, rate double, feature array<int>, threshold array<double>, value array<double>"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Forest:
    kind: str
    base: float  # what every prediction starts from
    rate: float  # weight of each tree
    feature: np.ndarray  # (trees, nodes), -1 at leaves
    threshold: np.ndarray
    value: np.ndarray
    importance: np.ndarray | None = None  # share of each feature in what the splits gained

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            live = rows
            while len(live):
                at = node[live]
                f = feature[at]
                live, at, f = live[f >= 0], at[f >= 0], f[f >= 0]
                node[live] = 2 * at + 1 + ~(x[live, f] <= threshold[at])
            total += self.rate * value[node]
        return total

    def table(self, spark: SparkSession) -> DataFrame:
        """A row a tree."""
        rows = [(t, self.kind, float(self.base), float(self.rate), self.feature[t].tolist(), self.threshold[t].tolist(), self.value[t].tolist())
                for t in range(len(self.feature))]
        return spark.createDataFrame(rows, TABLE)

    @staticmethod
    def of(rows: Sequence) -> Forest:
        """From the rows of ``table``."""
        rows = sorted(rows, key=lambda r: r["tree"])
        pick = lambda name, kind: np.array([r[name] for r in rows], kind)
        return Forest(rows[0]["kind"], rows[0]["base"], rows[0]["rate"], pick("feature", np.int32), pick("threshold", float), pick("value", float))


@dataclass
class Packed:
    """Binned rows of a training table."""

    blocks: DataFrame  # (n, x, y, key[, w]): one row for up to BLOCK_ROWS table rows, features one after the other
    cuts: list[np.ndarray]
    rows: int
    weighted: bool = False

    @property
    def widths(self) -> np.ndarray:
        return np.array([len(c) + 1 for c in self.cuts])

    def threshold(self, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        most = max(1, max(len(c) for c in self.cuts))
        wide = np.array([np.append(c, np.zeros(most - len(c))) for c in self.cuts])
        return np.where(feature >= 0, wide[np.maximum(feature, 0), np.maximum(cut, 0)], 0.0)


def cut_points(df: DataFrame, features: Sequence[Column]) -> list[np.ndarray]:
    """At most BINS - 1 cuts a feature: quantiles over all rows and the smallest value, without the largest."""
    shares = [k / BINS for k in range(1, BINS)]
    doubles = [F.nanvl(f.cast("double"), F.lit(None).cast("double")) for f in features]
    found = df.agg(*[F.percentile_approx(f, shares, 10_000).alias(f"q{i}") for i, f in enumerate(doubles)],
                   *[F.min(f).alias(f"a{i}") for i, f in enumerate(doubles)], *[F.max(f).alias(f"b{i}") for i, f in enumerate(doubles)]).first()
    out = []
    for i in range(len(features)):
        values = np.unique(np.array([*(found[f"q{i}"] or []), found[f"a{i}"]], float)) if found[f"a{i}"] is not None else np.zeros(0)
        out.append(values[values < found[f"b{i}"]][:BINS - 1] if len(values) else values)
    return out


def bin_rows(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """(features, rows) bytes: the number of cuts below each value."""
    return np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8)


def _packer(cuts: list[np.ndarray], weighted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda c, kind: table.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(kind)
        x = bin_rows(np.column_stack([column(f"f{i}", float) for i in range(len(cuts))]), cuts)
        made = {"n": [table.num_rows], "x": [x.tobytes()], "y": [column("y", float).tobytes()], "key": [column("key", np.int64).tobytes()]}
        return pa.record_batch(made | ({"w": [column("w", float).tobytes()]} if weighted else {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield block(held)
                held, n = [], 0
        if n:
            yield block(held)

    return run


def pack(df: DataFrame, features: Sequence[Column], label: str, keys: Sequence[str], cuts: list[np.ndarray] | None = None, weight: str | None = None) -> Packed:
    """Bin all rows of ``df``; rows whose label is null are left out. ``keys`` seed the bootstrap, ``weight`` is a row's weight."""
    df = df.where(F.col(label).isNotNull())
    cuts = cut_points(df, features) if cuts is None else cuts
    flat = df.select(*[f.cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("y"), F.xxhash64(*keys).alias("key"),
                     *([F.col(weight).cast("double").alias("w")] if weight else []))
    path = new_folder(df.sparkSession, "packed")
    flat.mapInArrow(_packer(cuts, weight is not None), "n long, x binary, y binary, key binary" + (", w binary" if weight else "")).write.mode("overwrite").parquet(path)
    blocks = df.sparkSession.read.parquet(path)
    return Packed(blocks, cuts, blocks.agg(F.sum("n")).first()[0] or 0, weight is not None)


# ---- sums and splits, on arrays ---------------------------------------------------------------
def poisson(key: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """Bootstrap weight of each row in a tree: Poisson(1) from a hash of both."""
    h = key.view(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    weight = _POISSON_OF[(h >> np.uint64(52)).view(np.int64)]
    open_ = np.flatnonzero(weight == 255)  # a bound lies within the slot
    weight[open_] = np.searchsorted(_POISSON_CDF, (h[open_] >> np.uint64(11)) * 2.0 ** -53, "right")
    return weight


_POISSON_CDF = np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)]))
#: Weight by the first 12 bits of the hash, 255 where these don't decide.
_POISSON_OF = np.searchsorted(_POISSON_CDF, np.arange(4096) / 4096, "right").astype(np.uint8)
_POISSON_OF[np.floor(_POISSON_CDF * 4096).astype(int).clip(0, 4095)] = 255


class _Rows:
    """Binned rows that a task holds: feature by feature, and row by row for the walks down a tree."""

    def __init__(self, x: np.ndarray, widths: np.ndarray) -> None:
        self.x, self.widths, self.n = x, widths, x.shape[1]
        self.flat = np.ascontiguousarray(x.T).reshape(-1)
        self._joined: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def joined(self, n_nodes: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Features that are summed together: the joint bin of each row, the cells of these features, and which joint bins
        each of them adds up. That takes one pass over the rows instead of one a feature."""
        n_nodes = 1 << (n_nodes - 1).bit_length()  # so that few are kept
        if n_nodes not in self._joined:
            room = min(JOINT_CELLS, self.n // 4) // n_nodes
            start = np.cumsum(self.widths) - self.widths
            groups: list[list[int]] = []
            sizes: list[int] = []
            for f in np.argsort(-self.widths, kind="stable"):
                fits = [g for g in range(len(groups)) if sizes[g] * self.widths[f] <= room]
                if fits:
                    groups[fits[0]].append(int(f))
                    sizes[fits[0]] *= int(self.widths[f])
                else:
                    groups.append([int(f)])
                    sizes.append(int(self.widths[f]))
            out = []
            for group, size in zip(groups, sizes, strict=True):
                code = self.x[group[0]].astype(np.min_scalar_type(size), copy=False)
                for f in group[1:]:
                    code = code * code.dtype.type(self.widths[f]) + self.x[f]
                bins = np.indices([self.widths[f] for f in group]).reshape(len(group), -1)
                cells = np.concatenate([np.arange(start[f], start[f] + self.widths[f]) for f in group])
                out.append((code, cells, np.concatenate([b[:, None] == np.arange(self.widths[f]) for b, f in zip(bins, group, strict=True)], axis=1).astype(float)))
            self._joined[n_nodes] = out
        return self._joined[n_nodes]


def sums(held: _Rows, rows: np.ndarray | None, node: np.ndarray, n_nodes: int, *weights: np.ndarray | None) -> np.ndarray:
    """(nodes, weights, cells): each of ``weights`` (weight and weighted label; None counts rows) added up by node and bin, the
    features' bins one after the other."""
    out = np.empty((n_nodes, len(weights), int(held.widths.sum())))
    node = node.astype(np.int64)
    for code, cells, adds in held.joined(n_nodes):
        cell = node * len(adds)
        cell += code if rows is None else code[rows]
        for k, weight in enumerate(weights):
            found = np.bincount(cell, weight, minlength=n_nodes * len(adds)).reshape(n_nodes, -1)
            out[:, k, cells] = found if len(adds) == len(cells) else found @ adds
    return out


@dataclass
class Splits:
    """Of some nodes: feature (-1: none), cut, weight and label sum of both sides (the whole node's where none), and gain."""

    feature: np.ndarray
    cut: np.ndarray
    sides: np.ndarray  # (nodes, 4): left weight, left sum, right weight, right sum
    whole: np.ndarray  # (nodes, 2)
    gain: np.ndarray


def drawn_features(tree: int, nodes: np.ndarray, n_features: int, most: int, seed: int) -> np.ndarray:
    """(nodes, features): which ``most`` features each node of a tree may split by."""
    out = np.zeros((len(nodes), n_features), bool)
    for i, node in enumerate(nodes):
        out[i, np.random.default_rng([seed, tree, int(node)]).choice(n_features, min(most, n_features), replace=False)] = True
    return out


def best_splits(s: np.ndarray, widths: np.ndarray, min_leaf: float, allowed: np.ndarray | None = None) -> Splits:
    """The split of each node that lowers the squared error most, both sides weighing ``min_leaf`` at least (where rows are
    counted by a third sum: having so many). ``allowed`` (nodes, features) are the features a node may split by."""
    size = s.shape[1] // 3 * 2  # the sum that min_leaf is about
    n, least = len(s), max(min_leaf, 1e-9)
    whole = s[:, :, :widths[0]].sum(axis=2)
    best = np.full(n, 1e-12)
    feature, cut = np.full(n, -1, np.int32), np.zeros(n, np.int32)
    sides = np.zeros((n, 4))
    every = np.arange(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        none = np.where(whole[:, 0] > 0, whole[:, 1] ** 2 / whole[:, 0], 0.0)
        at = 0
        for f, width in enumerate(widths):
            left = np.cumsum(s[:, :, at:at + width], axis=2)[:, :, :-1]
            at += width
            if width < 2:
                continue
            right = whole[:, :, None] - left
            gain = left[:, 1] ** 2 / left[:, 0]
            gain += right[:, 1] ** 2 / right[:, 0]
            gain -= none[:, None]
            np.copyto(gain, -np.inf, where=~(np.minimum(left[:, size], right[:, size]) >= least))
            if allowed is not None:
                gain[~allowed[:, f]] = -np.inf
            c = gain.argmax(axis=1)
            g = gain[every, c]
            better = np.flatnonzero(g > np.maximum(best, 1e-12 * (1 + np.abs(none))))
            c = c[better]
            best[better], feature[better], cut[better] = g[better], f, c
            sides[better, :2], sides[better, 2:] = left[better, :2, c], right[better, :2, c]
    return Splits(feature, cut, sides, whole[:, :2], np.where(feature >= 0, best, 0.0))


class _Growing:
    """Trees under construction: heap arrays with cuts instead of thresholds."""

    def __init__(self, trees: int, depth: int) -> None:
        self.feature = np.full((trees, 2 ** (depth + 1) - 1), -1, np.int32)
        self.cut = np.zeros(self.feature.shape, np.int32)
        self.value = np.zeros(self.feature.shape)
        self.gain = np.zeros(self.feature.shape)
        self.open = np.zeros(self.feature.shape, bool)  # nodes that may be split at their level
        self.open[:, 0] = True

    def put(self, tree: int, nodes: np.ndarray, s: Splits) -> None:
        split = s.feature >= 0
        self.feature[tree, nodes], self.cut[tree, nodes], self.gain[tree, nodes] = s.feature, s.cut, s.gain
        if nodes[0] == 0:
            self.value[tree, 0] = s.whole[0, 1] / s.whole[0, 0] if s.whole[0, 0] > 0 else 0.0
        for side in (0, 1):
            child = 2 * nodes[split] + 1 + side
            weight, total = s.sides[split, 2 * side], s.sides[split, 2 * side + 1]
            self.value[tree, child] = total / weight
            if len(child) and child.max() < self.open.shape[1] // 2:
                self.open[tree, child] = True

    def only(self, tree: int) -> _Growing:
        """One tree by itself, as tree 0."""
        one = _Growing(0, 0)
        for name in ("feature", "cut", "value", "gain", "open"):
            setattr(one, name, getattr(self, name)[tree:tree + 1])
        return one

    def put_tree(self, tree: int, grown: _Growing) -> None:
        """Tree 0 of ``grown`` as ``tree``."""
        for name in ("feature", "cut", "value", "gain", "open"):
            getattr(self, name)[tree] = getattr(grown, name)[0]

    def leaf(self, tree: int, held: _Rows, rows: np.ndarray | None, steps: int) -> np.ndarray:
        """The node each row reaches within ``steps`` steps."""
        return self.down(tree, held, rows, np.zeros(held.n if rows is None else len(rows), np.int64), steps)

    def down(self, tree: int, held: _Rows, rows: np.ndarray | None, node: np.ndarray, steps: int) -> np.ndarray:
        """The node each row reaches from ``node`` within ``steps`` steps."""
        inner = self.feature[tree] >= 0
        to = np.arange(len(inner))
        to = np.where(inner, 2 * to + 1, to)
        feature, cut = np.where(inner, self.feature[tree], 0).astype(np.int64), np.where(inner, self.cut[tree], 255).astype(np.uint8)
        first = (np.arange(held.n) if rows is None else rows) * len(held.widths)
        for _ in range(steps):
            node = to[node] + (held.flat[first + feature[node]] > cut[node])
        return node

    def importance(self, n_features: int, each: bool) -> np.ndarray:
        """Share of each feature in the gains of all splits; ``each``: every tree counts alike."""
        by_tree = np.zeros((len(self.feature), n_features))
        tree, node = np.nonzero(self.feature >= 0)
        np.add.at(by_tree, (tree, self.feature[tree, node]), self.gain[tree, node])
        if each:
            by_tree /= np.maximum(by_tree.sum(axis=1, keepdims=True), 1e-300)
        return by_tree.sum(axis=0) / max(by_tree.sum(), 1e-300)

    def done(self, kind: str, base: float, rate: float, packed_threshold: Callable, n_features: int) -> Forest:
        return Forest(kind, base, rate, self.feature, packed_threshold(self.feature, self.cut), self.value, self.importance(n_features, kind == "random_forest"))


def _arrays(r: dict, n_features: int) -> tuple[np.ndarray, ...]:
    """Bins, labels, keys and, where rows have them, weights of a block."""
    return (np.frombuffer(r["x"], np.uint8).reshape(n_features, -1), np.frombuffer(r["y"]), np.frombuffer(r["key"], np.int64),
            *([np.frombuffer(r["w"])] if "w" in r else []))


def _joined(blocks: Sequence[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(c, axis=-1) for c in zip(*blocks, strict=True))


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Bins, labels, keys and weights of the blocks, joined up to TASK_ROWS rows."""
    held, n = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            held.append(_arrays(r, n_features))
            n += r["n"]
            if n >= TASK_ROWS:
                yield _joined(held)
                held, n = [], 0
    if held:
        yield _joined(held)


def _weights(w: np.ndarray, y: np.ndarray, sample: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """What is added up of rows drawn ``w`` times: weight, weighted label and, of rows with sample weights, the times."""
    return (w, w * y) if sample is None else (w * sample, w * sample * y, w)


# ---- tables that are broadcast ----------------------------------------------------------------
class _Held:
    """A whole packed table, in the parts that ``fit_boosted`` would deal it into."""

    def __init__(self, packed: Packed, parts: int) -> None:
        self.widths, self.parts = packed.widths, []
        found = packed.blocks.repartition(parts).withColumn("part", F.spark_partition_id()).collect()  # at most HELD_ROWS rows
        for p in sorted({r["part"] for r in found}):
            self.parts.append(_joined([_arrays(r.asDict(), len(self.widths)) for r in found if r["part"] == p]))


def _held_forest(packed: Packed, trees: int, depth: int, min_leaf: float, seed: int, subset: int | None) -> _Growing:
    sc = packed.blocks.sparkSession.sparkContext
    growing, widths = _Growing(trees, depth), packed.widths
    sent = sc.broadcast(_Held(packed, 1))

    def grow(numbers: Iterator[int]) -> Iterator[tuple[int, _Growing]]:
        x, y, key, *sample = sent.value.parts[0]
        held = _Rows(x, widths)
        for tree in numbers:
            one = _Growing(1, depth)
            _grow_tree(one, 0, tree, held, y, key, sample[0] if sample else None, depth, min_leaf, seed, subset)
            yield tree, one

    for tree, one in sc.parallelize(range(trees), min(trees, HELD_TASKS * sc.defaultParallelism)).mapPartitions(grow).collect():
        growing.put_tree(tree, one)
    sent.unpersist()
    return growing


def _held_boosted(packed: Packed, parts: int, trees: int, depth: int, rate: float, min_leaf: float, base: float, logistic: bool) -> _Growing:
    sc = packed.blocks.sparkSession.sparkContext
    widths = packed.widths
    sent = sc.broadcast(_Held(packed, parts))

    def grow(_: Iterator[int]) -> Iterator[_Growing]:
        growing = _Growing(trees, depth)
        held = [(_Rows(x, widths), *_boosting_state(y, sample, base, logistic)) for x, y, _key, *sample in sent.value.parts]
        for tree in range(trees):
            wanted = [_wanted(state, of, tree) for _, state, of in held]
            for level in range(depth):
                if not growing.open[tree, 2 ** level - 1:2 ** (level + 1) - 1].any():
                    break
                s = None
                for (rows, _, of), rest in zip(held, wanted, strict=True):
                    found = _residual_sums(rows, rest, of, growing, tree, level)
                    s = found if s is None else s + found
                _put_level(growing, tree, level, s, widths, min_leaf)
            _full_first(growing, tree, rate, logistic)
            held = [(rows, _stepped(state, of, rate * growing.value[tree][growing.leaf(tree, rows, None, depth)]), of) for rows, state, of in held]
        yield growing

    growing = sc.parallelize([0], 1).mapPartitions(grow).first()
    sent.unpersist()
    return growing


# ---- forest: one job a level ------------------------------------------------------------------
def _level_sums(batches, growing, level, widths, seed):
    first, size = 2 ** level - 1, 2 ** level
    for x, y, key, *sample in _blocks(batches, len(widths)):
        parts = [slice(a, a + CHUNK_ROWS) for a in range(0, len(y), CHUNK_ROWS)]
        held = [_Rows(x[:, p], widths) for p in parts]
        for tree in range(len(growing.feature)):
            if not growing.open[tree, first:first + size].any():
                continue
            s = None
            for part, p in zip(held, parts, strict=True):
                w = poisson(key[p], tree, seed)
                rows = np.flatnonzero(w != 0)
                node = growing.leaf(tree, part, rows, level)
                here = np.flatnonzero(growing.open[tree, node] & (node >= first))
                rows, node = rows[here], node[here] - first
                found = sums(part, rows, node, size, *_weights(w[rows].astype(float), y[p][rows], sample[0][p][rows] if sample else None))
                s = found if s is None else np.add(s, found, out=s)
            for a in range(0, size, NODES):
                if s[a:a + NODES, 0, :widths[0]].any():
                    yield pa.record_batch({"tree": pa.array([tree], pa.int32()), "block": pa.array([a // NODES], pa.int32()), "sums": [s[a:a + NODES].tobytes()]})


def _add(parts: pa.ChunkedArray) -> np.ndarray:
    total = None
    for p in parts:
        s = np.frombuffer(p.as_buffer(), float)
        total = s.copy() if total is None else total + s
    return total


def _added(key: tuple, part: pa.Table) -> pa.Table:
    return pa.table({"tree": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "sums": [_add(part.column("sums")).tobytes()]})


def _level_splits(level: int, widths: np.ndarray, min_leaf: float, of: int, subset: int | None, seed: int) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(key: tuple, part: pa.Table) -> pa.Table:
        added, (tree, block) = _add(part.column("sums")).reshape(-1, of, int(widths.sum())), (k.as_py() for k in key)
        allowed = subset and drawn_features(tree, 2 ** level - 1 + block * NODES + np.arange(len(added)), len(widths), subset, seed)
        s = best_splits(added, widths, min_leaf, allowed)
        return pa.table({"tree": pa.array([tree], pa.int32()), "block": pa.array([block], pa.int32()), "feature": [s.feature.tobytes()],
                         "cut": [s.cut.tobytes()], "sides": [s.sides.tobytes()], "whole": [np.ascontiguousarray(s.whole).tobytes()], "gain": [s.gain.tobytes()]})

    return run


def fit_forest(packed: Packed, trees: int, depth: int, min_leaf: float, seed: int, subset: int | None = None) -> Forest:
    """A random forest of ``trees`` trees, every tree on a bootstrap of all rows and every node over all features, or over
    ``subset`` of them that it draws."""
    if packed.rows <= HELD_ROWS:
        return _held_forest(packed, trees, depth, min_leaf, seed, subset).done("random_forest", 0.0, 1.0 / trees, packed.threshold, len(packed.cuts))
    growing, widths = _Growing(trees, depth), packed.widths
    sc = packed.blocks.sparkSession.sparkContext
    parts = max(sc.defaultParallelism, -(-packed.rows // TASK_ROWS))
    blocks = packed.blocks.repartition(parts)
    schema = "tree int, block int, sums binary"
    for level in range(depth):
        first = 2 ** level - 1
        if not growing.open[:, first:2 * first + 1].any():
            break
        sent = sc.broadcast(growing)  # trees x 2^(depth+1) nodes
        found = blocks.mapInArrow(lambda batches, sent=sent, level=level: _level_sums(batches, sent.value, level, widths, seed), schema)
        left = parts
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            found = found.groupBy("tree", "block", F.pmod(F.xxhash64("sums"), F.lit(left)).alias("part")).applyInArrow(_added, schema)
        splits = found.groupBy("tree", "block").applyInArrow(_level_splits(level, widths, min_leaf, 3 if packed.weighted else 2, subset, seed),
                                                             "tree int, block int, feature binary, cut binary, sides binary, whole binary, gain binary")
        for r in splits.collect():  # the splits of one level: bounded by the forest
            s = Splits(np.frombuffer(r["feature"], np.int32), np.frombuffer(r["cut"], np.int32), np.frombuffer(r["sides"]).reshape(-1, 4), np.frombuffer(r["whole"]).reshape(-1, 2),
                       np.frombuffer(r["gain"]))
            growing.put(r["tree"], first + r["block"] * NODES + np.arange(len(s.feature)), s)
        sent.unpersist()
    return growing.done("random_forest", 0.0, 1.0 / trees, packed.threshold, len(widths))


# ---- boosting: one job a level --------------------------------------------------------------------
def _boosting_state(y: np.ndarray, sample: Sequence[np.ndarray], base: float, logistic: bool) -> tuple[np.ndarray, tuple | None]:
    """What changes of some rows from tree to tree, and what stays: their residuals; or, for the logistic loss, their margins,
    with their classes (-1 and 1) and weights."""
    if not logistic:
        return y - base, None
    return np.zeros(len(y)), (2.0 * y - 1.0, sample[0] if sample else np.ones(len(y)))


def _stepped(state: np.ndarray, of: tuple | None, step: np.ndarray) -> np.ndarray:
    return state - step if of is None else state + step


def _wanted(state: np.ndarray, of: tuple | None, tree: int) -> np.ndarray:
    """What a tree is fitted to: residuals; or the classes and then, as MLlib, the steepest way down twice the logistic loss."""
    if of is None:
        return state
    return of[0] if tree == 0 else 4.0 * of[0] / (1.0 + np.exp(np.minimum(2.0 * of[0] * state, 700.0)))


def _full_first(growing: _Growing, tree: int, rate: float, logistic: bool) -> None:
    """As MLlib, the first tree of the logistic loss counts whole."""
    if logistic and tree == 0:
        growing.value[0] /= rate


def _residual_sums(held: _Rows, rest: np.ndarray, of: tuple | None, growing: _Growing, tree: int, level: int) -> np.ndarray:
    """Sums of the residuals by the nodes of a level; node 0 is the root."""
    first, size = 2 ** level - 1, 2 ** level
    added = (None, rest) if of is None else (of[1], of[1] * rest, None)
    if not level:
        return sums(held, None, np.zeros(len(rest), np.int64), 1, *added)
    node = growing.leaf(tree, held, None, level)
    live = np.flatnonzero((node >= first) & growing.open[tree, node])
    return sums(held, live, node[live] - first, size, *[a if a is None else a[live] for a in added])


def _put_level(growing: _Growing, tree: int, level: int, s: np.ndarray, widths: np.ndarray, min_leaf: float) -> None:
    nodes = 2 ** level - 1 + np.arange(2 ** level)
    splits = best_splits(s, widths, min_leaf)
    splits.feature[~growing.open[tree, nodes]] = -1
    growing.put(tree, nodes, splits)


def fit_boosted(packed: Packed, trees: int, depth: int, rate: float, min_leaf: float = 1.0, logistic: bool = False) -> Forest:
    """Gradient boosting of the squared error from the mean label, or of the logistic loss from 0: then the prediction is half
    the log odds of class 1."""
    growing, widths = _Growing(trees, depth), packed.widths
    spark = packed.blocks.sparkSession
    checkpoint_root(spark)  # names the shared folder for the checkpoints below
    total = packed.blocks.mapInArrow(_label_sum, "total double").agg(F.sum("total")).first()[0]
    base = 0.0 if logistic else (total or 0.0) / max(packed.rows, 1)
    parts = max(spark.sparkContext.defaultParallelism, -(-packed.rows // TASK_ROWS))
    n_features = len(widths)
    if packed.rows <= HELD_ROWS:
        return _held_boosted(packed, parts, trees, depth, rate, min_leaf, base, logistic).done("gradient_boosting", base, rate, packed.threshold, n_features)

    def joined(rows):
        held = [_arrays(r.asDict(), n_features) for r in rows]
        if held:
            x, y, _key, *sample = _joined(held)
            yield x, *_boosting_state(y, sample, base, logistic)

    def after(block, late):
        held, (_, state, of) = _Rows(block[0], widths), block
        for one in late:
            state = _stepped(state, of, rate * one.value[0][one.leaf(0, held, None, depth)])
        return held, state, of

    def found_in(block, late, one, tree, level):
        held, state, of = after(block, late)
        return _residual_sums(held, _wanted(state, of, tree), of, one, 0, level)

    state = packed.blocks.repartition(parts).rdd.mapPartitions(joined).persist(StorageLevel.MEMORY_AND_DISK)
    deep, before = 1 if parts <= FAN_IN else 2, None
    most = LATE_TREES if packed.rows <= parts * LATE_ROWS else 1
    late: list[_Growing] = []  # trees that the state doesn't know yet
    for tree in range(trees):
        for level in range(depth):
            if not growing.open[tree, 2 ** level - 1:2 ** (level + 1) - 1].any():
                break
            one = growing.only(tree)
            found = state.map(lambda block, one=one, tree=tree, level=level, late=tuple(late): found_in(block, late, one, tree, level))
            _put_level(growing, tree, level, found.treeReduce(np.add, depth=deep) if deep > 1 else found.reduce(np.add), widths, min_leaf)
            if before is not None:  # the first job on a new state has made it
                before.unpersist()
                before = None
        _full_first(growing, tree, rate, logistic)
        late.append(growing.only(tree))
        if len(late) < most or tree == trees - 1:
            continue
        before = state
        state = before.map(lambda block, late=tuple(late): (block[0], *after(block, late)[1:])).persist(StorageLevel.MEMORY_AND_DISK)
        late = []
        if tree % SAVED_TREES == SAVED_TREES - 1:
            state.checkpoint()
    state.unpersist()
    return growing.done("gradient_boosting", base, rate, packed.threshold, n_features)


def _label_sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch({"total": [float(np.frombuffer(y.as_buffer()).sum()) for y in batch.column("y")]})


# ---- a group that one task holds (a tenant's own model) -----------------------------------------
def cuts_of_group(x: np.ndarray) -> list[np.ndarray]:
    """Cuts of each column as ``cut_points`` makes them."""
    out = []
    for column in x.T:
        column = column[~np.isnan(column)]
        values = np.unique(np.append(np.quantile(column, np.arange(1, BINS) / BINS, method="inverted_cdf"), column.min())) if len(column) else column
        out.append(values[values < column.max()][:BINS - 1] if len(values) else values)
    return out


def forest_of_group(x: np.ndarray, y: np.ndarray, key: np.ndarray, packed_threshold: Callable, widths: np.ndarray, trees: int, depth: int, min_leaf: float, seed: int) -> Forest:
    """``fit_forest`` on rows that are held here."""
    growing, held = _Growing(trees, depth), _Rows(x, widths)
    for tree in range(trees):
        _grow_tree(growing, tree, tree, held, y, key, None, depth, min_leaf, seed, None)
    return growing.done("random_forest", 0.0, 1.0 / trees, packed_threshold, len(widths))


def _grow_tree(growing: _Growing, slot: int, tree: int, held: _Rows, y: np.ndarray, key: np.ndarray, sample: np.ndarray | None, depth: int, min_leaf: float, seed: int,
               subset: int | None) -> None:
    """Tree number ``tree`` of a forest, put at ``slot``: its rows go down level by level. Of two children the lighter one is
    summed, the other one is what its parent has more."""
    widths = held.widths
    w = poisson(key, tree, seed)
    rows = np.flatnonzero(w != 0)
    added, node = _weights(w[rows].astype(float), y[rows], None if sample is None else sample[rows]), np.zeros(len(rows), np.int64)
    s = sums(held, rows, node, 1, *added)
    for level in range(depth):
        first, size = 2 ** level - 1, 2 ** level
        at = np.flatnonzero(growing.open[slot, first:first + size])
        if not len(at):
            break
        splits = best_splits(s, widths, min_leaf, subset and drawn_features(tree, first + at, len(widths), subset, seed))  # a row of s an open node
        growing.put(slot, first + at, splits)
        if level == depth - 1:
            break
        node = growing.down(slot, held, rows, node, 1)
        live = np.flatnonzero(node > 2 * first)
        rows, added, node = rows[live], [a[live] for a in added], node[live]
        parents = np.flatnonzero(splits.feature >= 0)
        if not len(parents):  # no node of this level splits
            break
        right = splits.sides[parents, 2] < splits.sides[parents, 0]  # is the lighter one
        lighter = np.full(2 * size, -1)
        lighter[2 * at[parents] + right] = np.arange(len(parents))
        of = lighter[node - (2 * first + 1)]
        some = np.flatnonzero(of >= 0)
        light = sums(held, rows[some], of[some], len(parents), *[a[some] for a in added])
        below = np.empty((2 * len(parents), *s.shape[1:]))
        places = np.arange(len(parents)) * 2
        below[places + right], below[places + 1 - right] = light, s[parents] - light
        s = below


def boosted_of_group(x: np.ndarray, y: np.ndarray, packed_threshold: Callable, widths: np.ndarray, trees: int, depth: int, rate: float, min_leaf: float = 1.0) -> Forest:
    growing, base, held = _Growing(trees, depth), float(y.mean()) if len(y) else 0.0, _Rows(x, widths)
    rest = y - base
    for tree in range(trees):
        for level in range(depth):
            _put_level(growing, tree, level, _residual_sums(held, rest, None, growing, tree, level), widths, min_leaf)
        rest = rest - rate * growing.value[tree][growing.leaf(tree, held, None, depth)]
    return growing.done("gradient_boosting", base, rate, packed_threshold, len(widths))


def predicted(df: DataFrame, features: Sequence[Column], forest: Forest, name: str = "prediction") -> DataFrame:
    """``df`` with the forest's prediction; the trees travel as a broadcast (trees x 2^(depth+1) nodes at most)."""
    sent = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(sent.value.predict(np.column_stack([c.to_numpy(float) for c in columns])))

    return df.withColumn(name, score(*[f.cast("double") for f in features]))
