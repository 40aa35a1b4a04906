import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.models import trees as T


def brute_best(x, y, w, cuts, min_leaf):
    """(gain, feature, cut) of the best split of rows, by trying every one."""
    def sse(m):
        return float((w[m] * (y[m] - np.average(y[m], weights=w[m])) ** 2).sum()) if w[m].sum() else 0.0
    best = (1e-9, -1, -1)
    everything = np.ones(len(y), bool)
    for f, c in enumerate(cuts):
        for i, v in enumerate(c):
            left = x[:, f] <= v
            if w[left].sum() >= min_leaf and w[~left].sum() >= min_leaf:
                gain = sse(everything) - sse(left) - sse(~left)
                if gain > best[0] + 1e-9:
                    best = (gain, f, i)
    return best


def plain_tree(x, y, w, cuts, depth, min_leaf):
    """{heap node: (feature, threshold) or value}, grown by brute force."""
    out = {}

    def grow(node, rows, level):
        out[node] = float(np.average(y[rows], weights=w[rows]))
        if level == depth:
            return
        _, f, i = brute_best(x[rows], y[rows], w[rows], cuts, min_leaf)
        if f >= 0:
            out[node] = (f, float(cuts[f][i]))
            left = x[rows][:, f] <= cuts[f][i]
            grow(2 * node + 1, rows[left], level + 1)
            grow(2 * node + 2, rows[~left], level + 1)

    grow(0, np.flatnonzero(w), 0)
    return out


def same_tree(forest, t, plain):
    for node, want in plain.items():
        if isinstance(want, tuple):
            assert forest.feature[t, node] == want[0] and forest.threshold[t, node] == pytest.approx(want[1])
        else:
            assert forest.feature[t, node] == -1 and forest.value[t, node] == pytest.approx(want)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=700), rng.integers(0, 4, 700), rng.exponential(size=700), np.ones(700)])
    y = 3 * (x[:, 0] > 0.3) + x[:, 1] * (x[:, 2] > 1) + rng.normal(scale=0.2, size=700)
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double").repartition(5)
    return df, [F.col(c) for c in "abcd"], x, y


def test_cuts_bins_and_blocks(spark, table, monkeypatch):
    df, cols, x, y = table
    monkeypatch.setattr(T, "BLOCK_ROWS", 90)
    packed = T.pack(df, cols, "y", ["id"])
    assert packed.rows == 700 and packed.blocks.count() >= 5
    assert list(packed.cuts[1]) == [0, 1, 2] and len(packed.cuts[3]) == 0 and len(packed.cuts[0]) <= T.BINS - 1
    binned = T.bin_rows(np.array([[np.nan, -5, 99, 1]]), packed.cuts)
    assert binned[:, 0].tolist() == [len(packed.cuts[0]), 0, len(packed.cuts[2]), 0]
    some = df.withColumn("y", F.when(F.col("id") < 10, F.lit(None)).otherwise(F.col("y")))
    assert T.pack(some, cols, "y", ["id"]).rows == 690


def test_boosted_trees_equal_brute_force(table):
    df, cols, x, y = table
    packed = T.pack(df, cols, "y", ["id"])
    forest = T.fit_boosted(packed, 4, 3, 0.3, 5)
    rest, ones = y - y.mean(), np.ones(len(y))
    for t in range(4):
        same_tree(forest, t, plain_tree(x, rest, ones, packed.cuts, 3, 5))
        one = T.Forest("x", 0.0, 1.0, forest.feature[t:t + 1], forest.threshold[t:t + 1], forest.value[t:t + 1])
        rest = rest - 0.3 * one.predict(x)
    assert np.abs(forest.predict(x) - (y - rest)).max() < 1e-9
    got = {r["id"]: r["prediction"] for r in T.predicted(df, cols, forest).collect()}
    assert np.abs(np.array([got[i] for i in range(700)]) - forest.predict(x)).max() < 1e-12


def test_forest_equals_brute_force_and_a_group(spark, table, monkeypatch):
    df, cols, x, y = table
    packed = T.pack(df, cols, "y", ["id"])
    monkeypatch.setattr(T, "FAN_IN", 2)  # sums in several rounds
    monkeypatch.setattr(T, "NODES", 3)
    forest = T.fit_forest(packed, 5, 4, 3, 11)
    key = np.array([r[0] for r in spark.range(700).select(F.xxhash64("id")).collect()], np.int64)
    for t in range(5):
        w = T.poisson(key, t, 11).astype(float)
        same_tree(forest, t, plain_tree(x, y, w, packed.cuts, 4, 3))
    alone = T.forest_of_group(T.bin_rows(x, packed.cuts), y, key, packed.threshold, packed.widths, 5, 4, 3, 11)
    assert (alone.feature == forest.feature).all() and np.allclose(alone.value, forest.value) and np.allclose(alone.threshold, forest.threshold)
    assert abs(np.mean([T.poisson(key, t, 11).mean() for t in range(40)]) - 1) < 0.05


def test_table_round_trip(spark, table):
    df, cols, x, y = table
    forest = T.fit_boosted(T.pack(df, cols, "y", ["id"]), 2, 2, 0.1)
    back = T.Forest.of(forest.table(spark).collect())
    assert (back.predict(x) == forest.predict(x)).all() and back.kind == "gradient_boosting"


def test_constant_labels_make_no_split(spark):
    df = spark.range(50).select("id", F.col("id").cast("double").alias("a"), F.lit(4.0).alias("y"))
    packed = T.pack(df, [F.col("a")], "y", ["id"])
    for forest in (T.fit_forest(packed, 3, 4, 1, 1), T.fit_boosted(packed, 3, 3, 0.1)):
        assert (forest.feature == -1).all() and np.allclose(forest.predict(np.array([[1.0], [np.nan]])), 4.0)


def test_not_worse_than_mllib(spark, table):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    df, cols, x, y = table
    # MLlib gives its first boosted tree full weight, so the two are compared after enough trees
    train, test = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    packed = T.pack(train, cols, "y", ["id"])
    made = VectorAssembler(inputCols=list("abcd"), outputCol="features")
    mae = lambda p: p.select(F.avg(F.abs(F.col("prediction") - F.col("y")))).first()[0]
    pairs = [(T.fit_forest(packed, 20, 6, 3, 1), RandomForestRegressor(numTrees=20, maxDepth=6, minInstancesPerNode=3, featureSubsetStrategy="all", labelCol="y", seed=1)),
             (T.fit_boosted(packed, 60, 3, 0.1), GBTRegressor(maxIter=60, maxDepth=3, stepSize=0.1, labelCol="y", seed=1))]
    for ours, theirs in pairs:
        assert mae(T.predicted(test, cols, ours)) <= 1.05 * mae(theirs.fit(made.transform(train)).transform(made.transform(test)))


def test_joint_sums_equal_plain_ones():
    """Features summed together in one pass give what each gives by itself; four passes over the rows serve eight features."""
    rng = np.random.default_rng(3)
    widths = np.array([32, 7, 1, 2, 12, 2, 32, 3])
    x = np.stack([rng.integers(0, w, 40_000) for w in widths]).astype(np.uint8)
    w, y, node = rng.integers(1, 4, 40_000).astype(float), rng.integers(0, 50, 40_000).astype(float), rng.integers(0, 4, 40_000)
    held = T._Rows(x, widths)
    got = T.sums(held, None, node, 4, w, w * y)
    some = np.flatnonzero(rng.random(40_000) < 0.3)
    part = T.sums(held, some, node[some], 4, None, y[some])
    at = np.cumsum(widths) - widths
    for f, width in enumerate(widths):
        for n in range(4):
            m, s = node == n, node[some] == n
            assert (got[n, 0, at[f]:at[f] + width] == np.bincount(x[f, m], w[m], minlength=width)).all()
            assert (got[n, 1, at[f]:at[f] + width] == np.bincount(x[f, m], (w * y)[m], minlength=width)).all()
            assert (part[n, 0, at[f]:at[f] + width] == np.bincount(x[f, some][s], minlength=width)).all()
            assert (part[n, 1, at[f]:at[f] + width] == np.bincount(x[f, some][s], y[some][s], minlength=width)).all()
    assert len(held.joined(4)) <= 4


def test_bootstrap_weights_are_the_poisson_quantiles_of_the_hash():
    key = np.random.default_rng(5).integers(-2 ** 62, 2 ** 62, 200_000)
    h = key.view(np.uint64) + np.uint64(4 * 0x9E3779B97F4A7C15 & (1 << 64) - 1) + np.uint64(9)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    share = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
    assert (T.poisson(key, 3, 9) == sum((share >= c) for c in T._POISSON_CDF)).all()


def test_late_residuals_make_the_same_trees(table, monkeypatch):
    df, cols, x, y = table
    packed = T.pack(df, cols, "y", ["id"])
    late = T.fit_boosted(packed, 8, 3, 0.3, 5)
    monkeypatch.setattr(T, "LATE_ROWS", 0)
    each = T.fit_boosted(packed, 8, 3, 0.3, 5)
    assert (late.feature == each.feature).all() and (late.value == each.value).all()


def test_a_tree_of_a_group_may_end_early():
    """Labels that no split improves: the tree is a leaf, and growing doesn't fail."""
    from ledgerline.models import trees as t
    x = np.arange(200, dtype=float)[:, None] % 10
    cuts = t.cuts_of_group(x)
    held = t.Packed(None, cuts, 200)
    forest = t.forest_of_group(t.bin_rows(x, cuts), np.full(200, 4.0), np.arange(200), held.threshold, held.widths, 3, 5, 1, 42)
    assert np.allclose(forest.predict(x), 4.0) and (forest.feature == -1).all()


def test_broadcast_and_dealt_tables_grow_the_same_trees(spark, table, monkeypatch):
    """Regression and classes with sample weights: what one task grows is what a job a level grows."""
    df, cols, x, y = table
    classed = df.withColumns({"hit": (F.col("y") > 1.5).cast("double"), "w": F.when(F.col("y") > 1.5, 0.7).otherwise(1.9)})
    packed, weighted = T.pack(df.withColumn("y", F.round("y")), cols, "y", ["id"]), T.pack(classed, cols, "hit", ["id"], weight="w")
    fits = lambda: [T.fit_forest(packed, 4, 5, 3, 7), T.fit_boosted(packed, 6, 3, 0.3), T.fit_forest(weighted, 4, 5, 3, 7, subset=2), T.fit_boosted(weighted, 6, 3, 0.3, logistic=True)]
    held = fits()
    monkeypatch.setattr(T, "HELD_ROWS", 0)
    monkeypatch.setattr(T, "NODES", 4)
    for one, other in zip(held, fits(), strict=True):
        assert (one.feature == other.feature).all() and np.allclose(one.value, other.value) and np.allclose(one.threshold, other.threshold)
        assert np.allclose(one.importance, other.importance) and one.importance.sum() == pytest.approx(1)


def test_late_residuals_of_a_dealt_table_make_the_same_trees(table, monkeypatch):
    df, cols, x, y = table
    monkeypatch.setattr(T, "HELD_ROWS", 0)
    packed = T.pack(df.withColumn("w", F.abs("y") + 0.1).withColumn("hit", (F.col("y") > 1.5).cast("double")), cols, "hit", ["id"], weight="w")
    late = T.fit_boosted(packed, 8, 3, 0.3, 5, logistic=True)
    monkeypatch.setattr(T, "LATE_ROWS", 0)
    each = T.fit_boosted(packed, 8, 3, 0.3, 5, logistic=True)
    assert (late.feature == each.feature).all() and np.allclose(late.value, each.value)


def test_class_trees_equal_mllib(spark, table):
    """On features of few values the logistic trees are MLlib's, and a forest of classes is as good as MLlib's."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rng = np.random.default_rng(2)
    a, b, c = rng.integers(0, 9, 3000), rng.integers(0, 7, 3000), rng.integers(0, 5, 3000)
    hit = rng.random(3000) < 1 / (1 + np.exp(-(0.6 * a - 0.9 * b + 0.3 * a * (c > 2))))
    rows = [(i, float(a[i]), float(b[i]), float(c[i]), float(hit[i]), 0.6 if hit[i] else 1.7) for i in range(3000)]
    df = VectorAssembler(inputCols=list("abc"), outputCol="features").transform(spark.createDataFrame(rows, "id int, a double, b double, c double, label double, w double").repartition(4))
    x = np.column_stack([a, b, c]).astype(float)
    packed = T.pack(df, [F.col(n) for n in "abc"], "label", ["id"], weight="w")
    theirs = lambda m: np.array([r[0] for r in m.transform(df).orderBy("id").select(vector_to_array("probability")[1]).collect()])
    boosted = T.fit_boosted(packed, 12, 3, 0.05, logistic=True)
    model = GBTClassifier(weightCol="w", maxIter=12, maxDepth=3, stepSize=0.05, seed=42).fit(df)
    assert np.abs(1 / (1 + np.exp(-2 * boosted.predict(x))) - theirs(model)).max() < 1e-6
    assert np.abs(boosted.importance - model.featureImportances.toArray()).max() < 1e-6
    forest = T.fit_forest(packed, 60, 6, 3, 42, subset=2)
    model = RandomForestClassifier(weightCol="w", numTrees=60, maxDepth=6, minInstancesPerNode=3, featureSubsetStrategy="sqrt", seed=42).fit(df)
    # MLlib merges sibling leaves of the same class, so its probabilities are coarser
    auc = lambda p: np.mean(np.sign(p[hit][:, None] - p[~hit][None]) / 2 + 0.5)
    assert auc(forest.predict(x)) > auc(theirs(model)) - 0.005 and np.abs(forest.predict(x) - theirs(model)).mean() < 0.06
    drawn = T.fit_forest(packed, 1, 3, 3, 42, subset=1)
    assert len({f for f in drawn.feature[0] if f >= 0}) > 1  # each node draws anew


def test_weighted_forest_equals_brute_force(spark, table):
    """Weights times bootstrap decide on splits and values; the least size of a leaf is in drawn rows."""
    df, cols, x, y = table
    hit = y > 1.5
    w = np.where(np.arange(700) % 3 == 0, 0.4, 1.3)
    classed = df.withColumns({"hit": (F.col("y") > 1.5).cast("double"), "w": F.when(F.col("id") % 3 == 0, 0.4).otherwise(1.3)})
    packed = T.pack(classed, cols, "hit", ["id"], weight="w")
    forest = T.fit_forest(packed, 3, 3, 1, 11)
    key = np.array([r[0] for r in spark.range(700).select(F.xxhash64("id")).collect()], np.int64)
    for t in range(3):
        same_tree(forest, t, plain_tree(x, hit.astype(float), w * T.poisson(key, t, 11), packed.cuts, 3, 1e-9))
    forest = T.fit_forest(packed, 6, 5, 40, 11, subset=2)
    for t in range(6):
        node = np.zeros(700, int)
        for _ in range(5):
            f = forest.feature[t, node]
            node = np.where(f < 0, node, 2 * node + 1 + (x[np.arange(700), np.maximum(f, 0)] > forest.threshold[t, node]))
        assert len(set(node)) > 2 and all(T.poisson(key, t, 11)[node == n].sum() >= 40 for n in set(node))
