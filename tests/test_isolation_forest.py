import datetime as dt

import numpy as np

from ledgerline.operators import isolation_forest as iso


def test_isolation_forest_flags_outliers(spark):
    rng = np.random.default_rng(0)
    rows = []
    for c in (1, 2):
        for i in range(400):
            rows.append((c, f"{c}-{i}", dt.date(2026, 1, 1), float(rng.normal(500, 20)), float(rng.normal(100, 5)),
                         float(rng.normal(50, 3))))
        rows.append((c, f"{c}-out", dt.date(2026, 1, 1), 5000.0, 900.0, 400.0))
    rows.append((3, "3-0", dt.date(2026, 1, 1), 1.0, 1.0, 1.0))   # tenant below 15 rows: not scored
    df = spark.createDataFrame(rows, "company_id int, shipment_key string, order_date date, distance_km double, "
                                     "weight_kg double, quantity double")
    out = iso.shipment_anomalies(df).collect()
    keys = {r["entity_id"] for r in out}
    assert "1-out" in keys and "2-out" in keys and not any(k.startswith("3-") for k in keys)
    for c in (1, 2):
        n = sum(1 for r in out if r["company_id"] == c)
        assert 10 <= n <= 30          # about 5 % of 401
    top = max(out, key=lambda r: r["score"])
    assert top["entity_id"].endswith("out") and top["severity"] in ("HIGH", "CRITICAL")


def test_c_factor():
    assert iso.c_factor([1])[0] == 0 and iso.c_factor([2])[0] == 1
    assert abs(iso.c_factor([256])[0] - (2 * (np.log(255) + iso.EULER) - 2 * 255 / 256)) < 1e-12


def _frame(spark, n, parts):
    rng = np.random.default_rng(4)
    rows = [(1 + i % 2, f"k{i}", dt.date(2026, 1, 1), float(rng.normal(500, 20)), float(rng.normal(100, 5)), float(rng.integers(1, 9))) for i in range(n)]
    return spark.createDataFrame(rows, "company_id int, shipment_key string, order_date date, distance_km double, weight_kg double, "
                                       "quantity double").repartition(parts)


def test_same_rows_are_flagged_on_any_layout(spark, monkeypatch):
    monkeypatch.setattr(iso, "BUCKET_ROWS", 300)
    a, b = (sorted(map(str, iso.shipment_anomalies(_frame(spark, 3000, p)).collect())) for p in (2, 9))
    assert a == b and len(a) > 100


def test_each_tree_has_its_rows(spark):
    trees = iso.fit_forests(_frame(spark, 3000, 4)).collect()
    assert len(trees) == 200 and {t["psi"] for t in trees} == {256}


def test_quantile_is_exact(spark):
    rng = np.random.default_rng(1)
    x = {c: rng.integers(0, 40, n) / 40.0 for c, n in ((1, 501), (2, 1000), (3, 17), (4, 1))}
    df = spark.createDataFrame([(c, float(v)) for c, vs in x.items() for v in vs], "company_id int, if_score double")
    for share in (0.05, 0.5, 0.0, 1.0):
        got = {r["company_id"]: r["_offset"] for r in iso.score_quantile(df, share).collect()}
        assert all(abs(got[c] - np.quantile(v, share)) < 1e-12 for c, v in x.items())


def test_path_lengths_equal_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 3)).round(1)
    x[5, 1] = np.nan
    grown = [iso.grow_tree(x[rng.permutation(700)[:256]], np.random.default_rng(t), 8) for t in range(20)] + [iso.grow_tree(x[:1], rng, 1)]
    forest = [tuple(np.asarray(a) for a in t) for t in grown]

    def walk(tree, row):
        feat, thr, left, right, leaf = tree
        at = 0
        while feat[at] >= 0:
            at = left[at] if row[feat[at]] < thr[at] else right[at]
        return leaf[at]

    want = np.array([sum(walk(t, row) for t in forest) / len(forest) for row in x])
    for chunk in (64, 8192):
        iso.CHUNK_ROWS, before = chunk, iso.CHUNK_ROWS
        try:
            assert np.abs(iso._path_lengths(forest, x) - want).max() < 1e-12
        finally:
            iso.CHUNK_ROWS = before


def test_rows_meet_small_tables_by_broadcast(spark, monkeypatch):
    """Tenants' counts and offsets don't sort the rows by tenant, and no tree is drawn in an interpreted array function."""
    from pyspark.sql import functions as F
    df, asked = _frame(spark, 300, 2), []
    broadcast = F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda d: asked.append(sorted(d.columns)) or broadcast(d))
    plan = iso.fit_forests(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan.lower() and "lambdafunction" not in plan.lower() and "strategy=broadcast" in plan
    iso.shipment_anomalies(df)
    assert asked.count(["_buckets", "company_id"]) == 2 and ["_offset", "company_id"] in asked
