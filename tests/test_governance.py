import datetime as dt

import pytest

from ledgerline.operators import governance as gov

C = "company_id int, name string"
S = "company_id int, product_id int, sale_date date, quantity double"
H = "company_id int, order_date date, actual_delivery date"
D0 = dt.date(2025, 1, 1)


def test_demand_sufficiency_reasons(spark):
    sales = [(1, p, D0 + dt.timedelta(days=i), 1.0) for p in range(10) for i in range(400)]
    sales += [(2, 1, D0 + dt.timedelta(days=i), 1.0) for i in range(50)]
    out = {r["company_id"]: r for r in gov.demand_sufficiency(
        spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], C), spark.createDataFrame(sales, S)).collect()}
    assert out[1]["is_sufficient"] and out[1]["reason"].startswith("4000 records over 399 days")
    assert not out[2]["is_sufficient"]
    assert out[2]["reason"] == ("Insufficient data for a company-specific model: needs >= 3000 records (has 50); "
                                "needs >= 180 days of history (has 49). Using base model.")
    assert out[3]["reason"] == "No sales history uploaded yet." and out[3]["record_count"] == 0


def test_shipment_sufficiency_counts_completed_only(spark):
    ships = [(1, D0 + dt.timedelta(days=i), D0 + dt.timedelta(days=i + 3)) for i in range(300)]
    ships += [(1, D0, None)] * 50 + [(2, D0, None)]
    out = {r["company_id"]: r for r in gov.shipment_sufficiency(
        spark.createDataFrame([(1, "a"), (2, "b")], C), spark.createDataFrame(ships, H)).collect()}
    assert out[1]["record_count"] == 300 and out[1]["is_sufficient"]
    assert out[2]["reason"] == "No completed shipment history uploaded yet."


def _registry(spark):
    t = dt.datetime
    rows = [(1, None, "demand", "base", t(2025, 1, 1), 1, 1, None, "p1"),
            (2, None, "demand", "base", t(2025, 6, 1), 1, 1, None, "p2"),
            (3, 1, "demand", "company", t(2025, 3, 1), 1, 1, None, "p3"),
            (4, 1, "demand", "company", t(2025, 7, 1), 1, 1, None, "p4"),
            (5, 2, "shipment_delay", "company", t(2025, 7, 1), 1, 1, None, "p5")]
    return spark.createDataFrame(rows, gov.REGISTRY_SCHEMA)


def test_registry_versions_and_status(spark):
    st = {r["registry_id"]: r for r in gov.registry_status(_registry(spark)).collect()}
    assert (st[1]["version"], st[1]["status"]) == ("v1", "archived")
    assert (st[2]["version"], st[2]["status"]) == ("v2", "active")
    assert (st[4]["version"], st[4]["status"]) == ("v2", "active")


def test_active_model_prefers_own_then_base(spark):
    comps = spark.createDataFrame([(1, "a"), (2, "b")], C)
    act = {r["company_id"]: r for r in gov.active_model(comps, _registry(spark), "demand").collect()}
    assert act[1]["registry_id"] == 4 and act[2]["registry_id"] == 2
    none = gov.active_model(comps, _registry(spark).where("company_id IS NOT NULL"), "shipment_delay").collect()
    assert [r["company_id"] for r in none] == [2]


def test_registry_listing_order(spark):
    comps = spark.createDataFrame([(1, "a"), (2, "b"), (9, "c")], C)
    ids = {}
    for r in gov.registry_listing(_registry(spark), comps).orderBy("listing_rank").collect():
        ids.setdefault(r["listed_for"], []).append(r["registry_id"])
    assert ids == {1: [4, 3, 2, 1], 2: [5, 2, 1], 9: [2, 1]}


def _two_tenants(spark):
    rows = [(1, p, D0 + dt.timedelta(days=i), float(10 + (i * 7 + p) % 5)) for p in range(8) for i in range(400)]
    rows += [(2, 1, D0 + dt.timedelta(days=i), float(3 + i % 4)) for i in range(120)]
    return spark.createDataFrame([(1, "a"), (2, "b")], C), spark.createDataFrame(rows, S)


@pytest.mark.parametrize("group_rows", [10 ** 6, 10])
def test_registry_driven_forecast(spark, tmp_path, group_rows):
    """G5/G6/G7 -> D11: tenant 1 has enough history for its own model (fitted in a group, or by the distributed learner),
    tenant 2 falls back to the base; one job serves both as scoring them one by one would."""
    from ledgerline.models import demand as dm
    from ledgerline.models import registry as mreg
    comps, sales = _two_tenants(spark)
    path, store = str(tmp_path / "registry"), str(tmp_path / "store")
    rows, outcomes = mreg.train_tenants(spark, comps, sales, store, n_estimators=3, group_rows=group_rows)
    out = {r["company_id"]: r for r in outcomes.collect()}
    assert out[1]["trained"] and not out[2]["trained"] and "Insufficient" in out[2]["reason"]
    base = mreg.train_base(spark, sales, None, None, "demand", n_estimators=3)
    assert (mreg.append_registry(spark, base, path), mreg.commit_registry(spark, rows, path)) == (None, 2)
    active = gov.active_model(comps, mreg.read_registry(spark, path), "demand")
    base_model, base_path = dm.load_model(spark, base[0][8]), base[0][8]
    models, means = mreg.stored_models([base_model], [base_path], mreg.tenant_models(spark, store))
    fc = dm.forecast_with_registry(sales, active, models, means, 7).collect()
    assert {r["company_id"]: r["model_source"] for r in fc} == {1: "company", 2: "base"} and len(fc) == (8 + 1) * 7
    own = models.where(models.model_path != base_path).first()
    one = dm.DemandModel(own["name"], dm.forest_of(bytes(own["forest"])), own["origin"], means.where(means.model_path == own["model_path"]).drop("model_path"), own["global_mean"])
    alone = [r for c, m in ((1, one), (2, base_model)) for r in dm.forecast_products(sales.where(sales.company_id == c), m, 7).collect()]
    key = lambda r: (r["company_id"], r["product_id"], r["step"], r["date"], r["predicted_quantity"], r["last_actual_quantity"])
    assert sorted(map(key, fc)) == sorted(map(key, alone))


def test_a_failing_tenant_keeps_to_itself(spark, tmp_path, monkeypatch):
    from ledgerline.models import registry as mreg
    comps, sales = _two_tenants(spark)
    from pyspark.sql import functions as F
    bad = sales.where("company_id = 1").withColumn("company_id", F.lit(2)).withColumn("quantity", F.lit(float("nan")))
    sales = sales.where("company_id = 1").unionByName(bad)
    rows, outcomes = mreg.train_tenants(spark, comps, sales, str(tmp_path / "s"), n_estimators=2)
    assert {r["company_id"] for r in rows.collect()} >= {1} and outcomes.count() == 2


def test_concurrent_commits_get_different_versions(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from ledgerline.models import registry as mreg
    path = str(tmp_path / "registry")
    row = lambda i: [(i, None, "demand", "base", dt.datetime(2025, 1, 1), 1, 1, None, f"p{i}")]
    assert mreg.read_registry(spark, path).count() == 0
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: mreg.append_registry(spark, row(i), path), range(4)))
    st = gov.registry_status(mreg.read_registry(spark, path)).collect()
    assert sorted(r["version"] for r in st) == ["v1", "v2", "v3", "v4"] and [r["status"] for r in st].count("active") == 1
    (tmp_path / "registry" / "log" / "000000009").touch()  # a writer that was lost after it took its number
    mreg.append_registry(spark, row(9), path)
    st = {r["model_path"]: r["version"] for r in gov.registry_status(mreg.read_registry(spark, path)).collect()}
    assert len(st) == 5 and st["p9"] == "v5"


def test_ensure_model(spark, tmp_path):
    from ledgerline.models import registry as mreg
    comps, sales = _two_tenants(spark)
    path, store = str(tmp_path / "registry"), str(tmp_path / "store")
    calls = []

    def base():
        calls.append("base")
        return mreg.train_base(spark, sales, None, None, "demand", n_estimators=2)

    def own(some):
        calls.append(sorted(r["company_id"] for r in some.collect()))
        return mreg.train_tenants(spark, some, sales, f"{store}{len(calls)}", n_estimators=2)

    for _ in range(2):
        got = {r["company_id"]: r["model_source"] for r in mreg.ensure_model(spark, comps, "demand", base, own, path).collect()}
        assert got == {1: "company", 2: "base"}
    assert calls == [[1, 2], "base", [2]]


def test_tenants_sales_are_summed_before_they_meet(spark, monkeypatch):
    from ledgerline.models import demand as dm

    seen = []
    whole = dm.dfe.demand_feature_matrix
    monkeypatch.setattr(dm.dfe, "demand_feature_matrix", lambda sales, *a: seen.append(sales) or whole(sales, *a))
    comps, sales = _two_tenants(spark)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where sizes aren't known beforehand
    try:
        made = dm.train_tenant_models(sales, comps.select("company_id"), n_estimators=2)
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (*seen, made)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert len(seen) == 1 and "Exchange hashpartitioning(company_id" not in plans[0]  # no sale travels by its tenant alone
    assert "lag(" not in plans[1]  # features are made once
    assert made.where("problem IS NULL").count() == 2
