import datetime as dt

from pyspark.sql import functions as F

from ledgerline.operators import anomaly as anom
from ledgerline.operators import dashboard as dash
from ledgerline.operators import recommend as rec
from ledgerline.operators import scenario as scn
from ledgerline.operators import supplier as sup

D0 = dt.date(2026, 1, 1)
U = ("company_id int, supplier_id long, name string, lead_time_days double, reliability double, cost_index double, "
     "defect_rate double")
H = "company_id int, supplier_id long, planned_delivery date, actual_delivery date"


def test_scorecard_fallbacks(spark):
    sups = spark.createDataFrame([(1, 1, "NoShip", 5.0, None, None, None), (1, 2, "Zero", 0.0, 0.0, 0.0, 0.0),
                                  (1, 3, "Late", 4.0, 0.9, 1.5, 0.01)], U)
    ships = spark.createDataFrame([(1, 3, D0, D0 + dt.timedelta(days=2)), (1, 3, D0, D0), (1, 3, D0, None)], H)
    c = {r["supplier_id"]: r for r in sup.supplier_scorecard(sups, ships).collect()}
    # no shipments, reliability null: delay rate from the 0.85 default, reliability = 1 - delay rate
    assert c[1]["delay_rate"] == 0.15 and c[1]["reliability"] == 0.85 and c[1]["cost_index"] == 1.0
    # reliability 0 is falsy for the delay-rate default but kept as the reliability itself
    assert c[2]["delay_rate"] == 0.15 and c[2]["reliability"] == 0.0 and c[2]["risk_tier"] == "HIGH"
    assert c[3]["shipment_count"] == 3 and c[3]["completed_shipments"] == 2 and c[3]["delay_rate"] == 0.5
    assert c[3]["avg_delay_days"] == 1.0
    assert c[3]["risk_score"] == round((1 - 0.9) * 60 + 0.5 * 25 + 0.01 * 10 + 0.5 * 10, 1)


def test_top_suppliers_least_risky_first(spark):
    card = spark.createDataFrame([(1, i, float(10 - i)) for i in range(10)], "company_id int, supplier_id long, risk_score double")
    top = sup.top_suppliers(card, 6).orderBy("rank").collect()
    assert [r["supplier_id"] for r in top] == [9, 8, 7, 6, 5, 4]


def test_zscore_single_row_product_never_flags(spark):
    rows = [(1, 1, D0 + dt.timedelta(days=i), 10.0 + (i % 2)) for i in range(30)] + [(1, 1, D0 + dt.timedelta(days=40), 500.0)]
    rows += [(1, 2, D0, 1e6)]
    df = spark.createDataFrame(rows, "company_id int, product_id int, date date, quantity double")
    out = anom.zscore_anomalies(df).collect()
    assert [(r["product_id"], r["date"]) for r in out] == [(1, D0 + dt.timedelta(days=40))]
    assert out[0]["severity"] == "CRITICAL"


def test_scenario_grid_and_bounds(spark):
    inputs = spark.createDataFrame([(1, 1, 100.0, 10.0, 2.0, 5.0, 0.9, 0.0)],
                                   "company_id int, product_id int, inventory double, daily double, std double, "
                                   "lead double, reliability double, incoming double")
    inputs = inputs.withColumn("next_arrival", F.lit(None).cast("date"))
    sc = [{"scenario_id": "base"}, {"scenario_id": "double", "demand_multiplier": 2.0},
          {"scenario_id": "bad", "demand_multiplier": 9.0}]
    g = {r["scenario_id"]: r for r in scn.scenario_grid(inputs, sc).collect()}
    assert set(g) == {"base", "double"}
    assert g["base"]["stockout_probability_change"] == 0.0 and g["base"]["recommended_order_change"] == 0
    assert g["double"]["daily_demand"] == 20.0 and g["double"]["stockout_probability_change"] > 0
    rej = scn.scenario_rejects(inputs, sc).collect()
    assert [(r["scenario_id"], r["rejected_fields"]) for r in rej] == [("bad", "demand_multiplier")]


def test_recommendation_precedence_and_cap(spark):
    inv_rows = [(1, f"P{i:02d}", i, "CRITICAL" if i < 20 else "LOW", "CRITICAL", 0.9, 2.5, 10) for i in range(40)]
    health = spark.createDataFrame(inv_rows, "company_id int, product_name string, product_id int, stockout_risk string, "
                                             "overstock_risk string, stockout_probability double, "
                                             "inventory_coverage_days double, recommended_order_quantity long")
    card = spark.createDataFrame([(1, 5, "Bad supplier", 80.0, 0.5, "CRITICAL")],
                                 "company_id int, supplier_id long, name string, risk_score double, delay_rate double, "
                                 "risk_tier string")
    r = rec.merge_recommendations(rec.inventory_recommendations(health), rec.supplier_recommendations(card)) \
        .orderBy("rank").collect()
    assert len(r) == 30
    assert all(x["priority"] == "critical" for x in r[:21])
    assert r[0]["title"] == "Replenish P00" and r[0]["reason"] == "Stockout probability is 90% with 2.5 days of coverage."
    assert r[20]["type"] == "supplier"
    assert r[21]["title"].startswith("Review overstock of") and r[21]["priority"] == "medium"


def test_health_index_clamps(spark):
    df = spark.createDataFrame([(0, 0, 0), (50, 0, 0), (1, 2, 3)], "c int, h int, s int")
    vals = [r[0] for r in df.select(dash.supply_chain_health(F.col("c"), F.col("h"), F.col("s"))).collect()]
    assert vals == [100.0, 0.0, 88.0]
