import datetime as dt
import math

from ledgerline.operators import inventory as inv

P = "company_id int, product_id int, external_product_id string, name string, unit_cost double"
I = "company_id int, product_id int, warehouse_id int, record_date date, inventory_level double, safety_stock double"
S = ("company_id int, product_id int, sale_date date, quantity double, l_orderkey long, l_linenumber int, "
     "l_partkey long, l_suppkey long")
H = ("company_id int, product_id int, supplier_id long, planned_delivery date, actual_delivery date, quantity double")
U = "company_id int, supplier_id long, name string, lead_time_days double, reliability double"
D0 = dt.date(2026, 1, 1)


def _health(spark, products, invs, sales, ships, sups, **kw):
    out = inv.inventory_health(spark.createDataFrame(products, P), spark.createDataFrame(invs, I),
                               spark.createDataFrame(sales, S), spark.createDataFrame(ships, H),
                               spark.createDataFrame(sups, U), **kw)
    return {r["product_id"]: r for r in out.collect()}


def test_product_without_any_data_gets_zeros(spark):
    h = _health(spark, [(1, 1, "A", "A", 10.0)], [], [], [], [])[1]
    assert h["inventory_level"] == 0.0 and h["daily_demand"] == 0.0 and h["inventory_coverage_days"] is None
    assert h["lead_time_days"] == 14.0 and h["supplier_reliability"] == 0.85
    assert h["recommended_order_quantity"] == 0 and h["stockout_probability"] == 0.5  # 1/(1+e^0)


def test_formulas_against_hand_computation(spark):
    sales = [(1, 1, D0 + dt.timedelta(days=i), float(10 + i % 3), i, 1, 1, 1) for i in range(70)]
    ships = [(1, 1, 9, D0, D0 + dt.timedelta(days=1), 5.0), (1, 1, 9, D0 + dt.timedelta(days=80), None, 40.0)]
    h = _health(spark, [(1, 1, "A", "A", 10.0)], [(1, 1, 1, D0, 100.0, 0.0)], sales, ships,
                [(1, 9, "S9", 5.0, 0.9)])[1]
    last30 = [float(10 + i % 3) for i in range(40, 70)]
    last60 = [float(10 + i % 3) for i in range(10, 70)]
    daily = sum(last30) / 30
    m = sum(last60) / 60
    std = math.sqrt(sum((x - m) ** 2 for x in last60) / 59)
    safety = 1.65 * std * math.sqrt(5.0)
    assert h["daily_demand"] == round(daily, 2) and h["demand_std"] == round(std, 2)
    assert h["safety_stock"] == round(safety, 2) and h["incoming_quantity"] == 40.0
    assert h["next_arrival"] == D0 + dt.timedelta(days=80)
    assert h["recommended_order_quantity"] == math.ceil(max(0, daily * 30 + safety - 100 - 40))
    p = 1 / (1 + math.exp((100 + 40 - daily * 5 - safety) / max(1, daily * 2)))
    assert h["stockout_probability"] == round(p, 4)


def test_zero_lead_time_means_default_and_huge_stock_does_not_overflow(spark):
    h = _health(spark, [(1, 1, "A", "A", 1.0)], [(1, 1, 1, D0, 1e9, 0.0)], [], [(1, 1, 9, D0, None, 1.0)],
                [(1, 9, "S9", 0.0, None)])[1]
    assert h["lead_time_days"] == 14.0 and h["supplier_reliability"] == 0.85
    assert h["stockout_probability"] == 0.0 and h["overstock_probability"] == 1.0
    assert h["overstock_risk"] == "CRITICAL"


def test_two_warehouses_same_day(spark):
    invs = [(1, 1, 1, D0, 10.0, 0.0), (1, 1, 2, D0, 30.0, 0.0), (1, 1, 1, D0 - dt.timedelta(days=1), 99.0, 0.0)]
    assert _health(spark, [(1, 1, "A", "A", 1.0)], invs, [], [], [])[1]["inventory_level"] == 30.0
    summed = inv.latest_inventory(spark.createDataFrame(invs, I), sum_warehouses=True).first()
    assert summed["inventory_level"] == 40.0


def test_best_supplier_most_reliable_nulls_last(spark):
    ships = [(1, 1, 8, D0, D0, 1.0), (1, 1, 9, D0, D0, 1.0), (1, 1, 7, D0, D0, 1.0)]
    sups = [(1, 7, "S7", 3.0, None), (1, 8, "S8", 4.0, 0.7), (1, 9, "S9", 6.0, 0.95)]
    assert _health(spark, [(1, 1, "A", "A", 1.0)], [], [], ships, sups)[1]["supplier_id"] == 9


def test_delay_shifts_lead_and_arrival(spark):
    h = _health(spark, [(1, 1, "A", "A", 1.0)], [], [], [(1, 1, 9, D0, None, 1.0)], [(1, 9, "S9", 5.0, 0.9)],
                delay_days=2.5)[1]
    assert h["effective_lead_time_days"] == 7.5 and h["next_arrival"] == D0 + dt.timedelta(days=2)


def test_rollforward_matches_loop(spark):
    import random
    rnd = random.Random(3)
    sales = [(1, 1, D0 + dt.timedelta(days=rnd.randrange(40)), float(rnd.randrange(1, 30)), i, 1, 1, 1)
             for i in range(60)]
    ships = [(1, 1, 9, D0, D0 + dt.timedelta(days=rnd.randrange(40)), float(rnd.randrange(10, 80))) for _ in range(15)]
    out = inv.inventory_rollforward(spark.createDataFrame(sales, S), spark.createDataFrame(ships, H)).collect()
    got = {r["day"]: r["inventory_level"] for r in out}
    days = sorted(got)
    level = 0.0
    for d in days:
        deliv = sum(q for *_, a, q in ships if a == d)
        sold = sum(q for _, _, sd, q, *_ in sales if sd == d)
        level = max(0.0, level + deliv - sold)
        assert abs(got[d] - level) < 1e-9


def test_summary(spark):
    rows = inv.inventory_summary(inv.inventory_health(
        spark.createDataFrame([(1, 1, "A", "A", 1.0), (1, 2, "B", "B", 1.0)], P),
        spark.createDataFrame([(1, 1, 1, D0, 5.0, 0.0)], I), spark.createDataFrame([], S),
        spark.createDataFrame([], H), spark.createDataFrame([], U))).first()
    expect = (round(1 / (1 + math.exp(5.0)), 4) + 0.5) / 2    # 5 units, no demand vs nothing at all
    assert rows["products"] == 2 and rows["inventory_units"] == 5.0
    assert abs(rows["avg_stockout_probability"] - expect) <= 1e-4
