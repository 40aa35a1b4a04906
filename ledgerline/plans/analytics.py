"""Registered analytics queries (inventory, supplier, anomaly, scenario, recommendation, KPI)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions.exprs import DELAY_TIERS, tier
from ledgerline.operators import inventory as inv
from ledgerline.plans.oracle_adapters import oracle
from ledgerline.plans.register import query

# ----------------------------------------------------------------------------------------
# Shared oracle fragments
# ----------------------------------------------------------------------------------------
SQL_LATEST = """
latest AS (
  SELECT company_id, product_id, inventory_level, record_date AS inventory_date FROM (
    SELECT *, row_number() OVER (PARTITION BY company_id, product_id
                                 ORDER BY record_date DESC, warehouse_id DESC) AS rn
    FROM inventory_records) t WHERE rn = 1)"""

SQL_DEMAND = """
dem AS (
  SELECT company_id, product_id,
         avg(CASE WHEN rn <= 30 THEN quantity END) AS daily_demand,
         coalesce(stddev_samp(CASE WHEN rn <= 60 THEN quantity END), 0.0) AS demand_std,
         count(CASE WHEN rn <= 60 THEN quantity END) AS demand_records
  FROM (SELECT company_id, product_id, quantity,
               row_number() OVER (PARTITION BY company_id, product_id
                                  ORDER BY sale_date DESC, l_orderkey DESC, l_linenumber DESC,
                                           l_partkey DESC, l_suppkey DESC) AS rn
        FROM sales) t
  WHERE rn <= 60 GROUP BY company_id, product_id)"""

SQL_BEST = """
bs AS (
  SELECT company_id, product_id, supplier_id, supplier_name, supplier_lead_time_days, supplier_reliability_raw FROM (
    SELECT p.company_id, p.product_id, s.supplier_id, s.name AS supplier_name,
           s.lead_time_days AS supplier_lead_time_days, s.reliability AS supplier_reliability_raw,
           row_number() OVER (PARTITION BY p.company_id, p.product_id
                              ORDER BY s.reliability DESC NULLS LAST, s.supplier_id ASC) AS rn
    FROM (SELECT DISTINCT company_id, product_id, supplier_id FROM shipments WHERE supplier_id IS NOT NULL) p
    JOIN suppliers s ON p.company_id = s.company_id AND p.supplier_id = s.supplier_id) t
  WHERE rn = 1)"""

SQL_INCOMING = """
inc AS (
  SELECT company_id, product_id, sum(coalesce(quantity, 0.0)) AS incoming_quantity,
         min(planned_delivery) AS next_arrival, count(*) AS incoming_shipments
  FROM shipments WHERE actual_delivery IS NULL GROUP BY company_id, product_id)"""

SQL_INPUTS = """
inp AS (
  SELECT p.company_id, p.product_id, p.external_product_id, p.name AS product_name, p.unit_cost, p.category,
         coalesce(l.inventory_level, 0.0) AS inventory,
         coalesce(d.daily_demand, 0.0) AS daily,
         coalesce(d.demand_std, 0.0) AS std,
         b.supplier_id, b.supplier_name,
         CASE WHEN b.supplier_id IS NOT NULL THEN coalesce(nullif(b.supplier_lead_time_days, 0), 14.0)
              ELSE 14.0 END AS lead,
         coalesce(b.supplier_reliability_raw, 0.85) AS reliability,
         coalesce(i.incoming_quantity, 0.0) AS incoming,
         i.next_arrival
  FROM products p
  LEFT JOIN latest l ON p.company_id = l.company_id AND p.product_id = l.product_id
  LEFT JOIN dem d ON p.company_id = d.company_id AND p.product_id = d.product_id
  LEFT JOIN bs b ON p.company_id = b.company_id AND p.product_id = b.product_id
  LEFT JOIN inc i ON p.company_id = i.company_id AND p.product_id = i.product_id)"""


def sql_metrics(delay: str = "0.0", src: str = "inp") -> str:
    return f"""
m1 AS (SELECT *, CAST({delay} AS DOUBLE) AS delay_days, greatest(1.0, lead + CAST({delay} AS DOUBLE)) AS eff_lead
       FROM {src}),
m2 AS (SELECT *, greatest(0.0, 1.65 * std * sqrt(eff_lead)) AS safety, daily * eff_lead AS horizon FROM m1),
m AS (
  SELECT *,
    CASE WHEN daily > 0 THEN inventory / daily END AS coverage,
    daily * eff_lead + safety AS reorder_point,
    greatest(0.0, horizon + safety - inventory - incoming) AS shortage,
    least(greatest(1.0 / (1.0 + exp((inventory + incoming - horizon - safety) / greatest(1.0, daily * 2))), 0.0), 1.0)
      AS stockout_p,
    least(greatest(greatest(0.0, inventory / greatest(1.0, daily * 45) - 1.0) * 0.75, 0.0), 1.0) AS overstock_p,
    CAST(ceil(greatest(0.0, daily * 30 + safety - inventory - incoming)) AS BIGINT) AS order_qty,
    CASE WHEN delay_days <> 0 THEN next_arrival + CAST(floor(delay_days) AS INT) ELSE next_arrival END
      AS next_arrival_delayed
  FROM m2)"""


def sql_tier(x: str, t=(0.85, 0.65, 0.35)) -> str:
    return (f"CASE WHEN {x} >= {t[0]} THEN 'CRITICAL' WHEN {x} >= {t[1]} THEN 'HIGH' "
            f"WHEN {x} >= {t[2]} THEN 'MEDIUM' ELSE 'LOW' END")


SQL_PRESENT = f"""
  SELECT company_id, product_id, external_product_id, product_name,
         round(round(inventory, 9), 2) AS inventory_level, round(round(daily, 9), 2) AS daily_demand, round(round(std, 9), 2) AS demand_std,
         round(round(coverage, 9), 1) AS inventory_coverage_days, CAST(supplier_id AS BIGINT) AS supplier_id, supplier_name,
         round(round(reliability, 9), 3) AS supplier_reliability, round(round(lead, 9), 1) AS lead_time_days,
         round(round(delay_days, 9), 1) AS simulated_delay_days, round(round(eff_lead, 9), 1) AS effective_lead_time_days,
         round(round(incoming, 9), 2) AS incoming_quantity, next_arrival_delayed AS next_arrival,
         round(round(safety, 9), 2) AS safety_stock, round(round(reorder_point, 9), 2) AS reorder_point,
         order_qty AS recommended_order_quantity,
         round(round(stockout_p, 9), 4) AS stockout_probability, {sql_tier('stockout_p')} AS stockout_risk,
         round(round(shortage, 9), 2) AS expected_shortage,
         round(round(overstock_p, 9), 4) AS overstock_probability, {sql_tier('overstock_p')} AS overstock_risk,
         category, '{inv.ASSUMPTIONS}' AS assumptions
  FROM m"""

SQL_HEALTH_CTES = ",".join([SQL_LATEST, SQL_DEMAND, SQL_BEST, SQL_INCOMING, SQL_INPUTS, sql_metrics()])
HEALTH_ADAPTERS = "sales,products,suppliers,shipments,inventory_records"


def _health(d, **kw):
    return inv.inventory_health(d.products, d.inventory_records, d.sales, d.shipments, d.suppliers, **kw)


# ----------------------------------------------------------------------------------------
# Step 1: inventory health
# ----------------------------------------------------------------------------------------
@query("inventory_health", oracle(HEALTH_ADAPTERS, SQL_HEALTH_CTES + SQL_PRESENT))
def q_inventory_health(d):
    """Every product of every tenant with stock, demand, supply and risk fields."""
    return _health(d)


@query("latest_inventory", oracle("products,inventory_records", SQL_LATEST + "\nSELECT * FROM latest"))
def q_latest_inventory(d):
    """Newest inventory record per product (ties: warehouse id descending)."""
    return inv.latest_inventory(d.inventory_records)


@query("recent_demand", oracle("sales", SQL_DEMAND + """
SELECT company_id, product_id, round(daily_demand, 6) AS daily_demand, round(demand_std, 6) AS demand_std,
       demand_records FROM dem"""))
def q_recent_demand(d):
    """Mean of the last 30 and sample std of the last 60 sales records per product."""
    r = inv.recent_demand(d.sales)
    return r.select("company_id", "product_id", F.round("daily_demand", 6).alias("daily_demand"),
                    F.round("demand_std", 6).alias("demand_std"), "demand_records")


@query("best_supplier", oracle("shipments,suppliers", SQL_BEST + "\nSELECT * FROM bs"))
def q_best_supplier(d):
    """Most reliable supplier that shipped each product."""
    return inv.best_supplier(d.shipments, d.suppliers)


@query("incoming_supply", oracle("shipments", SQL_INCOMING + """
SELECT company_id, product_id, round(incoming_quantity, 6) AS incoming_quantity, next_arrival, incoming_shipments
FROM inc"""))
def q_incoming_supply(d):
    """Open (undelivered) shipment quantity and next planned arrival per product."""
    r = inv.incoming_supply(d.shipments)
    return r.select("company_id", "product_id", F.round("incoming_quantity", 6).alias("incoming_quantity"),
                    "next_arrival", "incoming_shipments")


SQL_HEALTH_VIEW = SQL_HEALTH_CTES + ",\nh AS (" + SQL_PRESENT + ")"

# ----------------------------------------------------------------------------------------
# Step 2: summaries, supply, suppliers, anomalies, scenarios, recommendations, KPIs
# ----------------------------------------------------------------------------------------
from ledgerline.operators import anomaly as anom  # noqa: E402
from ledgerline.operators import dashboard as dash  # noqa: E402
from ledgerline.operators import governance as gov  # noqa: E402
from ledgerline.operators import recommend as rec  # noqa: E402
from ledgerline.operators import scenario as scn  # noqa: E402
from ledgerline.operators import supplier as sup  # noqa: E402

SQL_SUMMARY = """
summary AS (
  SELECT company_id, count(*) AS products,
         count(CASE WHEN stockout_risk IN ('HIGH', 'CRITICAL') THEN 1 END) AS stockout_high,
         count(CASE WHEN overstock_risk IN ('HIGH', 'CRITICAL') THEN 1 END) AS overstock_high,
         round(sum(inventory_level), 2) AS inventory_units,
         round(avg(stockout_probability), 4) AS avg_stockout_probability
  FROM h GROUP BY company_id)"""


@query("inventory_summary", oracle(HEALTH_ADAPTERS, SQL_HEALTH_VIEW + "," + SQL_SUMMARY + "\nSELECT * FROM summary"))
def q_inventory_summary(d):
    """Per-company inventory rollup."""
    return inv.inventory_summary(_health(d))


SQL_DELIVERIES = """
deliv AS (SELECT company_id, product_id, actual_delivery AS day, sum(coalesce(quantity, 0.0)) AS delivered
          FROM shipments WHERE actual_delivery IS NOT NULL GROUP BY company_id, product_id, actual_delivery)"""


@query("deliveries_daily", oracle("shipments", SQL_DELIVERIES + """
SELECT company_id, product_id, day, round(delivered, 6) AS delivered FROM deliv"""))
def q_deliveries_daily(d):
    """Arrived quantity per product and delivery day."""
    r = inv.deliveries_daily(d.shipments)
    return r.select("company_id", "product_id", "day", F.round("delivered", 6).alias("delivered"))


@query("inventory_rollforward", oracle("sales,shipments", SQL_DELIVERIES + """,
sold AS (SELECT company_id, product_id, sale_date AS day, sum(quantity) AS sold FROM sales
         GROUP BY company_id, product_id, sale_date),
mv AS (SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.product_id, b.product_id) AS product_id,
              coalesce(a.day, b.day) AS day, coalesce(a.delivered, 0.0) AS delivered, coalesce(b.sold, 0.0) AS sold
       FROM deliv a FULL OUTER JOIN sold b
         ON a.company_id = b.company_id AND a.product_id = b.product_id AND a.day = b.day),
s1 AS (SELECT *, sum(delivered - sold) OVER (PARTITION BY company_id, product_id ORDER BY day
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM mv),
s2 AS (SELECT *, min(s) OVER (PARTITION BY company_id, product_id ORDER BY day
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM s1)
SELECT company_id, product_id, day, round(delivered, 6) AS delivered, round(sold, 6) AS sold,
       round(s - least(0.0, m), 6) AS inventory_level
FROM s2"""))
def q_inventory_rollforward(d):
    """Daily inventory roll-forward I_t = max(0, I_{t-1} + delivered - sold) from an empty start."""
    r = inv.inventory_rollforward(d.sales, d.shipments)
    return r.select("company_id", "product_id", "day", F.round("delivered", 6).alias("delivered"),
                    F.round("sold", 6).alias("sold"), F.round("inventory_level", 6).alias("inventory_level"))


SQL_SCORECARD = """
sst AS (
  SELECT company_id, supplier_id, count(*) AS shipment_count,
         count(CASE WHEN actual_delivery IS NOT NULL AND planned_delivery IS NOT NULL THEN 1 END) AS completed_shipments,
         avg(CASE WHEN actual_delivery IS NOT NULL AND planned_delivery IS NOT NULL
                  THEN CASE WHEN actual_delivery - planned_delivery > 0 THEN 1.0 ELSE 0.0 END END) AS obs_delay_rate,
         avg(CASE WHEN actual_delivery IS NOT NULL AND planned_delivery IS NOT NULL
                  THEN CAST(greatest(actual_delivery - planned_delivery, 0) AS DOUBLE) END) AS obs_avg_delay
  FROM shipments WHERE supplier_id IS NOT NULL GROUP BY company_id, supplier_id),
sr1 AS (
  SELECT s.*, t.shipment_count, t.completed_shipments,
         CASE WHEN coalesce(t.completed_shipments, 0) > 0 THEN t.obs_delay_rate
              ELSE greatest(0.0, 1.0 - coalesce(nullif(s.reliability, 0), 0.85)) END AS delay_rate,
         CASE WHEN coalesce(t.completed_shipments, 0) > 0 THEN t.obs_avg_delay ELSE 0.0 END AS avg_delay
  FROM suppliers s LEFT JOIN sst t ON s.company_id = t.company_id AND s.supplier_id = t.supplier_id),
sr2 AS (
  SELECT *, coalesce(reliability, greatest(0.0, 1.0 - delay_rate)) AS rel,
         coalesce(nullif(defect_rate, 0), 0.0) AS defect, coalesce(nullif(cost_index, 0), 1.0) AS cost
  FROM sr1),
sr AS (
  SELECT *, least(greatest((1.0 - rel) * 60 + delay_rate * 25 + defect * 100 * 0.1 + greatest(0.0, cost - 1) * 10,
                           0.0), 100.0) AS risk
  FROM sr2),
sc AS (
  SELECT company_id, CAST(supplier_id AS BIGINT) AS supplier_id, name,
         round(coalesce(nullif(lead_time_days, 0), 0.0), 1) AS lead_time_days, round(round(rel, 9), 3) AS reliability,
         round(round(cost, 9), 3) AS cost_index, round(round(defect, 9), 4) AS defect_rate,
         coalesce(shipment_count, 0) AS shipment_count, coalesce(completed_shipments, 0) AS completed_shipments,
         round(round(delay_rate, 9), 4) AS delay_rate, round(round(avg_delay, 9), 2) AS avg_delay_days, round(round(risk, 9), 1) AS risk_score,
         CASE WHEN risk >= 70 THEN 'CRITICAL' WHEN risk >= 45 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM'
              ELSE 'LOW' END AS risk_tier
  FROM sr)"""


@query("supplier_scorecard", oracle("suppliers,shipments", SQL_SCORECARD + "\nSELECT * FROM sc"))
def q_supplier_scorecard(d):
    """Supplier delay statistics, risk score and tier for every supplier."""
    return sup.supplier_scorecard(d.suppliers, d.shipments)


@query("top_suppliers", oracle("suppliers,shipments", SQL_SCORECARD + """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY risk_score, supplier_id) AS rank
               FROM sc) t WHERE rank <= 6"""))
def q_top_suppliers(d):
    """K5: the 6 least risky suppliers per company."""
    return sup.top_suppliers(sup.supplier_scorecard(d.suppliers, d.shipments), 6)


@query("delay_by_reliability_band", oracle("suppliers,shipments", """
SELECT h.company_id,
       CASE WHEN s.reliability < 0.8 THEN 'low' WHEN s.reliability > 0.93 THEN 'high' ELSE 'mid' END
         AS reliability_band,
       count(*) AS shipments, round(avg(CAST(h.actual_delivery - h.planned_delivery AS DOUBLE)), 6) AS mean_delay_days
FROM shipments h JOIN suppliers s ON h.company_id = s.company_id AND h.supplier_id = s.supplier_id
WHERE h.actual_delivery IS NOT NULL
GROUP BY 1, 2"""))
def q_delay_by_reliability_band(d):
    """Mean delay of completed shipments by supplier reliability band (<0.8, mid, >0.93)."""
    r = sup.delay_by_reliability_band(d.shipments, d.suppliers)
    return r.select("company_id", "reliability_band", "shipments", F.round("mean_delay_days", 6).alias("mean_delay_days"))


def sql_zscore(rec_cte: str, groups: str, record_expr: str, entity: str) -> str:
    join_on = " AND ".join(f"r.{g.strip()} = s.{g.strip()}" for g in groups.split(","))
    sel = ", ".join(f"r.{g.strip()}" for g in groups.split(","))
    return f"""{rec_cte},
zst AS (SELECT {groups}, avg(quantity) AS mu, stddev_samp(quantity) AS sd FROM rec GROUP BY {groups}),
zz AS (SELECT r.*, abs((r.quantity - s.mu) / (s.sd + 1e-9)) AS abs_z FROM rec r JOIN zst s ON {join_on}),
za AS (
  SELECT {sel.replace('r.', '')}, 'product' AS entity_type, CAST({entity} AS VARCHAR) AS entity_id,
         CAST({record_expr} AS VARCHAR) AS record_id, CAST(date AS DATE) AS date, 'demand' AS metric,
         round(quantity, 2) AS value, round(abs_z / 10.0, 4) AS score,
         CASE WHEN abs_z / 10.0 > 0.4 THEN 'CRITICAL' WHEN abs_z / 10.0 > 0.35 THEN 'HIGH' ELSE 'MEDIUM' END
           AS severity,
         '{anom.DEMAND_EXPLANATION.replace("'", "''")}' AS explanation
  FROM zz WHERE abs_z > 3)"""


SQL_DEMAND_Z = sql_zscore("""
rec AS (SELECT company_id, product_id, sale_date AS date, sum(quantity) AS quantity FROM sales
        GROUP BY company_id, product_id, sale_date)""", "company_id, product_id", "date", "product_id")


@query("demand_zscore_anomalies", oracle("sales", SQL_DEMAND_Z + "\nSELECT * FROM za"))
def q_demand_zscore_anomalies(d):
    """A1: daily product demand with |z| > 3 against the product's own history."""
    return anom.zscore_anomalies(anom.daily_product_demand(d.sales))


@query("event_zscore_anomalies", oracle("event_metric", sql_zscore("""
rec AS (SELECT product_id, date, quantity, event_id FROM event_metric)""", "product_id", "event_id", "product_id")
                                        + "\nSELECT * FROM za"))
def q_event_zscore_anomalies(d):
    """A1 on the event stream: event values with |z| > 3 within their event type."""
    return anom.zscore_anomalies(d.event_metric, group_cols=("product_id",), record_col="event_id")


# A fixed catalogue of what-if scenarios applied to every product (two violate the bounds on purpose).
SCENARIOS = [
    {"scenario_id": "baseline"},
    {"scenario_id": "demand_up_20", "demand_multiplier": 1.2},
    {"scenario_id": "demand_down_30", "demand_multiplier": 0.7},
    {"scenario_id": "delay_7", "delay_days": 7.0},
    {"scenario_id": "stock_cut_500", "inventory_delta": -500.0},
    {"scenario_id": "slow_lane", "lead_time_delta": 10.0, "incoming_delta": 200.0, "reorder_delta": 50.0},
    {"scenario_id": "demand_x9", "demand_multiplier": 9.0},
    {"scenario_id": "negative_delay", "delay_days": -3.0, "lead_time_delta": 400.0},
]


def _sql_scenarios() -> str:
    rows = []
    for s in SCENARIOS:
        vals = [f"'{s['scenario_id']}'"] + [f"CAST({float(s.get(k, dflt))} AS DOUBLE)"
                                            for k, (dflt, _, _) in scn.SCENARIO_FIELDS.items()]
        rows.append("(" + ", ".join(vals) + ")")
    cols = ", ".join(["scenario_id"] + list(scn.SCENARIO_FIELDS))
    return f"scen AS (SELECT * FROM (VALUES {', '.join(rows)}) AS v({cols}))"


def _sql_violations(p: str = "s.") -> str:
    parts = [f"CASE WHEN NOT ({p}{k} BETWEEN {lo} AND {hi}) THEN '{k}' END" for k, (_, lo, hi) in
             scn.SCENARIO_FIELDS.items()]
    return "concat_ws(',', " + ", ".join(parts) + ")"


SQL_SCEN_BASE = SQL_HEALTH_CTES + ",\n" + _sql_scenarios() + f""",
grid AS (SELECT m.*, s.scenario_id, s.demand_multiplier, s.inventory_delta, s.delay_days AS s_delay,
                s.lead_time_delta, s.incoming_delta, s.reorder_delta, {_sql_violations()} AS rejected_fields
         FROM m CROSS JOIN scen s)"""


def _inputs(d):
    return inv.inventory_inputs(d.products, d.inventory_records, d.sales, d.shipments, d.suppliers)


@query("scenario_grid", oracle(HEALTH_ADAPTERS, SQL_SCEN_BASE + """,
g1 AS (
  SELECT company_id, product_id, scenario_id, std, stockout_p AS base_stockout_p, order_qty AS base_order_qty,
         reorder_delta, daily * greatest(0.0, demand_multiplier) AS s_daily,
         greatest(0.0, inventory + inventory_delta) AS s_inv, greatest(0.0, incoming + incoming_delta) AS s_inc,
         greatest(1.0, lead + lead_time_delta + s_delay) AS s_lead
  FROM grid WHERE rejected_fields = ''),
g2 AS (SELECT *, greatest(0.0, 1.65 * std * sqrt(s_lead)) AS s_safety, s_daily * s_lead AS s_horizon FROM g1),
g3 AS (
  SELECT *, 1.0 / (1.0 + exp((s_inv + s_inc - s_horizon - s_safety) / greatest(1.0, s_daily * 2))) AS s_stockout,
         CAST(ceil(greatest(0.0, s_daily * 30 + s_safety - s_inv - s_inc + reorder_delta)) AS BIGINT) AS s_order,
         least(greatest(greatest(0.0, s_inv / greatest(1.0, s_daily * 45) - 1) * 0.75, 0.0), 1.0) AS s_overstock
  FROM g2)
SELECT company_id, product_id, scenario_id, round(round(s_inv, 9), 2) AS inventory_level, round(round(s_daily, 9), 2) AS daily_demand,
       round(round(s_inc, 9), 2) AS incoming_quantity, round(round(s_lead, 9), 2) AS effective_lead_time_days,
       round(round(s_stockout, 9), 4) AS stockout_probability, """ + sql_tier("s_stockout") + """ AS stockout_risk,
       round(round(s_overstock, 9), 4) AS overstock_probability, """ + sql_tier("s_overstock") + """ AS overstock_risk,
       s_order AS recommended_order_quantity,
       round(round(s_stockout - base_stockout_p, 9), 4) + 0.0 AS stockout_probability_change,
       s_order - base_order_qty AS recommended_order_change
FROM g3"""))
def q_scenario_grid(d):
    """R2: every product under every valid what-if scenario of the catalogue, with deltas."""
    return scn.scenario_grid(_inputs(d), SCENARIOS)


@query("scenario_rejects", oracle(HEALTH_ADAPTERS, SQL_SCEN_BASE + """
SELECT company_id, product_id, scenario_id, rejected_fields FROM grid WHERE rejected_fields <> ''"""))
def q_scenario_rejects(d):
    """(product, scenario) requests outside the accepted parameter bounds."""
    return scn.scenario_rejects(_inputs(d), SCENARIOS)


def _supplier_expected_delay(d):
    """Expected delay of an open shipment = its supplier's mean positive delay so far."""
    st = sup.shipment_stats(d.shipments)
    return st.select("company_id", "supplier_id", F.coalesce("obs_avg_delay", F.lit(0.0)).alias("expected_delay_days"))


@query("shipment_impact_fixed_delay", oracle(HEALTH_ADAPTERS, SQL_LATEST + "," + SQL_DEMAND + "," + SQL_BEST + ","
                                             + SQL_INCOMING + "," + SQL_INPUTS + "," + SQL_SCORECARD + """,
fl AS (SELECT h.company_id, h.product_id, h.shipment_key, h.supplier_id AS shipment_supplier_id,
              coalesce(t.obs_avg_delay, 0.0) AS expected_delay_days
       FROM shipments h LEFT JOIN sst t ON h.company_id = t.company_id AND h.supplier_id = t.supplier_id
       WHERE h.actual_delivery IS NULL),
fi AS (SELECT fl.shipment_key, fl.shipment_supplier_id, fl.expected_delay_days, inp.*
       FROM fl JOIN inp ON fl.company_id = inp.company_id AND fl.product_id = inp.product_id),
""" + sql_metrics("coalesce(expected_delay_days, 0.0)", "fi").lstrip().lstrip(",") + """
SELECT company_id, product_id, shipment_key, shipment_supplier_id AS supplier_id,
       round(round(delay_days, 9), 1) AS simulated_delay_days, round(round(eff_lead, 9), 1) AS effective_lead_time_days,
       next_arrival_delayed AS next_arrival, round(round(safety, 9), 2) AS safety_stock, round(round(reorder_point, 9), 2) AS reorder_point,
       order_qty AS recommended_order_quantity, round(round(stockout_p, 9), 4) AS stockout_probability,
       """ + sql_tier("stockout_p") + """ AS stockout_risk, round(round(shortage, 9), 2) AS expected_shortage
FROM m"""))
def q_shipment_impact_fixed_delay(d):
    """R1 (rule part): each in-flight shipment's product re-run with the supplier's mean delay."""
    open_ = d.shipments.where(F.col("actual_delivery").isNull()) \
        .select("company_id", "product_id", "shipment_key", "supplier_id")
    fl = open_.join(_supplier_expected_delay(d), ["company_id", "supplier_id"], "left")
    return scn.shipment_impact(_inputs(d), fl)


SQL_RECS = SQL_HEALTH_VIEW + "," + SQL_SCORECARD + "," + SQL_DEMAND_Z.lstrip() + """,
zr AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, entity_id, record_id) AS rank
       FROM za),
r4 AS (
  SELECT company_id,
         CASE WHEN stockout_risk IN ('HIGH', 'CRITICAL') THEN lower(stockout_risk) ELSE 'medium' END AS priority,
         'inventory' AS type,
         CASE WHEN stockout_risk IN ('HIGH', 'CRITICAL') THEN 'Replenish ' || product_name
              ELSE 'Review overstock of ' || product_name END AS title,
         CASE WHEN stockout_risk IN ('HIGH', 'CRITICAL')
              THEN printf('Stockout probability is %s%% with %.1f days of coverage.',
                          CAST(CAST(round_even(stockout_probability * 100, 0) AS BIGINT) AS VARCHAR),
                          coalesce(inventory_coverage_days, 0.0))
              ELSE 'Inventory coverage is high relative to recent demand.' END AS reason,
         CASE WHEN stockout_risk IN ('HIGH', 'CRITICAL')
              THEN printf('Order approximately %d units to restore the target inventory horizon.',
                          recommended_order_quantity)
              ELSE 'Reduce holding-cost exposure by aligning replenishment with forecast demand.' END
           AS expected_impact,
         product_name AS affected_entity, CAST(product_id AS BIGINT) AS product_id, CAST(NULL AS BIGINT) AS supplier_id, 0 AS source_rank,
         concat_ws('|', product_name, printf('%012d', CAST(product_id AS BIGINT))) AS source_order
  FROM h WHERE stockout_risk IN ('HIGH', 'CRITICAL') OR overstock_risk IN ('HIGH', 'CRITICAL')),
r5 AS (
  SELECT company_id, lower(risk_tier) AS priority, 'supplier' AS type, 'Review supplier ' || name AS title,
         printf('Supplier risk score is %s/100 with %s%% historical delay rate.', CAST(risk_score AS VARCHAR),
                CAST(CAST(round_even(delay_rate * 100, 0) AS BIGINT) AS VARCHAR)) AS reason,
         'Consider alternate sourcing or increased safety stock.' AS expected_impact, name AS affected_entity,
         CAST(NULL AS BIGINT) AS product_id, CAST(supplier_id AS BIGINT) AS supplier_id, 1 AS source_rank, printf('%012.1f|%012d', risk_score, supplier_id) AS source_order
  FROM sc WHERE risk_tier IN ('HIGH', 'CRITICAL')),
r6 AS (
  SELECT company_id, CASE WHEN severity = 'CRITICAL' THEN 'high' ELSE 'medium' END AS priority,
         'anomaly' AS type, 'Investigate ' || entity_type || ' anomaly' AS title, explanation AS reason,
         'Validate the underlying event before it distorts planning decisions.' AS expected_impact,
         entity_id AS affected_entity, CAST(NULL AS BIGINT) AS product_id, CAST(NULL AS BIGINT) AS supplier_id, 2 AS source_rank, printf('%06d', rank) AS source_order
  FROM zr WHERE rank <= 5),
ru AS (SELECT * FROM r4 UNION ALL SELECT * FROM r5 UNION ALL SELECT * FROM r6),
rr AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY
          CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 2 END,
          source_rank, source_order) AS rank
       FROM ru)"""


def _recs(d, limit=rec.MAX_PER_COMPANY):
    health = _health(d)
    card = sup.supplier_scorecard(d.suppliers, d.shipments)
    z = anom.merged_ranking(anom.zscore_anomalies(anom.daily_product_demand(d.sales)), limit=rec.ANOMALY_POOL)
    return rec.merge_recommendations(rec.inventory_recommendations(health), rec.supplier_recommendations(card),
                                     rec.anomaly_recommendations(z), limit=limit)


@query("top_recommendations", oracle(HEALTH_ADAPTERS, SQL_RECS + """
SELECT company_id, priority, type, title, reason, expected_impact, affected_entity, product_id, supplier_id, rank FROM rr WHERE rank <= 6"""))
def q_top_recommendations(d):
    """K5: the dashboard's six first recommendations per company."""
    return _recs(d, 6)


@query("recommendations_rules", oracle(HEALTH_ADAPTERS, SQL_RECS + """
SELECT company_id, priority, type, title, reason, expected_impact, affected_entity, product_id, supplier_id, rank FROM rr WHERE rank <= 30"""))
def q_recommendations_rules(d):
    """Inventory, supplier and demand-anomaly recommendations, top 30 per company by priority."""
    return _recs(d)


@query("inventory_value", oracle(HEALTH_ADAPTERS, SQL_HEALTH_VIEW + """
SELECT h.company_id, round(sum(h.inventory_level * coalesce(p.unit_cost, 0.0)), 2) AS inventory_value,
       round(sum(h.inventory_level), 2) AS inventory_units
FROM h LEFT JOIN products p ON h.company_id = p.company_id AND h.product_id = p.product_id
GROUP BY h.company_id"""))
def q_inventory_value(d):
    """K2: inventory value (level x unit cost) and units per company."""
    return dash.inventory_value(_health(d, carry=("unit_cost",)))


SQL_COUNTS = """
cnt AS (
  SELECT c.company_id, c.name, coalesce(p.n, 0) AS product_count, coalesce(s.n, 0) AS supplier_count,
         coalesce(sa.n, 0) AS sales_record_count, coalesce(sh.n, 0) AS shipment_count,
         sa.d0 AS date_range_start, sa.d1 AS date_range_end
  FROM companies c
  LEFT JOIN (SELECT company_id, count(*) AS n FROM products GROUP BY company_id) p ON c.company_id = p.company_id
  LEFT JOIN (SELECT company_id, count(*) AS n FROM suppliers GROUP BY company_id) s ON c.company_id = s.company_id
  LEFT JOIN (SELECT company_id, count(*) AS n, min(sale_date) AS d0, max(sale_date) AS d1 FROM sales
             GROUP BY company_id) sa ON c.company_id = sa.company_id
  LEFT JOIN (SELECT company_id, count(*) AS n FROM shipments GROUP BY company_id) sh ON c.company_id = sh.company_id)"""


def _counts(d):
    return dash.company_counts(d.companies, d.products, d.suppliers, d.sales, d.shipments)


@query("tenant_sales", oracle("sales", """
SELECT company_id, product_id, sale_date, quantity, region FROM sales WHERE company_id = 3"""))
def q_tenant_sales(d):
    """K7: one tenant's view of a table; the filter prunes its partitions."""
    return dash.for_tenant(d.sales, 3).select("company_id", "product_id", "sale_date", "quantity", "region")


@query("risk_distribution", oracle("shipments", """
te AS (SELECT company_id, shipment_key, order_date, ((l_orderkey * 13 + l_partkey * 7) % 1000) / 1000.0 * 0.8
              + CASE WHEN actual_delivery > planned_delivery THEN 0.2 ELSE 0.0 END AS score FROM shipments)
SELECT company_id, count(CASE WHEN score >= 0.85 THEN 1 END) AS critical, count(CASE WHEN score >= 0.7 AND score < 0.85 THEN 1 END) AS high,
       count(CASE WHEN score >= 0.4 AND score < 0.7 THEN 1 END) AS medium, count(CASE WHEN score < 0.4 THEN 1 END) AS low
FROM te GROUP BY company_id"""))
def q_risk_distribution(d):
    """K3: shipments per delay-risk tier and tenant, here of the deterministic score."""
    late = F.coalesce((F.col("actual_delivery") > F.col("planned_delivery")).cast("double"), F.lit(0.0))
    score = ((F.col("l_orderkey") * 13 + F.col("l_partkey") * 7) % 1000) / 1000.0 * 0.8 + late * 0.2
    return dash.risk_distribution(d.shipments.withColumn("risk_tier", tier(score, DELAY_TIERS)))


@query("company_summary", oracle("companies,products,suppliers,sales,shipments", SQL_COUNTS + "\nSELECT * FROM cnt"))
def q_company_summary(d):
    """K6: per company product/supplier/sales/shipment counts and sales date range."""
    return _counts(d)


@query("chain_health_stock_only", oracle("companies," + HEALTH_ADAPTERS, SQL_HEALTH_VIEW + "," + SQL_SUMMARY + ","
                                         + SQL_COUNTS + """,
val AS (SELECT h.company_id, round(sum(h.inventory_level * coalesce(p.unit_cost, 0.0)), 2) AS inventory_value,
               round(sum(h.inventory_level), 2) AS inventory_units
        FROM h LEFT JOIN products p ON h.company_id = p.company_id AND h.product_id = p.product_id
        GROUP BY h.company_id)
SELECT c.company_id, c.name, c.product_count AS products, c.shipment_count AS shipments,
       CAST(0 AS BIGINT) AS high_risk_shipments, CAST(coalesce(s.stockout_high, 0) AS BIGINT) AS stockout_risks,
       coalesce(v.inventory_units, 0.0) AS inventory_units, coalesce(v.inventory_value, 0.0) AS inventory_value,
       CAST(round(least(greatest(100.0 - 2 * coalesce(s.stockout_high, 0), 0.0), 100.0), 1) AS DOUBLE) AS supply_chain_health,
       c.supplier_count
FROM cnt c LEFT JOIN summary s ON c.company_id = s.company_id LEFT JOIN val v ON c.company_id = v.company_id"""))
def q_chain_health_stock_only(d):
    """K1/K4 without the delay model: KPI row per company, health from stockout risk only."""
    return dash.dashboard_kpis(d.companies, dash.inventory_rollup(_health(d, carry=("unit_cost",))), _counts(d))


def sql_suff_cte(name: str, src: str, date_col: str, min_n: int, noun: str, empty: str) -> str:
    """CTEs ``{name}_ag``, ``{name}_sf`` and ``{name}`` (the sufficiency rows) for one model type."""
    return f"""
{name}_ag AS (SELECT company_id, count(*) AS n, min({date_col}) AS d0, max({date_col}) AS d1 FROM {src}
              GROUP BY company_id),
{name}_sf AS (SELECT c.company_id, CAST(coalesce(ag.n, 0) AS BIGINT) AS record_count,
                     CAST(coalesce(ag.d1 - ag.d0, 0) AS BIGINT) AS history_days, ag.d0
              FROM companies c LEFT JOIN {name}_ag ag ON c.company_id = ag.company_id),
{name} AS (
SELECT company_id, record_count, history_days,
       CASE WHEN d0 IS NULL THEN false ELSE record_count >= {min_n} AND history_days >= 180 END AS is_sufficient,
       CASE WHEN d0 IS NULL THEN '{empty}'
            WHEN record_count >= {min_n} AND history_days >= 180
              THEN printf('%d {noun} over %d days meets the threshold for a company-specific model.',
                          record_count, history_days)
            ELSE 'Insufficient data for a company-specific model: ' || concat_ws('; ',
                   CASE WHEN record_count < {min_n} THEN printf('needs >= {min_n} {noun} (has %d)', record_count) END,
                   CASE WHEN history_days < 180 THEN printf('needs >= 180 days of history (has %d)', history_days) END)
                 || '. Using base model.' END AS reason
FROM {name}_sf)"""


SQL_DEMAND_SUFF = sql_suff_cte("dsuf", "sales", "sale_date", gov.MIN_DEMAND_RECORDS, "records",
                               "No sales history uploaded yet.")
SQL_SHIP_SUFF = sql_suff_cte("ssuf", "(SELECT * FROM shipments WHERE actual_delivery IS NOT NULL) x", "order_date",
                             gov.MIN_SHIPMENT_RECORDS, "completed shipments",
                             "No completed shipment history uploaded yet.")


@query("demand_sufficiency", oracle("companies,sales", SQL_DEMAND_SUFF + "\nSELECT * FROM dsuf"))
def q_demand_sufficiency(d):
    """G1: does each tenant have enough sales history for its own demand model?"""
    return gov.demand_sufficiency(d.companies, d.sales)


@query("shipment_sufficiency", oracle("companies,shipments", SQL_SHIP_SUFF + "\nSELECT * FROM ssuf"))
def q_shipment_sufficiency(d):
    """Does each tenant have enough completed shipments for its own delay models?"""
    return gov.shipment_sufficiency(d.companies, d.shipments)
