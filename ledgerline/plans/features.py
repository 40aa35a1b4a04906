"""Registered feature and metric queries (demand F/D, shipment H/C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.functions import metrics as met
from ledgerline.functions.exprs import DELAY_TIERS, tier
from ledgerline.operators import demand_features as dfe
from ledgerline.operators import shipment_features as sfe
from ledgerline.plans.oracle_adapters import oracle
from ledgerline.plans.register import query
from ledgerline.session import cut_lineage
from ledgerline.sources.testdata import shipment_key

R = 6  # decimals for float outputs compared across engines
LATEST = 100  # default length of the newest-shipments list

# ----------------------------------------------------------------------------------------
# Demand features
# ----------------------------------------------------------------------------------------
SQL_DENSE = """
daily AS (SELECT company_id, product_id, sale_date AS date, sum(quantity) AS quantity,
                 max(coalesce(promotion, 0)) AS promotion
          FROM sales GROUP BY company_id, product_id, sale_date),
span AS (SELECT company_id, product_id, min(date) AS d0, max(date) AS d1 FROM daily GROUP BY company_id, product_id),
cal AS (SELECT company_id, product_id, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS date
        FROM span),
dense AS (SELECT c.company_id, c.product_id, c.date, coalesce(d.quantity, 0.0) AS quantity,
                 coalesce(d.promotion, 0) AS promotion
          FROM cal c LEFT JOIN daily d
            ON c.company_id = d.company_id AND c.product_id = d.product_id AND c.date = d.date)"""

SQL_CALENDAR = """
calf AS (SELECT *, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(month(date) AS INTEGER) AS month,
                CAST(isodow(date) - 1 >= 5 AS INTEGER) AS is_weekend,
                CAST(date - (SELECT min(date) FROM dense) AS INTEGER) AS trend_index
         FROM dense)"""

SQL_LAGROLL = """
feat AS (
  SELECT *, lag(quantity, 1) OVER w AS lag_1, lag(quantity, 7) OVER w AS lag_7, lag(quantity, 14) OVER w AS lag_14,
         CASE WHEN count(quantity) OVER w7 = 7 THEN avg(quantity) OVER w7 END AS rollmean_7,
         CASE WHEN count(quantity) OVER w7 = 7 THEN stddev_samp(quantity) OVER w7 END AS rollstd_7,
         CASE WHEN count(quantity) OVER w14 = 14 THEN avg(quantity) OVER w14 END AS rollmean_14,
         CASE WHEN count(quantity) OVER w14 = 14 THEN stddev_samp(quantity) OVER w14 END AS rollstd_14
  FROM calf
  WINDOW w AS (PARTITION BY company_id, product_id ORDER BY date),
         w7 AS (PARTITION BY company_id, product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w14 AS (PARTITION BY company_id, product_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING)),
fm AS (SELECT * FROM feat WHERE lag_1 IS NOT NULL AND lag_7 IS NOT NULL AND lag_14 IS NOT NULL
         AND rollmean_7 IS NOT NULL AND rollmean_14 IS NOT NULL AND rollstd_7 IS NOT NULL AND rollstd_14 IS NOT NULL)"""

ROLL = ["rollmean_7", "rollstd_7", "rollmean_14", "rollstd_14"]


def _r(cols):
    return [F.round(c, R).alias(c) for c in cols]


def _sql_r(cols):
    return ", ".join(f"round({c}, {R}) AS {c}" for c in cols)


@query("daily_densify", oracle("sales", SQL_DENSE + "\nSELECT * FROM dense"))
def q_daily_densify(d):
    """every (tenant, brand) product on a gap-free daily calendar, missing days as 0."""
    return dfe.daily_densify(d.sales)


@query("calendar_features", oracle("sales", SQL_DENSE + "," + SQL_CALENDAR + "\nSELECT * FROM calf"))
def q_calendar_features(d):
    """day of week (Mon=0), month, weekend flag and trend index on the dense table."""
    return dfe.calendar_features(dfe.daily_densify(d.sales), d.sales.select(F.min("sale_date")).scalar())


@query("lag_features", oracle("sales", SQL_DENSE + "," + SQL_CALENDAR + "," + SQL_LAGROLL + """
SELECT company_id, product_id, date, lag_1, lag_7, lag_14 FROM feat"""))
def q_lag_features(d):
    """demand 1, 7 and 14 days earlier."""
    f = dfe.lag_roll_features(dfe.daily_densify(d.sales))
    return f.select("company_id", "product_id", "date", "lag_1", "lag_7", "lag_14")


@query("rolling_features", oracle("sales", SQL_DENSE + "," + SQL_CALENDAR + "," + SQL_LAGROLL + f"""
SELECT company_id, product_id, date, {_sql_r(ROLL)} FROM feat"""))
def q_rolling_features(d):
    """trailing 7/14-day mean and sample std, excluding the current day, full windows only."""
    f = dfe.lag_roll_features(dfe.daily_densify(d.sales))
    return f.select("company_id", "product_id", "date", *_r(ROLL))


FM_COLS = ["company_id", "product_id", "date", "quantity", "promotion", "day_of_week", "month", "is_weekend",
           "trend_index", "lag_1", "lag_7", "lag_14"]


@query("demand_feature_matrix", oracle("sales", SQL_DENSE + "," + SQL_CALENDAR + "," + SQL_LAGROLL + f"""
SELECT {', '.join(FM_COLS)}, {_sql_r(ROLL)} FROM fm"""))
def q_demand_feature_matrix(d):
    """The model-ready daily feature matrix (warm-up rows dropped)."""
    return dfe.demand_feature_matrix(d.sales).select(*FM_COLS, *_r(ROLL))


def sql_cutoff(name: str, src: str, date_col: str, q: float) -> str:
    return f"""
{name}_pd AS (SELECT company_id, {date_col} AS d, count(*) AS c FROM {src} GROUP BY company_id, {date_col}),
{name}_pc AS (SELECT *, sum(c) OVER (PARTITION BY company_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING
                                     AND CURRENT ROW) AS cum,
                     sum(c) OVER (PARTITION BY company_id) AS n FROM {name}_pd),
{name} AS (SELECT company_id, min(d) AS cutoff, min(n) AS n_rows FROM {name}_pc
           WHERE cum >= round_even((n - 1) * {q}, 0) + 1 GROUP BY company_id)"""


SQL_DEMAND_SPLIT = (SQL_DENSE + "," + SQL_CALENDAR + "," + SQL_LAGROLL + "," + sql_cutoff("oc", "fm", "date", 0.8)
                    + """,
tr AS (SELECT fm.* FROM fm JOIN oc ON fm.company_id = oc.company_id WHERE fm.date < oc.cutoff),
te AS (SELECT fm.* FROM fm JOIN oc ON fm.company_id = oc.company_id WHERE fm.date >= oc.cutoff),""" +
                    sql_cutoff("ic", "tr", "date", 0.75))


@query("time_split", oracle("sales", SQL_DEMAND_SPLIT + """
SELECT oc.company_id, oc.cutoff AS test_cutoff,
       (SELECT count(*) FROM tr WHERE tr.company_id = oc.company_id) AS train_rows,
       (SELECT count(*) FROM te WHERE te.company_id = oc.company_id) AS test_rows,
       ic.cutoff AS validation_cutoff,
       (SELECT count(*) FROM tr WHERE tr.company_id = oc.company_id AND tr.date < ic.cutoff) AS train_sub_rows,
       (SELECT count(*) FROM tr WHERE tr.company_id = oc.company_id AND tr.date >= ic.cutoff) AS validation_rows
FROM oc LEFT JOIN ic ON oc.company_id = ic.company_id"""))
def q_time_split(d):
    """Per-tenant nearest-quantile time cutoffs (test 20%, validation 25% of train) and row counts."""
    return dfe.split_summary(demand_features(d))


def demand_features(d):
    """The demand feature matrix as a shared feature table (written once, read by its consumers)."""
    return d.feature_table("demand", lambda: dfe.demand_feature_matrix(d.sales))


def _demand_split(d):
    feat = demand_features(d)
    s = dfe.time_split(feat, "date", dfe.TEST_FRACTION)
    return s.where(~F.col("is_test")), s.where(F.col("is_test"))


@query("mean_encoding", oracle("sales", SQL_DEMAND_SPLIT + f""",
pm AS (SELECT company_id, product_id, avg(quantity) AS pmean FROM tr GROUP BY company_id, product_id),
gm AS (SELECT company_id, avg(quantity) AS gmean FROM tr GROUP BY company_id),
allp AS (SELECT DISTINCT company_id, product_id FROM fm)
SELECT a.company_id, a.product_id, round(coalesce(pm.pmean, gm.gmean), {R}) AS product_mean_demand,
       pm.pmean IS NULL AS unseen_in_train
FROM allp a LEFT JOIN pm ON a.company_id = pm.company_id AND a.product_id = pm.product_id
LEFT JOIN gm ON a.company_id = gm.company_id"""))
def q_mean_encoding(d):
    """Product mean demand from the training split only; unseen products take the tenant mean."""
    train, test = _demand_split(d)
    prod, glob = dfe.mean_encoding(train)
    allp = demand_features(d).select("company_id", "product_id").distinct()
    enc = allp.join(prod, ["company_id", "product_id"], "left").join(glob, ["company_id"], "left")
    return enc.select("company_id", "product_id",
                      F.round(F.coalesce("product_mean_demand", "global_mean_demand"), R).alias("product_mean_demand"),
                      F.col("product_mean_demand").isNull().alias("unseen_in_train"))


@query("naive_baseline_metrics", oracle("sales", SQL_DEMAND_SPLIT + f"""
SELECT company_id, count(*) AS rows, round(avg(abs(greatest(lag_7, 0.0) - quantity)), {R}) AS mae,
       round(sqrt(avg((greatest(lag_7, 0.0) - quantity) * (greatest(lag_7, 0.0) - quantity))), {R}) AS rmse,
       round(avg(CASE WHEN quantity > 1e-6 THEN abs((greatest(lag_7, 0.0) - quantity) / quantity) END) * 100, {R})
         AS mape
FROM te GROUP BY company_id"""))
def q_naive_baseline_metrics(d):
    """Seasonal-naive (lag_7) MAE / RMSE / MAPE on each tenant's held-out period."""
    _, test = _demand_split(d)
    m = dfe.regression_metrics(dfe.naive_baseline(test), "quantity", "baseline_pred")
    return m.select("company_id", "rows", *[F.round(c, R).alias(c) for c in ("mae", "rmse", "mape")])


@query("seasonal_naive_forecast", oracle("sales", SQL_DENSE + """,
lt AS (SELECT company_id, product_id, max(date) AS t FROM dense GROUP BY company_id, product_id),
tl AS (SELECT d.company_id, d.product_id, d.quantity, lt.t, CAST(d.date - (lt.t - 6) AS INTEGER) AS off
       FROM dense d JOIN lt ON d.company_id = lt.company_id AND d.product_id = lt.product_id
       WHERE d.date > lt.t - 7),
st AS (SELECT company_id, product_id, quantity, t, CAST(unnest(generate_series(off + 1, 30, 7)) AS INTEGER) AS step
       FROM tl WHERE off + 1 <= 30)
SELECT company_id, product_id, step, t + step AS date, greatest(quantity, 0.0) AS predicted_quantity FROM st"""))
def q_seasonal_naive_forecast(d):
    """30-day seasonal-naive forecast (repeat the last observed week) for every product."""
    return dfe.seasonal_naive_forecast(dfe.daily_densify(d.sales), 30)


# ----------------------------------------------------------------------------------------
# Shipment features
# ----------------------------------------------------------------------------------------
TIE_SQL = "order_date, l_orderkey, l_linenumber, l_partkey, supplier_id"

SQL_LABELS = """
lab AS (SELECT *, CAST(actual_delivery - planned_delivery AS INTEGER) AS delay_days,
               CASE WHEN actual_delivery IS NOT NULL
                    THEN CASE WHEN actual_delivery - planned_delivery > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END AS target,
               coalesce(origin, 'None') || ' -> ' || coalesce(destination, 'None') AS route
        FROM shipments)"""


@query("delay_labels", oracle("shipments", SQL_LABELS + """
SELECT shipment_key, company_id, supplier_id, order_date, planned_delivery, actual_delivery, delay_days,
       target AS is_delayed FROM lab"""))
def q_delay_labels(d):
    """H1: delay in days and the delayed flag (null while in flight)."""
    df = sfe.delay_labels(d.shipments)
    return df.select("shipment_key", "company_id", "supplier_id", "order_date", "planned_delivery", "actual_delivery",
                     "delay_days", F.col("target_is_delayed").alias("is_delayed"))


def _route_prior(d, mode):
    df = sfe.mask_labels(sfe.delay_labels(d.shipments)).withColumn("route", sfe.route_key())
    df = sfe.prior_rate(df, ["company_id", "route"], "historical_route_delay_rate", mode)
    return df.select("shipment_key", "company_id", "route", "order_date",
                     F.round("historical_route_delay_rate", R).alias("historical_route_delay_rate"))


@query("route_prior_rate", oracle("shipments", SQL_LABELS + f"""
SELECT shipment_key, company_id, route, order_date,
       round(avg(target) OVER (PARTITION BY company_id, route ORDER BY {TIE_SQL}
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {R}) AS historical_route_delay_rate
FROM lab"""))
def q_route_prior_rate(d):
    """H4 (row_prior): delay rate of the route's earlier shipments (order date, then tie key)."""
    return _route_prior(d, "row_prior")


@query("route_strict_prior_rate", oracle("shipments", SQL_LABELS + f"""
SELECT shipment_key, company_id, route, order_date,
       round(avg(target) OVER (PARTITION BY company_id, route ORDER BY CAST(order_date - DATE '1970-01-01' AS BIGINT)
                               RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {R}) AS historical_route_delay_rate
FROM lab"""))
def q_route_strict_prior_rate(d):
    """H4 (strict_prior): delay rate of the route's shipments ordered on strictly earlier days."""
    return _route_prior(d, "strict_prior")


@query("route_known_prior_rate", oracle("shipments", SQL_LABELS + f"""
SELECT a.shipment_key, a.company_id, a.route, a.order_date,
       round(avg(b.target), {R}) AS historical_route_delay_rate
FROM lab a LEFT JOIN lab b
  ON a.company_id = b.company_id AND a.route = b.route AND b.actual_delivery < a.order_date
GROUP BY a.shipment_key, a.company_id, a.route, a.order_date"""))
def q_route_known_prior_rate(d):
    """H4 (known_prior): delay rate of route outcomes already delivered before the order date."""
    return _route_prior(d, "known_prior")


@query("supplier_prior_rate", oracle("shipments", SQL_LABELS + f"""
SELECT shipment_key, company_id, supplier_id, order_date,
       round(avg(target) OVER (PARTITION BY company_id, supplier_id ORDER BY {TIE_SQL}
                               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), {R}) AS supplier_recent_delay_rate,
       coalesce(lag(target) OVER (PARTITION BY company_id, supplier_id ORDER BY {TIE_SQL}), CAST(0.0 AS DOUBLE))
         AS previous_shipment_delayed
FROM lab"""))
def q_supplier_prior_rate(d):
    """H5/H6: supplier's prior delay rate and its previous shipment's outcome."""
    df = sfe.mask_labels(sfe.delay_labels(d.shipments))
    df = sfe.with_history(df, ["company_id"], "supplier_id", "supplier_recent_delay_rate", "previous_shipment_delayed")
    df = df.fillna(0.0, ["previous_shipment_delayed"])
    return df.select("shipment_key", "company_id", "supplier_id", "order_date",
                     F.round("supplier_recent_delay_rate", R).alias("supplier_recent_delay_rate"),
                     "previous_shipment_delayed")


SQL_SHIP_CUT = sql_cutoff("sc", "(SELECT * FROM shipments WHERE actual_delivery IS NOT NULL) x", "order_date", 0.8)

SQL_SHIP_FEAT = SQL_SHIP_CUT + """,
lab AS (SELECT s.*, sp.lead_time_days AS supplier_lead_time_days, sp.reliability AS supplier_reliability,
               sp.cost_index AS supplier_cost_index,
               CAST(s.actual_delivery - s.planned_delivery AS INTEGER) AS delay_days,
               CASE WHEN s.actual_delivery IS NOT NULL
                    THEN CASE WHEN s.actual_delivery - s.planned_delivery > 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END END AS target,
               coalesce(s.origin, 'None') || ' -> ' || coalesce(s.destination, 'None') AS route
        FROM shipments s JOIN suppliers sp ON s.company_id = sp.company_id AND s.supplier_id = sp.supplier_id),
msk AS (SELECT l.*, CASE WHEN l.order_date < c.cutoff THEN l.target END AS obs
        FROM lab l LEFT JOIN sc c ON l.company_id = c.company_id),
sf AS (
  SELECT *,
    avg(obs) OVER (PARTITION BY company_id, route ORDER BY """ + TIE_SQL + """
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hr,
    avg(obs) OVER (PARTITION BY company_id, supplier_id ORDER BY """ + TIE_SQL + """
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sr,
    lag(obs) OVER (PARTITION BY company_id, supplier_id ORDER BY """ + TIE_SQL + """) AS prev,
    avg(obs) OVER (PARTITION BY company_id) AS gl_rate
  FROM msk),
sfm AS (
  SELECT shipment_key, company_id, product_id, supplier_id, order_date, route,
         coalesce(transport_mode, 'unknown') AS transport_mode, coalesce(carrier, 'unknown') AS carrier,
         coalesce(distance_km, 0.0) AS distance_km, coalesce(weight_kg, 0.0) AS weight_kg,
         coalesce(quantity, 0.0) AS quantity, coalesce(supplier_lead_time_days, 0.0) AS supplier_lead_time_days,
         coalesce(supplier_reliability, 0.0) AS supplier_reliability,
         coalesce(supplier_cost_index, 0.0) AS supplier_cost_index,
         coalesce(hr, coalesce(gl_rate, 0.1)) AS historical_route_delay_rate,
         coalesce(sr, coalesce(gl_rate, 0.1)) AS supplier_recent_delay_rate,
         coalesce(prev, CAST(0.0 AS DOUBLE)) AS previous_shipment_delayed,
         CAST(isodow(order_date) - 1 AS DOUBLE) AS order_day_of_week, CAST(month(order_date) AS DOUBLE) AS order_month,
         target AS is_delayed, delay_days, actual_delivery, l_orderkey, l_partkey
  FROM sf)"""

SF_OUT = ["shipment_key", "company_id", "product_id", "supplier_id", "order_date", "route", "transport_mode",
          "carrier"]


def _ship_features(d, completed_only=True):
    """Tenant-scoped feature matrix (a shared feature table) with labels masked from each tenant's cutoff on."""
    if completed_only:
        return d.feature_table("shipment_tenant", lambda: _build_unkeyed(d)).withColumn("shipment_key", shipment_key())
    return _build_ship_features(d, False)


def _build_ship_features(d, completed_only=True):
    return _build_unkeyed(d, completed_only).withColumn("shipment_key", shipment_key())


def _build_unkeyed(d, completed_only=True):
    sh = sfe.attach_suppliers(d.unkeyed_shipments, d.suppliers, "inner")
    done = sh.where(F.col("actual_delivery").isNotNull())
    # one row a tenant, written once: the history steps read their input several times
    cut = cut_lineage(dfe.nearest_quantile_cutoff(done, "order_date", 1 - dfe.TEST_FRACTION).select("company_id", "cutoff"))
    sh = sh.join(F.broadcast(cut), "company_id", "left")
    return sfe.shipment_feature_matrix(sh, train_end=F.col("cutoff"), completed_only=completed_only)


GAP_TIE = "l_orderkey, l_linenumber, l_partkey, supplier_id"


@query("shipment_history_with_gaps", oracle("shipments", """
lab AS (SELECT shipment_key, company_id, coalesce(origin, 'None') || ' -> ' || coalesce(destination, 'None') AS route,
               CASE WHEN l_orderkey % 11 <> 0 THEN supplier_id END AS sup, CASE WHEN l_orderkey % 13 <> 0 THEN order_date END AS od,
               CASE WHEN actual_delivery > planned_delivery THEN CAST(1.0 AS DOUBLE) WHEN actual_delivery IS NOT NULL THEN CAST(0.0 AS DOUBLE) END AS obs,
               l_orderkey, l_linenumber, l_partkey, supplier_id FROM shipments),
h AS (SELECT *,
    avg(obs) OVER (PARTITION BY company_id, route ORDER BY od NULLS LAST, """ + GAP_TIE + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r1,
    avg(CASE WHEN od IS NOT NULL THEN obs END) OVER (PARTITION BY company_id, route) AS r2,
    avg(obs) OVER (PARTITION BY company_id, sup ORDER BY od NULLS LAST, """ + GAP_TIE + """ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s1,
    avg(CASE WHEN od IS NOT NULL THEN obs END) OVER (PARTITION BY company_id, sup) AS s2,
    lag(obs) OVER (PARTITION BY company_id, sup ORDER BY od NULLS LAST, """ + GAP_TIE + """) AS p1,
    max(CASE WHEN od IS NOT NULL THEN 1 END) OVER (PARTITION BY company_id, sup) AS has,
    first_value(obs) OVER (PARTITION BY company_id, sup ORDER BY CASE WHEN od IS NULL THEN 1 ELSE 0 END, od DESC, l_orderkey DESC,
                           l_linenumber DESC, l_partkey DESC, supplier_id DESC) AS p2
  FROM lab)
SELECT shipment_key, company_id, round(CASE WHEN od IS NOT NULL THEN r1 ELSE r2 END, """ + str(R) + """) AS route_rate,
       CASE WHEN sup IS NOT NULL THEN round(CASE WHEN od IS NOT NULL THEN s1 ELSE s2 END, """ + str(R) + """) END AS supplier_rate,
       CASE WHEN sup IS NULL THEN 0.0::DOUBLE ELSE coalesce(CASE WHEN od IS NOT NULL THEN p1 WHEN has = 1 THEN p2 END, 0.0::DOUBLE) END AS previous
FROM h"""))
def q_shipment_history_with_gaps(d):
    """H4-H6 where every eleventh order has no supplier and every thirteenth no order date."""
    gaps = d.shipments.withColumns({"sup": F.when(F.col("l_orderkey") % 11 != 0, F.col("supplier_id")),
                                    "order_date": F.when(F.col("l_orderkey") % 13 != 0, F.col("order_date"))})
    df = sfe.mask_labels(sfe.delay_labels(gaps)).withColumn("route", sfe.route_key())
    df = sfe.with_histories(df, ["company_id"], [("route", "route_rate", None), ("sup", "supplier_rate", "previous")])
    return df.select("shipment_key", "company_id", F.round("route_rate", R).alias("route_rate"),
                     F.round("supplier_rate", R).alias("supplier_rate"), F.coalesce("previous", F.lit(0.0)).alias("previous"))


@query("shipment_feature_matrix", oracle("suppliers,shipments", SQL_SHIP_FEAT + f"""
SELECT {', '.join(SF_OUT)}, {_sql_r(sfe.NUMERIC_FEATURE_COLUMNS)}, is_delayed, delay_days
FROM sfm WHERE actual_delivery IS NOT NULL"""))
def q_shipment_feature_matrix(d):
    """Training features of completed shipments, labels masked after each tenant's cutoff."""
    f = _build_ship_features(d)
    return f.select(*SF_OUT, *_r(sfe.NUMERIC_FEATURE_COLUMNS), "is_delayed", "delay_days")


@query("shipment_supplier_outer", oracle("suppliers,shipments", """
SELECT s.shipment_key, s.company_id, s.supplier_id, s.actual_delivery IS NULL AS in_flight,
       sp.lead_time_days AS supplier_lead_time_days, sp.reliability AS supplier_reliability,
       sp.cost_index AS supplier_cost_index
FROM shipments s LEFT JOIN suppliers sp ON s.company_id = sp.company_id AND s.supplier_id = sp.supplier_id"""))
def q_shipment_supplier_outer(d):
    """H12 (serving side): every shipment with its supplier attributes, left outer."""
    df = sfe.attach_suppliers(d.shipments, d.suppliers, "left")
    return df.select("shipment_key", "company_id", "supplier_id", F.col("actual_delivery").isNull().alias("in_flight"),
                     "supplier_lead_time_days", "supplier_reliability", "supplier_cost_index")


@query("balanced_weights", oracle("suppliers,shipments", SQL_SHIP_FEAT + """,
trn AS (SELECT f.* FROM sfm f JOIN sc ON f.company_id = sc.company_id
        WHERE f.actual_delivery IS NOT NULL AND f.order_date < sc.cutoff),
cls AS (SELECT company_id, is_delayed, count(*) AS n_class FROM trn GROUP BY company_id, is_delayed),
tot AS (SELECT company_id, count(*) AS n FROM trn GROUP BY company_id)
SELECT c.company_id, c.is_delayed, c.n_class, round(t.n / (2.0 * c.n_class), 9) AS sample_weight
FROM cls c JOIN tot t ON c.company_id = t.company_id"""))
def q_balanced_weights(d):
    """Balanced class weights n / (2 * n_class) on each tenant's training split."""
    f = _ship_features(d)
    train = f.where(F.col("order_date") < F.col("cutoff"))
    w = sfe.balanced_weights(train)
    return (w.groupBy("company_id", "is_delayed")
            .agg(F.count(F.lit(1)).alias("n_class"), F.round(F.first("sample_weight"), 9).alias("sample_weight")))


# Deterministic stand-in score for the metric operators (ties on purpose): in [0, 1].
def det_score(late=None):
    late = F.col("is_delayed") if late is None else late
    return ((F.col("l_orderkey") * 13 + F.col("l_partkey") * 7) % 1000) / 1000.0 * 0.8 + late * 0.2


SQL_DET = "(((l_orderkey * 13 + l_partkey * 7) % 1000) / 1000.0 * 0.8 + is_delayed * 0.2)"

SQL_SCORED = SQL_SHIP_FEAT + f""",
te AS (SELECT f.*, {SQL_DET} AS score, CASE WHEN {SQL_DET} >= 0.5 THEN 1 ELSE 0 END AS pred
       FROM sfm f JOIN sc ON f.company_id = sc.company_id
       WHERE f.actual_delivery IS NOT NULL AND f.order_date >= sc.cutoff),
trn AS (SELECT f.* FROM sfm f JOIN sc ON f.company_id = sc.company_id
        WHERE f.actual_delivery IS NOT NULL AND f.order_date < sc.cutoff)"""


def _scored_test(d):
    f = _ship_features(d)
    te = f.where(F.col("order_date") >= F.col("cutoff")).withColumn("score", det_score())
    return te.withColumn("pred", (F.col("score") >= 0.5).cast("int")), f.where(F.col("order_date") < F.col("cutoff"))


SQL_CONF = """
SELECT company_id,
       count(CASE WHEN is_delayed = 1 AND pred = 1 THEN 1 END) AS true_positive,
       count(CASE WHEN is_delayed = 0 AND pred = 0 THEN 1 END) AS true_negative,
       count(CASE WHEN is_delayed = 0 AND pred = 1 THEN 1 END) AS false_positive,
       count(CASE WHEN is_delayed = 1 AND pred = 0 THEN 1 END) AS false_negative
FROM {src} GROUP BY company_id"""

SQL_CLS = """
SELECT *, CASE WHEN tp + tn + fp + fn > 0 THEN round((tp + tn) / (tp + tn + fp + fn), {R}) END AS accuracy,
       CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), {R}) ELSE 0.0 END AS precision,
       CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), {R}) ELSE 0.0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), {R}) ELSE 0.0 END AS f1
FROM (SELECT company_id, true_positive AS tp, true_negative AS tn, false_positive AS fp, false_negative AS fn
      FROM ({conf}) c) x"""


def _cls_out(m):
    return m.select("company_id", F.col("true_positive").alias("tp"), F.col("true_negative").alias("tn"),
                    F.col("false_positive").alias("fp"), F.col("false_negative").alias("fn"),
                    *[F.round(c, R).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


@query("confusion_matrix", oracle("suppliers,shipments", SQL_SCORED + SQL_CONF.format(src="te")))
def q_confusion_matrix(d):
    """Confusion counts of a deterministic score at threshold 0.5 on each tenant's test period."""
    te, _ = _scored_test(d)
    return met.confusion(te, "is_delayed", "pred")


@query("classification_metrics", oracle("suppliers,shipments", SQL_SCORED + "\n" + SQL_CLS.format(
    R=R, conf=SQL_CONF.format(src="te"))))
def q_classification_metrics(d):
    """Accuracy / precision / recall / F1 (zero_division = 0) at threshold 0.5."""
    te, _ = _scored_test(d)
    return _cls_out(met.classification_metrics(te, "is_delayed", "pred"))


@query("majority_baseline", oracle("suppliers,shipments", SQL_SCORED + """,
mc AS (SELECT company_id, CAST(arg_max(is_delayed, n * 10 - is_delayed) AS INTEGER) AS majority_class FROM
         (SELECT company_id, is_delayed, count(*) AS n FROM trn GROUP BY company_id, is_delayed) t GROUP BY company_id),
mb AS (SELECT te.*, mc.majority_class AS pred2 FROM te JOIN mc ON te.company_id = mc.company_id)
""" + SQL_CLS.format(R=R, conf=SQL_CONF.format(src="mb").replace("pred =", "pred2 ="))))
def q_majority_baseline(d):
    """Predict each tenant's majority training class; scores on its test period."""
    te, train = _scored_test(d)
    return _cls_out(met.majority_baseline(train, te, "is_delayed"))


@query("roc_auc_by_tenant", oracle("suppliers,shipments", SQL_SCORED + f""",
sg AS (SELECT company_id, score, count(CASE WHEN is_delayed = 1 THEN 1 END) AS pos,
              count(CASE WHEN is_delayed = 0 THEN 1 END) AS neg FROM te GROUP BY company_id, score),
sb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY company_id ORDER BY score
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM sg)
SELECT company_id, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives,
       CASE WHEN sum(pos) > 0 AND sum(neg) > 0
            THEN round(sum(pos * (neg_below + neg / 2.0)) / (sum(pos) * sum(neg)), {R}) END AS roc_auc
FROM sb GROUP BY company_id"""))
def q_roc_auc_by_tenant(d):
    """Tie-aware ROC-AUC of a deterministic score per tenant (rank-sum over distinct scores)."""
    te, _ = _scored_test(d)
    r = met.roc_auc(te, "is_delayed", "score")
    return r.select("company_id", "positives", "negatives", F.round("roc_auc", R).alias("roc_auc"))


@query("average_precision_by_tenant", oracle("suppliers,shipments", SQL_SCORED + f""",
sg AS (SELECT company_id, score, count(CASE WHEN is_delayed = 1 THEN 1 END) AS pos,
              count(CASE WHEN is_delayed = 0 THEN 1 END) AS neg FROM te GROUP BY company_id, score),
sc2 AS (SELECT *, sum(pos) OVER (PARTITION BY company_id ORDER BY score DESC
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
               sum(neg) OVER (PARTITION BY company_id ORDER BY score DESC
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp FROM sg)
SELECT company_id, CAST(sum(pos) AS BIGINT) AS positives,
       CASE WHEN sum(pos) > 0 THEN round(sum(pos * tp / (tp + fp)) / sum(pos), {R}) END AS average_precision
FROM sc2 GROUP BY company_id"""))
def q_average_precision_by_tenant(d):
    """C11: step-form average precision (sklearn's, not the trapezoid area) per tenant."""
    te, _ = _scored_test(d)
    r = met.average_precision(te, "is_delayed", "score")
    return r.select("company_id", "positives", F.round("average_precision", R).alias("average_precision"))


@query("delay_risk_tier", oracle("shipments", """
te AS (SELECT shipment_key, company_id, ((l_orderkey * 13 + l_partkey * 7) % 1000) / 1000.0 * 0.8
              + CASE WHEN actual_delivery > planned_delivery THEN 0.2 ELSE 0.0 END AS score FROM shipments)
SELECT shipment_key, company_id, round(score, 4) AS delay_probability,
       CASE WHEN score >= 0.85 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM'
            ELSE 'LOW' END AS risk_tier
FROM te"""))
def q_delay_risk_tier(d):
    """Delay-risk tier (>= .85 / .7 / .4) of a probability, here the deterministic score, of every shipment."""
    late = F.coalesce((F.col("actual_delivery") > F.col("planned_delivery")).cast("double"), F.lit(0.0))
    te = d.shipments.withColumn("score", det_score(late))
    return te.select("shipment_key", "company_id", F.round("score", 4).alias("delay_probability"),
                     tier("score", DELAY_TIERS).alias("risk_tier"))


@query("duration_mean_baseline", oracle("suppliers,shipments", SQL_SHIP_FEAT + """,
dl AS (SELECT * FROM sfm WHERE actual_delivery IS NOT NULL AND is_delayed = 1),""" +
    sql_cutoff("dc", "dl", "order_date", 0.8) + f""",
dtr AS (SELECT dl.* FROM dl JOIN dc ON dl.company_id = dc.company_id WHERE dl.order_date < dc.cutoff),
dte AS (SELECT dl.* FROM dl JOIN dc ON dl.company_id = dc.company_id WHERE dl.order_date >= dc.cutoff),
mu AS (SELECT company_id, avg(delay_days) AS mu FROM dtr GROUP BY company_id),
ev AS (SELECT dte.company_id, dte.delay_days, mu.mu FROM dte JOIN mu ON dte.company_id = mu.company_id)
SELECT company_id, count(*) AS rows, round(avg(abs(mu - delay_days)), {R}) AS mae,
       round(sqrt(avg((mu - delay_days) * (mu - delay_days))), {R}) AS rmse,
       CASE WHEN count(DISTINCT delay_days) > 1
            THEN round(1 - sum((mu - delay_days) * (mu - delay_days)) / (var_pop(delay_days) * count(*)), {R})
       END AS r2
FROM ev GROUP BY company_id"""))
def q_duration_mean_baseline(d):
    """Delay-duration mean baseline on delayed shipments: MAE / RMSE / R^2 per tenant."""
    f = _ship_features(d).drop("cutoff")
    dl = f.where(F.col("is_delayed") == 1)
    s = dfe.time_split(dl, "order_date", dfe.TEST_FRACTION)
    mu = s.where(~F.col("is_test")).groupBy("company_id").agg(F.avg("delay_days").alias("mu"))
    ev = s.where(F.col("is_test")).join(F.broadcast(mu), "company_id")  # a row a tenant
    m = dfe.regression_metrics(ev, "delay_days", "mu")
    return m.select("company_id", "rows", *[F.round(c, R).alias(c) for c in ("mae", "rmse", "r2")])


@query("shipment_truth_latest", oracle("shipments", SQL_LABELS + f"""
SELECT shipment_key, company_id, order_date, actual_delivery IS NOT NULL AS is_completed,
       CASE WHEN actual_delivery IS NOT NULL THEN delay_days > 0 END AS actual_was_delayed,
       delay_days AS actual_delay_days, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY order_date DESC, l_orderkey DESC, l_linenumber DESC,
                                                                l_partkey DESC, supplier_id DESC) AS rank
  FROM lab) t WHERE rank <= {LATEST}"""))
def q_shipment_truth_latest(d):
    """C18 (truth part): each tenant's newest shipments (``LATEST`` of them, the reference's default) with completion and actual delay."""
    from pyspark.sql import Window
    df = sfe.delay_labels(d.shipments)
    w = Window.partitionBy("company_id").orderBy(*[F.col(c).desc() for c in
                                                   ("order_date", "l_orderkey", "l_linenumber", "l_partkey",
                                                    "supplier_id")])
    df = df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= LATEST)
    return df.select("shipment_key", "company_id", "order_date",
                     F.col("actual_delivery").isNotNull().alias("is_completed"),
                     F.when(F.col("actual_delivery").isNotNull(), F.col("delay_days") > 0).alias("actual_was_delayed"),
                     F.col("delay_days").alias("actual_delay_days"), "rank")
