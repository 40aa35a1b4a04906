"""Registered model-backed queries; what is deterministic about a model (registry rows, outcomes) has an SQL twin.

Fitted models are stored under the fingerprint of the input files, so the queries that share the base demand or delay
models, in this session or a later one, fit them once. Trees and boosting steps are the reference's.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window

from ledgerline.models import delay as dl
from ledgerline.models import demand as dm
from ledgerline.models import registry as reg
from ledgerline.operators import anomaly as anom
from ledgerline.operators import dashboard as dash
from ledgerline.operators import governance as gov
from ledgerline.operators import inventory as inv
from ledgerline.operators import isolation_forest as iso
from ledgerline.operators import recommend as rec
from ledgerline.operators import scenario as scn
from ledgerline.operators import supplier as sup
from ledgerline.plans.analytics import SQL_DEMAND_SUFF
from ledgerline.plans.features import LATEST
from ledgerline.plans.oracle_adapters import oracle
from ledgerline.plans.register import query
from ledgerline.session import checkpoint_root
from ledgerline.sources.testdata import shipment_key

def base_demand(d):
    """Base demand model over every tenant's products, pooled."""
    return d.stored("demand", lambda: dm.train_demand_model(d.sales, scope=()), dm.save_model, lambda path: dm.load_model(d.spark, path))


def _delay_feat(d):
    """Pooled (base-model) training features as a shared feature table."""
    return d.feature_table("shipment_pooled", lambda: dl.feature_frame(d.unkeyed_shipments, d.suppliers, scope=())).withColumn("shipment_key", shipment_key())


def _serving(d):
    """Serving features of every shipment from the real history, as a shared feature table."""
    return d.feature_table("shipment_serving",
                           lambda: dl.serving_features(d.unkeyed_shipments, d.suppliers, scope=("company_id",))).withColumn("shipment_key", shipment_key())


def _forests(d):
    """Isolation forests per tenant, fitted once per data folder (a model artifact, like the others)."""
    return d.feature_table("iforest", lambda: iso.fit_forests(d.shipments))


def _shipment_anomalies(d):
    return iso.shipment_anomalies(d.shipments, forests=_forests(d))


def base_classifier(d):
    return d.stored("shipment_delay", lambda: dl.train_delay_classifier(_delay_feat(d), scope=()), dl.save_model, lambda path: dl.load_model(d.spark, path))


def base_duration(d):
    return d.stored("shipment_duration", lambda: dl.train_duration_model(_delay_feat(d), scope=()), dl.save_model, lambda path: dl.load_model(d.spark, path))


@query("demand_model_metrics")
def q_demand_model_metrics(d):
    """Base demand model vs seasonal-naive baseline on the held-out period (MAE/RMSE/MAPE)."""
    return dm.metrics_frame(d.spark, base_demand(d))


@query("demand_forecast")
def q_demand_forecast(d):
    """30-day recursive forecast of every product of every tenant with the base model (array forest)."""
    return dm.forecast_products(d.sales, base_demand(d), 30)


@query("delay_model_metrics")
def q_delay_model_metrics(d):
    """Delay classifier selection and test metrics vs the majority baseline."""
    return dl.metrics_rows(d.spark, base_classifier(d))


@query("duration_model_metrics")
def q_duration_model_metrics(d):
    """Delay-duration regressor vs the mean baseline (MAE/RMSE/R^2) on delayed shipments."""
    return dl.metrics_rows(d.spark, base_duration(d))


def _latest_scored(d, limit=LATEST):
    feat = _serving(d)
    w = Window.partitionBy("company_id").orderBy(*[F.col(c).desc() for c in
                                                   ("order_date", "l_orderkey", "l_linenumber", "l_partkey",
                                                    "supplier_id")])
    latest = feat.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= limit)
    return dl.score_shipments(latest, base_classifier(d), base_duration(d))


@query("shipment_risk")
def q_shipment_risk(d):
    """Each tenant's newest shipments scored (probability, tier, expected delay) with truth."""
    s = _latest_scored(d)
    return s.select("company_id", "shipment_key", "order_date", "rank", "delay_probability", "risk_tier",
                    "expected_delay_days",
                    F.col("actual_delivery").isNotNull().alias("is_completed"),
                    F.when(F.col("actual_delivery").isNotNull(), F.col("delay_days") > 0).alias("actual_was_delayed"),
                    F.col("delay_days").alias("actual_delay_days"))


@query("risk_factors")
def q_risk_factors(d):
    """C17: top-5 risk factors (importance or |coef|, value, direction) of the scored shipments."""
    s = _latest_scored(d)
    return s.select("company_id", "shipment_key", F.posexplode("top_risk_factors").alias("pos", "f")) \
        .select("company_id", "shipment_key", (F.col("pos") + 1).alias("factor_rank"), "f.feature", "f.importance",
                "f.value", "f.direction")


@query("shipment_detail")
def q_shipment_detail(d):
    """The newest shipment of tenant 3, scored alone from its tenant's history."""
    own = d.shipments.where(F.col("company_id") == 3)
    key = own.orderBy(F.desc("order_date"), F.desc("shipment_key")).select("shipment_key").first()["shipment_key"]
    one = dl.shipment_detail(d.shipments, d.suppliers, base_classifier(d), base_duration(d), 3, key)
    return one.select("company_id", "shipment_key", "delay_probability", "risk_tier", "expected_delay_days")


def _base_rows(d):
    """Registry rows of a base training round."""
    return reg.register_base(d.spark, d.sales, d.shipments, base_demand(d), base_classifier(d), base_duration(d))


def _tenant_models(d):
    """Folder of every sufficient tenant's own demand model, and what came of each training."""
    def build():
        store = f"{d.folder() or checkpoint_root(d.spark)}/tenants-{uuid.uuid4().hex}"
        rows, outcomes = reg.train_tenants(d.spark, d.companies, d.sales, store)
        rows.write.parquet(f"{store}/rows")
        outcomes.write.parquet(f"{store}/outcomes")
        return store

    return d.stored("tenant_models", build, lambda store, path: d.spark.createDataFrame([(store,)], "store string").coalesce(1).write.parquet(path),
                    lambda path: d.spark.read.parquet(path).first()["store"])


def _registry(d):
    """A registry that three trainings committed to: the base models, every sufficient tenant's own, the base again."""
    def build():
        path = f"{d.folder() or checkpoint_root(d.spark)}/registry-{uuid.uuid4().hex}"
        reg.append_registry(d.spark, _base_rows(d), path)
        reg.commit_registry(d.spark, d.spark.read.schema(gov.REGISTRY_SCHEMA).parquet(f"{_tenant_models(d)}/rows"), path)
        reg.append_registry(d.spark, _base_rows(d), path)
        return path

    path = d.stored("registry", build, lambda p, path: d.spark.createDataFrame([(p,)], "path string").coalesce(1).write.parquet(path),
                    lambda path: d.spark.read.parquet(path).first()["path"])
    return reg.read_registry(d.spark, path)


_REGISTRY_SQL = SQL_DEMAND_SUFF + """,
base AS (SELECT 'demand' AS model_type, (SELECT count(*) FROM sales) AS dataset_size, (SELECT max(sale_date) - min(sale_date) FROM sales) AS history_days
         UNION ALL SELECT t.m, s.n, s.d FROM (VALUES ('shipment_delay'), ('shipment_duration')) t(m),
           (SELECT count(*) AS n, max(order_date) - min(order_date) AS d FROM shipments WHERE actual_delivery IS NOT NULL) s),
reg AS (SELECT CAST(NULL AS INTEGER) AS company_id, model_type, 'base' AS model_source, CAST(dataset_size AS BIGINT) AS dataset_size, CAST(history_days AS BIGINT) AS history_days,
               k.v AS n, CASE WHEN k.v = 2 THEN 'active' ELSE 'archived' END AS status FROM base, (VALUES (1), (2)) k(v)
        UNION ALL SELECT CAST(company_id AS INTEGER), 'demand', 'company', CAST(record_count AS BIGINT), CAST(history_days AS BIGINT), 1, 'active' FROM dsuf WHERE is_sufficient)
"""
_STATUS = ["company_id", "model_type", "model_source", "dataset_size", "history_days", "version", "status"]


@query("registry_status", oracle("companies,sales,shipments", _REGISTRY_SQL + """
SELECT company_id, model_type, model_source, dataset_size, history_days, 'v' || n AS version, status FROM reg"""))
def q_registry_status(d):
    """Versions v1..vn per (tenant, model type) of the registry that fits wrote; newest active, older archived."""
    return gov.registry_status(_registry(d)).select(_STATUS)


@query("active_model", oracle("companies,sales,shipments", _REGISTRY_SQL + """
SELECT CAST(c.company_id AS INTEGER) AS company_id, CASE WHEN s.is_sufficient THEN CAST(c.company_id AS INTEGER) END AS owner_company_id,
       CASE WHEN s.is_sufficient THEN 'company' ELSE 'base' END AS model_source, CASE WHEN s.is_sufficient THEN 'v1' ELSE 'v2' END AS version
FROM companies c JOIN dsuf s ON c.company_id = s.company_id"""))
def q_active_model(d):
    """Each tenant's demand model: its own active one, else the active base model."""
    return gov.active_model(d.companies, _registry(d), "demand").select(F.col("company_id").cast("int"), "owner_company_id", "model_source", "version")


@query("registry_listing", oracle("companies,sales,shipments", _REGISTRY_SQL + """,
listed AS (SELECT CAST(c.company_id AS INTEGER) AS listed_for, r.*, CASE WHEN r.company_id IS NULL THEN 1 ELSE 0 END AS grp
           FROM companies c JOIN reg r ON r.company_id = c.company_id OR r.company_id IS NULL)
SELECT listed_for, model_type, model_source, dataset_size, history_days, 'v' || n AS version, status, row_number() OVER (PARTITION BY listed_for ORDER BY grp, n DESC,
       CASE model_type WHEN 'shipment_duration' THEN 0 WHEN 'shipment_delay' THEN 1 ELSE 2 END) AS listing_rank FROM listed"""))
def q_registry_listing(d):
    """Every tenant's registry listing: own entries first, then base entries, newest first."""
    return gov.registry_listing(_registry(d), d.companies.select(F.col("company_id").cast("int").alias("company_id"))).select(
        "listed_for", *_STATUS[1:], "listing_rank")


@query("tenant_training", oracle("companies,sales", SQL_DEMAND_SUFF + """
SELECT CAST(company_id AS INTEGER) AS company_id, 'demand' AS model_type, is_sufficient AS trained,
       CASE WHEN is_sufficient THEN 'trained company-specific model' ELSE reason END AS reason FROM dsuf"""))
def q_tenant_training(d):
    """Every sufficient tenant's own demand model trained in one job; the outcome and its reason for each tenant."""
    return d.spark.read.parquet(f"{_tenant_models(d)}/outcomes")


@query("tenant_model_metrics")
def q_tenant_model_metrics(d):
    """Selected model, validation MAE of both candidates and test errors against the naive baseline, per tenant."""
    m = reg.tenant_models(d.spark, _tenant_models(d)).where("problem IS NULL")
    at = lambda path: F.get_json_object("metrics_json", path).cast("double")
    return m.select("company_id", F.col("name").alias("selected_model"), "train_rows", "test_rows", at("$.validation_maes.random_forest").alias("forest_mae"),
                    at("$.validation_maes.gradient_boosting").alias("boosting_mae"), at("$.comparison.naive_seasonal_baseline.mae").alias("baseline_mae"),
                    F.coalesce(at("$.comparison.random_forest.mae"), at("$.comparison.gradient_boosting.mae")).alias("test_mae"))


@query("company_forecast")
def q_company_forecast(d):
    """30 days of every product of every tenant by the model the registry holds for the tenant, in one job."""
    registry = _registry(d)
    active = gov.active_model(d.companies, registry, "demand")
    path = registry.where("company_id IS NULL AND model_type = 'demand'").orderBy(F.desc("registry_id")).first()["model_path"]
    models, means = reg.stored_models([base_demand(d)], [path], reg.tenant_models(d.spark, _tenant_models(d)))
    return dm.forecast_with_registry(d.sales, active, models, means, 30)


@query("trained_registry")
def q_trained_registry(d):
    """The base rows that the fits wrote, with the size and days of what they were fitted on."""
    return gov.registry_status(_registry(d).where("company_id IS NULL")).drop("model_path", "metrics_json", "registry_id", "training_date")


@query("risk_by_registry")
def q_risk_by_registry(d):
    """Every shipment scored by the models that the registry holds for its tenant, read back from storage."""
    registry = _registry(d)
    active = {k: gov.active_model(d.companies, registry, k) for k in ("shipment_delay", "shipment_duration")}
    scored = dl.score_with_registry(_serving(d), active["shipment_delay"], active["shipment_duration"])
    return scored.select("company_id", "shipment_key", "delay_probability", "risk_tier", "expected_delay_days", "model_source")


@query("shipment_isolation_forest")
def q_shipment_isolation_forest(d):
    """A2: per-tenant isolation forest over (distance, weight, quantity); 5% contamination."""
    return _shipment_anomalies(d)


def _merged(d, limit=100):
    z = anom.zscore_anomalies(anom.daily_product_demand(d.sales))
    return anom.merged_ranking(z, _shipment_anomalies(d), limit=limit)


@query("anomalies_merged")
def q_anomalies_merged(d):
    """A3: demand z-score and shipment isolation-forest anomalies, top 100 per tenant by score."""
    return _merged(d)


def _inputs(d):
    return inv.inventory_inputs(d.products, d.inventory_records, d.sales, d.shipments, d.suppliers)


@query("shipment_impact")
def q_shipment_impact(d):
    """Every in-flight shipment scored by the duration model; its product re-planned with that delay."""
    open_feat = _serving(d).where(F.col("actual_delivery").isNull())
    scored = dl.score_shipments(open_feat, base_classifier(d), base_duration(d))
    fl = scored.select("company_id", "product_id", "shipment_key", "supplier_id", "expected_delay_days",
                       F.col("delay_probability"), F.col("risk_tier").alias("delay_risk_tier"))
    impact = scn.shipment_impact(_inputs(d), fl.drop("delay_probability", "delay_risk_tier"))
    return impact.join(fl.select("company_id", "shipment_key", "delay_probability", "delay_risk_tier"),
                       ["company_id", "shipment_key"])


def _recs(d):
    health = inv.inventory_health(d.products, d.inventory_records, d.sales, d.shipments, d.suppliers)
    card = sup.supplier_scorecard(d.suppliers, d.shipments)
    return rec.merge_recommendations(rec.inventory_recommendations(health), rec.supplier_recommendations(card),
                                     rec.anomaly_recommendations(_merged(d, rec.ANOMALY_POOL)))


@query("recommendations_full")
def q_recommendations_full(d):
    """R4-R7 with both anomaly sources (z-score and isolation forest), top 30 per tenant."""
    return _recs(d)


@query("dashboard")
def q_dashboard(d):
    """K1/K3/K4: KPI row per tenant with shipment risk counts from the delay model over all shipments."""
    scored = dl.score_shipments(_serving(d), base_classifier(d))
    risk = dash.risk_distribution(scored)
    health = inv.inventory_health(d.products, d.inventory_records, d.sales, d.shipments, d.suppliers, carry=("unit_cost",))
    counts = dash.company_counts(d.companies, d.products, d.suppliers, d.sales, d.shipments)
    k = dash.dashboard_kpis(d.companies, dash.inventory_rollup(health), counts,
                            risk.select("company_id", "critical", "high"))
    return k.join(risk.select("company_id", F.col("critical").alias("risk_critical"), F.col("high").alias("risk_high"),
                              F.col("medium").alias("risk_medium"), F.col("low").alias("risk_low")),
                  "company_id", "left")
