"""Demand model (D6-D11): fit/select/refit on distributed trees, recursive forecast, serving by registry.

Both candidates (random forest, gradient boosting) are grown by ``models.trees`` from every row of their split and chosen
on a time-based validation split. Forecasting steps whole Arrow batches of products through the horizon, the day's
features computed from the history array that each product carries.
"""

from __future__ import annotations

import datetime as dt
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.models import trees
from ledgerline.models.trees import Forest
from ledgerline.operators import demand_features as dfe
from ledgerline.session import new_folder, side_by_side

MODEL_FEATURES = dfe.FEATURE_COLUMNS + ["product_mean_demand"]
HISTORY_ROWS = 60
HORIZONS = (7, 30, 90)
MIN_USABLE_ROWS, MIN_TRAIN_ROWS, MIN_TEST_ROWS = 50, 20, 5
MIN_SALES_ROWS_TO_FORECAST = 20
SEED = 42
FIT_PARTITIONS = 8  # of a classifier's fit by MLlib: a boosted fit is hundreds of short jobs
FIT_ROWS = 100_000  # training rows up to which classifiers are MLlib's; beyond, its trees are grown by ``models.trees``


class InsufficientData(ValueError):
    """Raised when a data guard refuses to train; never fabricate scores instead."""


@dataclass
class DemandModel:
    name: str
    model: Forest
    origin: dt.date                 # training trend origin (first dense date)
    product_means: DataFrame        # (company_id, product_id, product_mean_demand) from the training split
    global_mean: float
    metrics: dict = field(default_factory=dict)
    keys: tuple = ("company_id", "product_id")


#: D6/D7 settings of the reference: trees, depth, rows of a leaf, learning rate.
CANDIDATES = {
    "random_forest": {"trees": 200, "depth": 10, "min_leaf": 3, "rate": None},
    "gradient_boosting": {"trees": 200, "depth": 3, "min_leaf": 1, "rate": 0.05},
}


def fit(spec: dict, packed: trees.Packed, n_estimators: int | None = None) -> Forest:
    """One candidate on all packed rows (``n_estimators`` overrides its tree count)."""
    n = n_estimators or spec["trees"]
    if spec["rate"] is None:
        return trees.fit_forest(packed, n, spec["depth"], spec["min_leaf"], SEED, spec.get("subset"))
    return trees.fit_boosted(packed, n, spec["depth"], spec["rate"], spec["min_leaf"], spec.get("logistic", False))


def each_fit(spark: SparkSession, packed: trees.Packed, fits: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Results of the candidates' fits: side by side where each takes few tasks (a boosted fit one), else one after the other."""
    if packed.rows <= trees.HELD_ROWS:
        return side_by_side(spark, fits)
    return {name: run() for name, run in fits.items()}


def model_columns() -> list[Column]:
    return [F.col(c) for c in MODEL_FEATURES]


def _encode(train: DataFrame, other: DataFrame, keys, scope):
    prod, glob = dfe.mean_encoding(train, keys, scope)
    if scope:
        return (dfe.apply_mean_encoding(train, prod, glob, keys, scope), dfe.apply_mean_encoding(other, prod, glob, keys, scope), prod, glob)
    known = F.lit(glob.first()[0]).cast("double")  # one number
    return (*(df.join(prod, list(keys), "left").withColumn("product_mean_demand", F.coalesce("product_mean_demand", known)) for df in (train, other)), prod, glob)


def fit_sample(df: DataFrame, keys) -> DataFrame:
    """Every row of ``df``, dealt by its keys over the parts of a fit by MLlib. (Nothing is left out; only the name is older.)"""
    return df.repartition(FIT_PARTITIONS, *keys)


def _mae(pred: DataFrame) -> float:
    return pred.select(F.avg(F.abs(F.greatest(F.col("prediction"), F.lit(0.0)) - F.col("quantity")))).first()[0]


def train_demand_model(sales: DataFrame, keys=("company_id", "product_id"), scope=(), date_col: str = "sale_date",
                       n_estimators: int | None = None) -> DemandModel:
    """One model over all of ``sales`` (pooled base model when ``scope`` is empty).

    The feature frame is persisted (MEMORY_AND_DISK) across the candidate fits
    and released at the end; lost executors just recompute it from lineage.
    Fits, means, splits and metrics cover all rows of their split.
    """
    keys, scope = list(keys), list(scope)
    feat = dfe.demand_feature_matrix(sales, keys, date_col).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = feat.count()
        if n < MIN_USABLE_ROWS:
            raise InsufficientData(f"demand model: {n} usable rows, at least {MIN_USABLE_ROWS} are needed")
        outer = dfe.time_split(feat, "date", dfe.TEST_FRACTION, scope)
        train_full = outer.where(~F.col("is_test")).drop("cutoff", "is_test")
        test = outer.where(F.col("is_test")).drop("cutoff", "is_test")
        sizes = outer.agg(F.count_if(~F.col("is_test")).alias("train"), F.count_if("is_test").alias("test")).first()
        n_train, n_test = sizes["train"], sizes["test"]
        if n_train < MIN_TRAIN_ROWS or n_test < MIN_TEST_ROWS:
            raise InsufficientData(f"demand model: the time split leaves {n_train} training and {n_test} test rows")
        inner = dfe.time_split(train_full, "date", dfe.VALIDATION_FRACTION, scope)
        sub = inner.where(~F.col("is_test")).drop("cutoff", "is_test")
        valid = inner.where(F.col("is_test")).drop("cutoff", "is_test")
        sub_e, val_e, _, _ = _encode(sub, valid, keys, scope or [])
        rows = [*keys, "date"]
        packed = trees.pack(sub_e, model_columns(), "quantity", rows)
        val_e = val_e.persist(StorageLevel.MEMORY_AND_DISK)
        val_maes = each_fit(sales.sparkSession, packed, {name: lambda spec=spec: _mae(trees.predicted(val_e, model_columns(), fit(spec, packed, n_estimators)))
                                                         for name, spec in CANDIDATES.items()})
        best = min(val_maes, key=val_maes.get)
        val_e.unpersist()
        tr_e, te_e, prod, glob = _encode(train_full, test, keys, scope or [])
        model = fit(CANDIDATES[best], trees.pack(tr_e, model_columns(), "quantity", rows), n_estimators)
        te_p = trees.predicted(te_e, model_columns(), model).withColumn("prediction", F.greatest("prediction", F.lit(0.0)))
        te_p = dfe.naive_baseline(te_p)
        g = [F.lit(1).alias("_all")]
        base = dfe.regression_metrics(te_p.select("*", *g), "quantity", "baseline_pred", ["_all"]).first()
        fin = dfe.regression_metrics(te_p.select("*", *g), "quantity", "prediction", ["_all"]).first()
        origin = sales.select(F.min(date_col)).first()[0]  # first dense day = calendar_features' origin
        global_mean = train_full.select(F.avg("quantity")).first()[0]
        metrics = {
            "selected_model": best, "train_rows": n_train, "test_rows": n_test,
            "comparison": {"naive_seasonal_baseline": {k: base[k] for k in ("mae", "rmse", "mape")},
                           best: {k: fin[k] for k in ("mae", "rmse", "mape")}},
            "validation_maes": val_maes,
        }
        prod = prod.persist(StorageLevel.MEMORY_AND_DISK)
        prod.count()
        return DemandModel(best, model, origin, prod, float(global_mean), metrics, tuple(keys))
    finally:
        feat.unpersist()


def metrics_frame(spark, m: DemandModel, scope_label: str = "base") -> DataFrame:
    """D8 metrics as rows: one per compared model (baseline and the selected one)."""
    rows = [(scope_label, name, m.metrics["selected_model"], float(v["mae"]), float(v["rmse"]),
             None if v["mape"] is None else float(v["mape"]), int(m.metrics["train_rows"]),
             int(m.metrics["test_rows"]), json.dumps(m.metrics["validation_maes"]))
            for name, v in m.metrics["comparison"].items()]
    schema = ("scope string, model string, selected_model string, mae double, rmse double, mape double, "
              "train_rows long, test_rows long, validation_maes string")
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------------------------------------
# D10/D11 recursive forecast
# ---------------------------------------------------------------------------------------------
def history_state(sales: DataFrame, keys=("company_id", "product_id"), date_col: str = "sale_date",
                  min_sales_rows: int = MIN_SALES_ROWS_TO_FORECAST) -> DataFrame:
    """Per product: the last 60 *dense* days (gaps -> 0, fixing the reference) as a sorted array.

    Products with fewer than ``min_sales_rows`` sales records are skipped (D11).
    Only each product's last 60 calendar days are materialised.
    """
    keys = list(keys)
    daily = sales.groupBy(*keys, F.col(date_col).alias("date")).agg(
        F.sum(F.col("quantity").cast("double")).alias("quantity"), F.count(F.lit(1)).alias("n"))
    # one row per active day and product, so a product's days are a calendar however many sales it has
    state = daily.groupBy(*keys).agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("n").alias("n_sales"),
                                     F.max_by("quantity", "date").alias("last_actual_quantity"),
                                     F.map_from_entries(F.collect_list(F.struct("date", "quantity"))).alias("days"))
    start = F.greatest(F.col("first_date"), F.date_sub("last_date", HISTORY_ROWS - 1))
    dense = F.transform(F.sequence(start, F.col("last_date"), F.expr("INTERVAL 1 DAY")),
                        lambda day: F.coalesce(F.try_element_at("days", day), F.lit(0.0)))
    return state.where(F.col("n_sales") >= min_sales_rows).select(*keys, "last_date", "last_actual_quantity", dense.alias("history"))


def _step_features(hist: np.ndarray, target: np.ndarray, origin: np.datetime64, means: np.ndarray) -> np.ndarray:
    """Features of the next day for a batch: hist is (n, L) with the newest value last."""
    n, L = hist.shape
    cols = []
    for k in dfe.LAGS:
        cols.append(hist[:, L - k] if L >= k else np.full(n, np.nan))
    for w in dfe.ROLLING_WINDOWS:
        win = hist[:, L - w:] if L >= w else np.full((n, w), np.nan)
        cols.append(win.mean(axis=1))
        cols.append(win.std(axis=1, ddof=1))
    # reorder to FEATURE_COLUMNS: lag_1, lag_7, lag_14, rollmean_7, rollmean_14, rollstd_7, rollstd_14
    lag1, lag7, lag14, m7, s7, m14, s14 = cols
    dow = ((target.astype("datetime64[D]").astype(np.int64) - 4) % 7).astype(np.float64)  # 1970-01-05 = Monday
    month = (target.astype("datetime64[M]").astype(np.int64) % 12 + 1).astype(np.float64)
    weekend = (dow >= 5).astype(np.float64)
    trend = (target.astype("datetime64[D]") - origin).astype(np.int64).astype(np.float64)
    promo = np.zeros(n)
    return np.column_stack([lag1, lag7, lag14, m7, m14, s7, s14, dow, month, weekend, trend, promo, means])


def _stepper(horizon: int, keys: list[str]) -> Callable[[pd.DataFrame, Forest, np.datetime64], pd.DataFrame]:
    """Steps a batch of products (keys, last_date, history, product_mean_demand) through the horizon."""

    def run(pdf: pd.DataFrame, forest: Forest, origin: np.datetime64) -> pd.DataFrame:
        hist = [np.asarray(h, dtype=np.float64)[-HISTORY_ROWS:] for h in pdf["history"]]
        longest = max(len(h) for h in hist)
        mat = np.full((len(pdf), longest), np.nan)
        for i, h in enumerate(hist):
            mat[i, longest - len(h):] = h
        means = pdf["product_mean_demand"].to_numpy(dtype=np.float64)
        last = pdf["last_date"].to_numpy().astype("datetime64[D]")
        preds = []
        for step in range(1, horizon + 1):
            p = np.clip(forest.predict(_step_features(mat, last + np.timedelta64(step, "D"), origin, means)), 0.0, None)
            preds.append(p)
            mat = np.column_stack([mat, p])
        rows = {k: np.repeat(pdf[k].to_numpy(), horizon) for k in keys}
        rows["step"] = np.tile(np.arange(1, horizon + 1, dtype=np.int32), len(pdf))
        rows["date"] = (np.repeat(last, horizon) + np.tile(np.arange(1, horizon + 1), len(pdf)).astype("timedelta64[D]")).astype(object)
        rows["predicted_quantity"] = np.round(np.stack(preds, axis=1).reshape(-1), 1)
        return pd.DataFrame(rows)

    return run


def _forecast_schema(state: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType([f for f in state.schema.fields if f.name in keys] + [T.StructField("step", T.IntegerType()), T.StructField("date", T.DateType()),
                                                                              T.StructField("predicted_quantity", T.DoubleType())])


def forecast(state: DataFrame, model: DemandModel, horizon: int) -> DataFrame:
    """Recursive multi-step forecast for every product of ``state`` (from ``history_state``).

    ``state`` must carry ``product_mean_demand`` (see ``forecast_products``).
    """
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    keys = list(model.keys)
    sent = state.sparkSession.sparkContext.broadcast(model.model)
    origin, step = np.datetime64(model.origin, "D"), _stepper(horizon, keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not pdf.empty:
                yield step(pdf, sent.value, origin)

    return state.mapInPandas(run, _forecast_schema(state, keys))


def forecast_products(sales: DataFrame, model: DemandModel, horizon: int, date_col: str = "sale_date",
                      model_source: str = "base", model_version: str | None = None) -> DataFrame:
    """Forecast every product with >= 20 sales records; unseen products use the global mean.

    Rows carry the last actual date and quantity and the serving model's name, source and version.
    """
    keys = list(model.keys)
    st = history_state(sales, keys, date_col)
    st = st.join(model.product_means, keys, "left").withColumn(
        "product_mean_demand", F.coalesce(F.col("product_mean_demand"), F.lit(model.global_mean)))
    fc = forecast(st, model, horizon)
    return (fc.join(st.select(*keys, "last_date", "last_actual_quantity"), keys)
            .withColumn("model_name", F.lit(model.name)).withColumn("model_source", F.lit(model_source))
            .withColumn("model_version", F.lit(model_version).cast("string")))


# ---------------------------------------------------------------------------------------------
# Stored models and serving by registry (G4/G7 -> D11)
# ---------------------------------------------------------------------------------------------
MODEL_ROW = "model_path string, name string, origin date, global_mean double, keys array<string>, metrics_json string, forest binary"
#: Products that a serving task steps together.
SERVED_TOGETHER = 2_000


def forest_bytes(forest: Forest) -> bytes:
    out = io.BytesIO()
    shares = {} if forest.importance is None else {"importance": forest.importance}
    np.savez_compressed(out, kind=np.array(forest.kind), base=forest.base, rate=forest.rate, feature=forest.feature.astype(np.int16),
                        threshold=forest.threshold, value=forest.value, **shares)
    return out.getvalue()


def forest_of(data: bytes) -> Forest:
    z = np.load(io.BytesIO(data), allow_pickle=False)
    return Forest(str(z["kind"]), float(z["base"]), float(z["rate"]), z["feature"].astype(np.int32), z["threshold"], z["value"], z["importance"] if "importance" in z else None)


def save_model(m: DemandModel, path: str) -> None:
    """A model is one row (name, origin, global mean, metrics, trees) and the product means of its training split."""
    spark = m.product_means.sparkSession
    m.product_means.write.mode("overwrite").parquet(f"{path}/product_means")
    row = (path, m.name, m.origin, float(m.global_mean), list(m.keys), json.dumps(m.metrics, default=float), bytearray(forest_bytes(m.model)))
    spark.createDataFrame([row], MODEL_ROW).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def load_model(spark, path: str) -> DemandModel:
    r = spark.read.schema(MODEL_ROW).parquet(f"{path}/model").first()
    return DemandModel(r["name"], forest_of(bytes(r["forest"])), r["origin"], spark.read.parquet(f"{path}/product_means"), r["global_mean"],
                       json.loads(r["metrics_json"]), tuple(r["keys"]))


def forecast_with_registry(sales: DataFrame, active: DataFrame, models: DataFrame, means: DataFrame, horizon: int,
                           keys=("company_id", "product_id"), date_col: str = "sale_date") -> DataFrame:
    """D11 for every tenant with the model G4 picked for it (own active model, else the base), in one job.

    ``active`` comes from ``governance.active_model``; ``models`` (MODEL_ROW, one row a stored model) and ``means``
    (model_path, keys, product_mean_demand) are the stored models' tables. Products meet their tenant's model in groups of
    about SERVED_TOGETHER, so a model that serves most tenants is sent to many tasks and no task holds more than that.
    """
    if horizon not in HORIZONS:
        raise ValueError(f"horizon must be one of {HORIZONS}")
    keys = list(keys)
    picks = active.select("company_id", "model_path", "model_source", "version")
    state = history_state(sales, keys, date_col).join(picks, "company_id").join(means, ["model_path", *keys], "left")
    head = models.select("model_path", F.col("name").alias("model_name"), "origin", "global_mean")
    state = state.join(head, "model_path").withColumn("product_mean_demand", F.coalesce("product_mean_demand", "global_mean"))
    served = state.groupBy("model_path").agg(F.ceil(F.count(F.lit(1)) / F.lit(SERVED_TOGETHER)).cast("long").alias("groups"))
    state = state.join(served, "model_path").withColumn("grp", F.pmod(F.xxhash64(*keys), F.col("groups")))
    sent = models.join(served, "model_path").select(F.col("model_path").alias("model_path"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp"),
                                                    F.col("forest").alias("forest"))
    step, carried = _stepper(horizon, keys), ["last_date", "last_actual_quantity", "model_name", "model_source", "version"]
    schema = T.StructType([*_forecast_schema(state, keys).fields, *[state.schema[c] for c in carried]])

    def serve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        out = step(left, forest_of(right["forest"].iloc[0]), np.datetime64(left["origin"].iloc[0], "D"))
        return pd.concat([out.reset_index(drop=True), left[carried].loc[left.index.repeat(horizon)].reset_index(drop=True)], axis=1)

    rows = state.select("model_path", "grp", *keys, "history", "product_mean_demand", "origin", *carried)
    out = rows.groupBy("model_path", "grp").cogroup(sent.groupBy("model_path", "grp")).applyInPandas(serve, schema)
    return out.withColumnRenamed("version", "model_version")


# ---------------------------------------------------------------------------------------------
# Every tenant's own model
# ---------------------------------------------------------------------------------------------
#: Feature rows of a tenant that one task may hold; larger tenants are grown by ``train_demand_model``.
GROUP_ROWS = 1_000_000
TENANT_ROW = ("company_id int, name string, origin date, global_mean double, train_rows long, test_rows long, metrics_json string, forest binary, "
              "product_id array<long>, product_mean array<double>, problem string")


def tenant_features(sales: DataFrame, date_col: str = "sale_date") -> DataFrame:
    """Features of every tenant's products with the part of their tenant's time splits they are in (0 sub, 1 valid, 2 test)
    and their mean demand in the sub and in the whole training split."""
    keys, scope = ["company_id", "product_id"], ["company_id"]
    path = new_folder(sales.sparkSession, "tenant-features")  # the two cutoffs, the means and the fits read them
    dfe.demand_feature_matrix(sales, keys, date_col).write.mode("overwrite").parquet(path)
    feat = sales.sparkSession.read.parquet(path)
    outer = dfe.time_split(feat, "date", dfe.TEST_FRACTION, scope)
    train = outer.where(~F.col("is_test")).drop("cutoff", "is_test")
    cut = dfe.nearest_quantile_cutoff(train, "date", 1 - dfe.VALIDATION_FRACTION, scope).select(*scope, F.col("cutoff").alias("inner"))
    parts = outer.join(F.broadcast(cut), scope, "left").withColumn("part", F.when(F.col("is_test"), 2).when(F.col("date") >= F.col("inner"), 1).otherwise(0))
    sub, whole = F.col("part") == 0, F.col("part") < 2
    mean = lambda by, cond: F.avg(F.when(cond, F.col("quantity")))
    means = parts.groupBy(*keys).agg(mean(keys, sub).alias("m_sub"), mean(keys, whole).alias("m_train"))
    glob = parts.groupBy(*scope).agg(mean(scope, sub).alias("g_sub"), mean(scope, whole).alias("g_train"), F.min("trend_index").alias("first_index"))
    return parts.join(means, keys).join(F.broadcast(glob), scope).drop("cutoff", "is_test", "inner")


def _fit_tenant(n_estimators: int | None) -> Callable[[tuple, pa.Table], pa.Table]:
    """D8/D9 on one tenant's features."""

    def errors(p: np.ndarray, y: np.ndarray) -> dict:
        e, some = p - y, y > 1e-6
        return {"mae": float(np.abs(e).mean()), "rmse": float(np.sqrt((e * e).mean())), "mape": float(np.abs(e[some] / y[some]).mean() * 100) if some.any() else None}

    def grow(spec: dict, x: np.ndarray, y: np.ndarray, key: np.ndarray) -> Forest:
        cuts = trees.cuts_of_group(x)
        held = trees.Packed(None, cuts, len(y))
        n, binned = n_estimators or spec["trees"], trees.bin_rows(x, cuts)
        if spec["rate"] is None:
            return trees.forest_of_group(binned, y, key, held.threshold, held.widths, n, spec["depth"], spec["min_leaf"], SEED)
        return trees.boosted_of_group(binned, y, held.threshold, held.widths, n, spec["depth"], spec["rate"], spec["min_leaf"])

    def train(t: pd.DataFrame) -> dict:
        t = t.sort_values(["product_id", "date"], kind="stable")
        part = t["part"].to_numpy()
        n_train, n_test = int((part < 2).sum()), int((part == 2).sum())
        if len(t) < MIN_USABLE_ROWS:
            return {"problem": f"demand model: {len(t)} usable rows, at least {MIN_USABLE_ROWS} are needed"}
        if n_train < MIN_TRAIN_ROWS or n_test < MIN_TEST_ROWS:
            return {"problem": f"demand model: the time split leaves {n_train} training and {n_test} test rows"}
        base, y, key = t[dfe.FEATURE_COLUMNS].to_numpy(float), t["quantity"].to_numpy(float), t["key"].to_numpy(np.int64)
        mean = lambda m, g: t[m].fillna(t[g]).to_numpy(float)
        x = np.column_stack([base, mean("m_sub", "g_sub")])
        sub, valid, test = part == 0, part == 1, part == 2
        maes = {name: float(np.abs(np.clip(grow(spec, x[sub], y[sub], key[sub]).predict(x[valid]), 0, None) - y[valid]).mean()) for name, spec in CANDIDATES.items()}
        best = min(maes, key=maes.get)
        x = np.column_stack([base, mean("m_train", "g_train")])
        forest = grow(CANDIDATES[best], x[~test], y[~test], key[~test])
        metrics = {"selected_model": best, "train_rows": n_train, "test_rows": n_test, "validation_maes": maes, "comparison": {
            "naive_seasonal_baseline": errors(np.clip(t["lag_7"].to_numpy(float)[test], 0, None), y[test]),
            best: errors(np.clip(forest.predict(x[test]), 0, None), y[test])}}
        known = t.loc[part < 2, ["product_id", "m_train"]].drop_duplicates("product_id")
        origin = (pd.to_datetime(t["date"].iloc[0]) - pd.Timedelta(days=int(t["trend_index"].iloc[0]))).date()
        return {"name": best, "origin": origin, "global_mean": float(t["g_train"].iloc[0]), "train_rows": n_train, "test_rows": n_test,
                "metrics_json": json.dumps(metrics), "forest": forest_bytes(forest), "product_id": known["product_id"].tolist(), "product_mean": known["m_train"].tolist()}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            found = train(pdf)
        except Exception as e:  # noqa: BLE001 - one tenant's failure is its outcome and never loses the others' fits
            found = {"problem": f"{type(e).__name__}: {e}"}
        empty = dict.fromkeys(["name", "origin", "global_mean", "train_rows", "test_rows", "metrics_json", "forest", "product_id", "product_mean", "problem"])
        return pd.DataFrame([{"company_id": key[0], **empty, **found}])

    return run


def train_tenant_models(sales: DataFrame, tenants: DataFrame, date_col: str = "sale_date", n_estimators: int | None = None) -> DataFrame:
    """D8 for each of ``tenants`` (company_id) whose features one task can hold, all in one job: TENANT_ROW rows with the
    fitted model or the problem that kept it from being fitted."""
    # broadcast, a row a tenant: otherwise all sales of a tenant meet in one task before they are summed by day
    feat = tenant_features(sales.join(F.broadcast(tenants.select("company_id")), "company_id", "left_semi"), date_col)
    feat = feat.withColumn("key", F.xxhash64("company_id", "product_id", "date")).withColumn("company_id", F.col("company_id").cast("int"))
    return feat.groupBy("company_id").applyInPandas(_fit_tenant(n_estimators), TENANT_ROW)
