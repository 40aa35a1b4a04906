"""Demand features (F1-F6) and the deterministic parts of the demand model.

Facts are first collapsed to one row per (company, product, day), so every
window below is partitioned by product over a *calendar* -- at most one row
per day however skewed the product's raw sales are. All lag and rolling
features share one window spec, i.e. one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import cut_lineage

LAGS = (1, 7, 14)
ROLLING_WINDOWS = (7, 14)
LAG_ROLL_COLUMNS = ([f"lag_{k}" for k in LAGS] + [f"rollmean_{w}" for w in ROLLING_WINDOWS]
                    + [f"rollstd_{w}" for w in ROLLING_WINDOWS])
CALENDAR_COLUMNS = ["day_of_week", "month", "is_weekend", "trend_index", "promotion"]
# Fixed feature order of the reference's model input.
FEATURE_COLUMNS = LAG_ROLL_COLUMNS + CALENDAR_COLUMNS
TEST_FRACTION = 0.2
VALIDATION_FRACTION = 0.25

PRODUCT = ("company_id", "product_id")


def daily_sales(sales: DataFrame, keys: Sequence[str] = PRODUCT, date_col: str = "sale_date") -> DataFrame:
    """Collapse duplicate (product, day) rows: sum quantity, max promotion (the reference would raise)."""
    promo = F.col("promotion") if "promotion" in sales.columns else F.lit(0)
    return (sales.groupBy(*keys, F.col(date_col).alias("date"))
            .agg(F.sum(F.col("quantity").cast("double")).alias("quantity"),
                 F.max(F.coalesce(promo.cast("int"), F.lit(0))).alias("promotion")))


def daily_densify(sales: DataFrame, keys: Sequence[str] = PRODUCT, date_col: str = "sale_date") -> DataFrame:
    """each product on a continuous daily calendar from its own first to last day; gaps -> 0."""
    daily = daily_sales(sales, keys, date_col)
    # every active day also makes the empty days up to the next one: no second scan and no join
    following = F.lead("date").over(Window.partitionBy(*keys).orderBy("date"))
    days = daily.withColumn("_last", F.coalesce(F.date_sub(following, 1), F.col("date")))
    days = days.select("*", F.explode(F.sequence("date", "_last", F.expr("INTERVAL 1 DAY"))).alias("_day"))
    active = F.col("_day") == F.col("date")
    return days.select(*keys, F.col("_day").alias("date"), F.when(active, F.col("quantity")).otherwise(0.0).alias("quantity"),
                       F.when(active, F.col("promotion")).otherwise(0).alias("promotion"))


def calendar_features(df: DataFrame, origin: str | Column | None = None) -> DataFrame:
    """day_of_week (Mon=0), month, is_weekend, trend_index = days since ``origin``.

    ``origin`` defaults to the frame's global first date (a scalar subquery);
    at serving time pass the *training* origin so the trend does not restart.
    """
    if origin is None:
        origin_col = df.select(F.min("date")).scalar()
    elif isinstance(origin, str):
        origin_col = F.lit(origin).cast("date")
    else:
        origin_col = origin
    return df.select(
        "*",
        F.weekday("date").alias("day_of_week"),
        F.month("date").alias("month"),
        (F.weekday("date") >= 5).cast("int").alias("is_weekend"),
        F.datediff(F.col("date"), origin_col).alias("trend_index"),
    )


def lag_roll_features(df: DataFrame, keys: Sequence[str] = PRODUCT, value: str = "quantity") -> DataFrame:
    """lags 1/7/14; trailing mean and sample std over 7/14 days excluding the current day.

    A rolling value exists only when its whole window is present (pandas min_periods).
    """
    w = Window.partitionBy(*keys).orderBy("date")
    cols = [F.lag(value, k).over(w).alias(f"lag_{k}") for k in LAGS]
    q = F.col(value).cast("double")
    for k in ROLLING_WINDOWS:
        fr = w.rowsBetween(-k, -1)
        full = F.count(q).over(fr) == k
        cols.append(F.when(full, F.avg(q).over(fr)).alias(f"rollmean_{k}"))
        cols.append(F.when(full, F.stddev_samp(q).over(fr)).alias(f"rollstd_{k}"))
    return df.select("*", *cols)


def demand_feature_matrix(sales: DataFrame, keys: Sequence[str] = PRODUCT, date_col: str = "sale_date",
                          origin=None) -> DataFrame:
    """Dense daily table with calendar, lag and rolling features, warm-up rows dropped."""
    dense = daily_densify(sales, keys, date_col)
    if origin is None:  # the first dense day is the first day of the facts
        origin = sales.select(F.min(date_col).cast("date")).scalar()
    feat = lag_roll_features(calendar_features(dense, origin), keys)
    return feat.dropna(subset=LAG_ROLL_COLUMNS)


def nearest_quantile_cutoff(df: DataFrame, date_col: str = "date", q: float = 1 - TEST_FRACTION,
                            group_cols: Sequence[str] = ("company_id",), weight_col: str | None = None) -> DataFrame:
    """Pandas ``quantile(q, interpolation='nearest')`` of the row dates, per group.

    Index = half-even round of (n - 1) * q (0-based) into the sorted dates.
    Rows are counted per (group, date) first (or ``weight_col`` already holds
    that count); the running count then runs over distinct dates only (a
    calendar, not the facts).
    """
    g = list(group_cols)
    c = F.sum(weight_col) if weight_col else F.count(F.lit(1))
    per_day = df.groupBy(*g, F.col(date_col).alias("_d")).agg(c.alias("_c"))
    w = (Window.partitionBy(*g) if g else Window.partitionBy(F.lit(0))).orderBy("_d") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per_day = per_day.withColumn("_cum", F.sum("_c").over(w))
    per_day = per_day.withColumn("_n", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding,
                                                                        Window.unboundedFollowing)))
    k = F.bround((F.col("_n") - 1) * F.lit(q), 0)
    return (per_day.where(F.col("_cum") >= k + 1)
            .groupBy(*g).agg(F.min("_d").alias("cutoff"), F.first("_n").alias("n_rows")))


def time_split(df: DataFrame, date_col: str = "date", test_fraction: float = TEST_FRACTION,
               group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """Adds ``cutoff`` and ``is_test`` (date >= cutoff) per group."""
    cut = nearest_quantile_cutoff(df, date_col, 1 - test_fraction, group_cols)
    g = list(group_cols)
    if g:
        j = df.join(F.broadcast(cut.select(*g, "cutoff")), g)  # a row a group
    else:  # one global cutoff: a scalar subquery, not a join
        j = df.withColumn("cutoff", cut.select("cutoff").scalar())
    return j.withColumn("is_test", F.col(date_col) >= F.col("cutoff"))


def split_summary(feat: DataFrame, group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """D1/D9 overview per group: outer cutoff, inner validation cutoff and the four row counts.

    Everything is derived from per-(group, date) row counts -- a calendar-sized
    frame -- so the feature matrix is read once.
    """
    g = list(group_cols)
    # calendar-sized and read five times below: materialise it once instead of re-reading the features
    per_day = cut_lineage(feat.groupBy(*g, "date").agg(F.count(F.lit(1)).alias("n")))
    outer = nearest_quantile_cutoff(per_day, "date", 1 - TEST_FRACTION, g, "n").select(*g, F.col("cutoff").alias("oc"))
    pd_o = per_day.join(outer, g)
    o = pd_o.groupBy(*g).agg(F.first("oc").alias("test_cutoff"),
                             F.sum(F.when(F.col("date") < F.col("oc"), F.col("n")).otherwise(0)).alias("train_rows"),
                             F.sum(F.when(F.col("date") >= F.col("oc"), F.col("n")).otherwise(0)).alias("test_rows"))
    train_days = pd_o.where(F.col("date") < F.col("oc")).drop("oc")
    inner = nearest_quantile_cutoff(train_days, "date", 1 - VALIDATION_FRACTION, g, "n") \
        .select(*g, F.col("cutoff").alias("ic"))
    i = (train_days.join(inner, g).groupBy(*g)
         .agg(F.first("ic").alias("validation_cutoff"),
              F.sum(F.when(F.col("date") < F.col("ic"), F.col("n")).otherwise(0)).alias("train_sub_rows"),
              F.sum(F.when(F.col("date") >= F.col("ic"), F.col("n")).otherwise(0)).alias("validation_rows")))
    return o.join(i, g, "left")


def mean_encoding(train: DataFrame, keys: Sequence[str] = PRODUCT, scope: Sequence[str] = ("company_id",),
                  value: str = "quantity") -> tuple[DataFrame, DataFrame]:
    """Per-product mean on the training split only, and the scope-wide (global) mean."""
    prod = train.groupBy(*keys).agg(F.avg(value).alias("product_mean_demand"))
    glob = train.groupBy(*scope).agg(F.avg(value).alias("global_mean_demand"))
    return prod, glob


def apply_mean_encoding(df: DataFrame, prod: DataFrame, glob: DataFrame, keys: Sequence[str] = PRODUCT,
                        scope: Sequence[str] = ("company_id",)) -> DataFrame:
    """Unseen products fall back to the global mean of their scope."""
    j = df.join(prod, list(keys), "left")
    if scope:
        j = j.join(glob, list(scope), "left")
    else:  # one pooled mean: a scalar subquery, not a join
        j = j.withColumn("global_mean_demand", glob.select("global_mean_demand").scalar())
    return (j.withColumn("product_mean_demand", F.coalesce(F.col("product_mean_demand"), F.col("global_mean_demand")))
            .drop("global_mean_demand"))


def regression_metrics(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ("company_id",)) -> DataFrame:
    """MAE, RMSE, MAPE (y > 1e-6 only, x100; none -> null), R^2 (null if y is constant)."""
    g = list(group_cols)
    yv, pv = F.col(y).cast("double"), F.col(p).cast("double")
    err = pv - yv
    agg = df.groupBy(*g).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(yv > 1e-6, F.abs(err / yv))) * 100).alias("mape"),
        F.sum(err * err).alias("_sse"),
        F.var_pop(yv).alias("_var"),
        F.countDistinct(yv).alias("_ny"),
    )
    r2 = F.when(F.col("_ny") > 1, F.lit(1.0) - F.col("_sse") / (F.col("_var") * F.col("rows")))
    return agg.withColumn("r2", r2).drop("_sse", "_var", "_ny")


def naive_baseline(test: DataFrame) -> DataFrame:
    """D3: seasonal naive prediction lag_7 clipped at 0."""
    return test.withColumn("baseline_pred", F.greatest(F.col("lag_7"), F.lit(0.0)))


def seasonal_naive_forecast(dense: DataFrame, horizon: int, keys: Sequence[str] = PRODUCT) -> DataFrame:
    """Repeat the last observed week: day T+h takes the value of day T-6+((h-1) mod 7).

    Each of the last 7 dense rows fans out to its horizon steps with
    ``explode(sequence(...))`` -- no join, no window.
    """
    if horizon not in (7, 30, 90) and not 1 <= horizon <= 366:
        raise ValueError("horizon must be within 1..366")
    last = dense.groupBy(*keys).agg(F.max("date").alias("_T"))
    tail = dense.join(last, list(keys)).where(F.col("date") > F.date_sub("_T", 7))
    off = F.datediff("date", F.date_sub("_T", 6))  # 0..6
    steps = tail.where(off + 1 <= horizon).select(*keys, "_T", F.col("quantity"),
                        F.explode(F.sequence(off + 1, F.lit(horizon), F.lit(7))).alias("step"))
    return steps.select(*keys, "step", F.date_add("_T", F.col("step")).alias("date"),
                        F.greatest(F.col("quantity"), F.lit(0.0)).alias("predicted_quantity"))
