import datetime as dt

from pyspark.sql import functions as F

from fixtures import SALES_SCHEMA, sales_small
from ledgerline.operators import demand_features as dfe


def _feat(spark, rows):
    return dfe.demand_feature_matrix(spark.createDataFrame(rows, SALES_SCHEMA))


def test_warmup_rows_dropped(spark):
    assert _feat(spark, sales_small()).count() == (60 - 14) * 2


def test_lag_1_is_yesterday(spark):
    df = dfe.lag_roll_features(dfe.daily_densify(spark.createDataFrame(sales_small(), SALES_SCHEMA)))
    r = {(x["product_id"], x["date"]): x for x in df.collect()}
    d = dt.date(2026, 1, 20)
    assert r[("P1", d)]["lag_1"] == r[("P1", d - dt.timedelta(days=1))]["quantity"]


def test_rolling_excludes_current_day(spark):
    rows = sales_small(40)
    spike = [(c, p, d, 999999.0 if (p == "P1" and d == dt.date(2026, 2, 9)) else q, pr) for c, p, d, q, pr in rows]
    a = {x["date"]: x for x in _feat(spark, rows).where("product_id = 'P1'").collect()}
    b = {x["date"]: x for x in _feat(spark, spike).where("product_id = 'P1'").collect()}
    last = dt.date(2026, 2, 9)
    assert abs(a[last]["rollmean_7"] - b[last]["rollmean_7"]) < 1e-9


def test_gap_filled_with_zero(spark):
    rows = [(1, "P1", dt.date(2026, 1, 1) + dt.timedelta(days=i), 50.0, 0) for i in range(30) if i != 15]
    dense = dfe.daily_densify(spark.createDataFrame(rows, SALES_SCHEMA))
    assert dense.count() == 30
    assert dense.where(F.col("date") == dt.date(2026, 1, 16)).first()["quantity"] == 0.0


def test_duplicate_day_rows_are_summed(spark):
    rows = [(1, "P1", dt.date(2026, 1, 1), 5.0, 0), (1, "P1", dt.date(2026, 1, 1), 7.0, 1)]
    d = dfe.daily_densify(spark.createDataFrame(rows, SALES_SCHEMA)).first()
    assert d["quantity"] == 12.0 and d["promotion"] == 1


def test_calendar(spark):
    df = dfe.calendar_features(dfe.daily_densify(spark.createDataFrame(sales_small(14), SALES_SCHEMA)))
    r = df.where((F.col("product_id") == "P1") & (F.col("date") == dt.date(2026, 1, 3))).first()
    assert r["day_of_week"] == 5 and r["is_weekend"] == 1 and r["trend_index"] == 2 and r["month"] == 1


def test_nearest_quantile_cutoff_matches_pandas(spark):
    import pandas as pd
    dates = [dt.date(2026, 1, 1) + dt.timedelta(days=i % 9) for i in range(37)]
    df = spark.createDataFrame([(1, d) for d in dates], "company_id int, date date")
    cut = dfe.nearest_quantile_cutoff(df, "date", 0.8).first()["cutoff"]
    expect = pd.Series(pd.to_datetime(dates)).quantile(0.8, interpolation="nearest").date()
    assert cut == expect


def test_seasonal_naive_repeats_last_week(spark):
    dense = dfe.daily_densify(spark.createDataFrame(sales_small(21, ("P1",)), SALES_SCHEMA))
    fc = {r["step"]: r["predicted_quantity"] for r in dfe.seasonal_naive_forecast(dense, 30).collect()}
    q = {r["date"]: r["quantity"] for r in dense.collect()}
    last = max(q)
    assert len(fc) == 30
    for h in (1, 7, 8, 30):
        assert fc[h] == q[last - dt.timedelta(days=6) + dt.timedelta(days=(h - 1) % 7)]
