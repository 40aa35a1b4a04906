import datetime as dt

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from fixtures import SALES_SCHEMA, SHIP_SCHEMA, SUPPLIER_SCHEMA, sales_model, shipments_model
from ledgerline.models import delay as dl
from ledgerline.models import demand as dm


@pytest.fixture(scope="module")
def demand_model(spark):
    sales = spark.createDataFrame(sales_model(), SALES_SCHEMA)
    return sales, dm.train_demand_model(sales, keys=("company_id", "product_id"), scope=(), n_estimators=10)


def test_demand_model_not_worse_than_naive(demand_model):
    _, m = demand_model
    comp = m.metrics["comparison"]
    assert comp[m.name]["mae"] <= comp["naive_seasonal_baseline"]["mae"] + 1e-6


def test_demand_model_refuses_tiny_data(spark):
    tiny = spark.createDataFrame(sales_model(10, ("P1",)), SALES_SCHEMA)
    with pytest.raises(ValueError):
        dm.train_demand_model(tiny, n_estimators=5)


def test_time_split_share(demand_model):
    _, m = demand_model
    share = m.metrics["test_rows"] / (m.metrics["train_rows"] + m.metrics["test_rows"])
    assert 0.1 <= share <= 0.3


def test_forecast_shape(spark, demand_model):
    sales, m = demand_model
    fc = dm.forecast_products(sales, m, 30).where("product_id = 'P1'").orderBy("step").collect()
    assert len(fc) == 30
    dates = [r["date"] for r in fc]
    assert all((b - a).days == 1 for a, b in zip(dates, dates[1:]))
    assert dates[0] == dt.date(2025, 1, 1) + dt.timedelta(days=400)
    assert all(r["predicted_quantity"] >= 0 for r in fc)
    with pytest.raises(ValueError):
        dm.forecast_products(sales, m, 12)


def test_unseen_product_uses_global_mean(spark, demand_model):
    sales, m = demand_model
    new = spark.createDataFrame([(1, "P_UNSEEN", dt.date(2025, 3, 1) + dt.timedelta(days=i), 60.0, 0) for i in range(40)],
                                SALES_SCHEMA)
    assert dm.forecast_products(new, m, 7).count() == 7


def test_forecast_equals_a_day_by_day_loop(spark, demand_model):
    """One product, a day at a time, from its own history."""
    sales, m = demand_model
    state = {r["product_id"]: r for r in dm.history_state(sales).collect()}
    means = {r["product_id"]: r["product_mean_demand"] for r in m.product_means.collect()}
    got = {}
    for r in dm.forecast_products(sales, m, 7).collect():
        got.setdefault(r["product_id"], {})[r["step"]] = r["predicted_quantity"]
    for product, r in state.items():
        h = list(r["history"])
        for step in range(1, 8):
            day = r["last_date"] + dt.timedelta(days=step)
            x = [h[-1], h[-7], h[-14], np.mean(h[-7:]), np.mean(h[-14:]), np.std(h[-7:], ddof=1), np.std(h[-14:], ddof=1),
                 day.weekday(), day.month, day.weekday() >= 5, (day - m.origin).days, 0, means[product]]
            h.append(max(0.0, float(m.model.predict(np.array([x], float))[0])))
            assert got[product][step] == pytest.approx(round(h[-1], 1), abs=0.051)


def test_stored_model_is_the_same(spark, demand_model, tmp_path):
    sales, m = demand_model
    dm.save_model(m, str(tmp_path / "m"))
    back = dm.load_model(spark, str(tmp_path / "m"))
    key = lambda r: (r["product_id"], r["step"])
    assert sorted(dm.forecast_products(sales, back, 7).collect(), key=key) == sorted(dm.forecast_products(sales, m, 7).collect(), key=key)
    assert back.metrics["selected_model"] == m.name and back.origin == m.origin


@pytest.fixture(scope="module")
def delay_models(spark):
    rows, sups = shipments_model()
    sh = spark.createDataFrame(rows, SHIP_SCHEMA).withColumn("shipment_key", F.col("shipment_key"))
    su = spark.createDataFrame(sups, SUPPLIER_SCHEMA)
    feat = dl.feature_frame(sh, su, scope=())
    return sh, su, dl.train_delay_classifier(feat, n_estimators=10), dl.train_duration_model(feat, n_estimators=10)


def test_delay_classifier_auc(delay_models):
    _, _, clf, _ = delay_models
    assert clf.metrics["comparison"][clf.name]["roc_auc"] > 0.55


def test_confusion_total_is_test_rows(delay_models):
    _, _, clf, _ = delay_models
    assert sum(clf.metrics["confusion_matrix_test"].values()) == clf.metrics["test_rows"]


def test_duration_trained_on_delayed_only(delay_models):
    sh, _, _, dur = delay_models
    delayed = sh.where(F.col("actual_delivery") > F.col("planned_delivery")).count()
    assert dur.metrics["train_rows"] + dur.metrics["test_rows"] == delayed


def test_scores_in_range_and_unreliable_riskier(spark, delay_models):
    sh, su, clf, dur = delay_models
    scored = dl.score_shipments(dl.serving_features(sh, su), clf, dur).collect()
    assert all(0 <= r["delay_probability"] <= 1 and r["expected_delay_days"] >= 0 for r in scored)
    by_sup = {}
    for r in scored:
        by_sup.setdefault(r["supplier_id"], []).append(r["delay_probability"])
    assert np.mean(by_sup[3]) > np.mean(by_sup[1])
    names = set(clf.feature_names)
    assert all(f["feature"] in names for r in scored for f in r["top_risk_factors"])
    assert all(len(r["top_risk_factors"]) <= 5 for r in scored)


def test_classifier_refuses_little_data(spark):
    rows, sups = shipments_model(30)
    feat = dl.feature_frame(spark.createDataFrame(rows, SHIP_SCHEMA), spark.createDataFrame(sups, SUPPLIER_SCHEMA))
    with pytest.raises(ValueError):
        dl.train_delay_classifier(feat, n_estimators=5)


def test_regressors_are_fitted_on_every_row_of_their_split(spark, delay_models, monkeypatch):
    """More training rows than FIT_ROWS: both demand fits take all; the fit of the delay length takes no sample either."""
    seen = []
    real = dm.fit

    def counted(spec, packed, n=None):
        seen.append(packed.rows)
        return real(spec, packed, 1)

    days = "sequence(date'2023-01-01', date'2023-12-31')"
    sales = spark.range(500).selectExpr("1L company_id", "concat('P', id) product_id", f"explode({days}) sale_date", "cast(id % 7 + 1 as double) quantity")
    sales = sales.withColumns({"is_promotion": F.lit(0), "promotion_flag": F.lit(0), "unit_price": F.lit(1.0)})
    monkeypatch.setattr(dm, "fit", counted)
    m = dm.train_demand_model(sales)
    assert m.metrics["train_rows"] > dm.FIT_ROWS and len(seen) == 3 and seen[0] == seen[1]
    assert seen[2] == m.metrics["train_rows"] and 0.7 * seen[2] < seen[0] < seen[2] and seen[0] > dm.FIT_ROWS

    def no_sample(*_):
        raise AssertionError("a regressor takes every row")

    monkeypatch.setattr(dl, "fit_sample", no_sample)
    sh, su, _, _ = delay_models
    assert dl.train_duration_model(dl.feature_frame(sh, su, scope=()), n_estimators=2).metrics["train_rows"] > 0


def test_duration_model_is_stored_and_read_back(spark, delay_models, tmp_path):
    sh, su, clf, dur = delay_models
    dl.save_model(dur, str(tmp_path / "d"))
    feat = dl.serving_features(sh, su)
    pick = lambda m: sorted((r["shipment_key"], r["expected_delay_days"]) for r in dl.score_shipments(feat, clf, m).collect())
    assert pick(dl.load_model(spark, str(tmp_path / "d"))) == pick(dur)


def test_factors_of_a_linear_model_report_raw_values(spark, delay_models):
    """Ranked by the coefficient on the standardised feature, shown with the value as it is."""
    from ledgerline.operators import shipment_features as sfe
    from pyspark.ml import Pipeline, PipelineModel

    sh, su, _, _ = delay_models
    feat = dl.feature_frame(sh, su, scope=())
    train = dl._weights(feat, ())
    encoder = Pipeline(stages=dl.encoder_stages()).fit(train)
    coded = encoder.transform(train).select("features", "label", "sample_weight")
    fitted = Pipeline(stages=dl.classifier_candidates(1.0)["logistic_regression"]).fit(coded)
    pm = PipelineModel(stages=encoder.stages + fitted.stages)
    scored = dl.score_shipments(feat, dl.DelayModel("logistic_regression", pm, dl.feature_names(pm))).collect()
    shown = [(r[f["feature"]], f["value"]) for r in scored for f in r["top_risk_factors"] if f["feature"] in sfe.NUMERIC_FEATURE_COLUMNS]
    assert shown and all(float(a) == pytest.approx(b) for a, b in shown)


def test_delay_training_keeps_one_narrow_copy_of_the_rows(spark, delay_models, monkeypatch):
    """What the trainings keep of the feature rows: model columns, labels and keys, once; and no other column changes a fit."""
    from pyspark.sql.classic.dataframe import DataFrame

    sh, su, clf, dur = delay_models
    feat = dl.feature_frame(sh, su, scope=()).withColumn("long_note", F.lit("x" * 500))
    kept, real = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: kept.append(self.columns) or real(self, *a))
    again = dl.train_delay_classifier(feat, n_estimators=10), dl.train_duration_model(feat, n_estimators=10)
    assert kept and not any("long_note" in c or "origin" in c for c in kept)
    assert sum("distance_km" in c for c in kept) == 2  # one a training
    assert [m.metrics["comparison"] for m in again] == [clf.metrics["comparison"], dur.metrics["comparison"]]


def test_independent_fits_run_side_by_side(spark):
    import threading

    from ledgerline.session import side_by_side

    meet = threading.Barrier(2, timeout=60)
    assert side_by_side(spark, {"a": lambda: (meet.wait(), spark.range(3).count())[1], "b": lambda: (meet.wait(), spark.range(4).count())[1]}) == {"a": 3, "b": 4}
    with pytest.raises(ZeroDivisionError):
        side_by_side(spark, {"a": lambda: 1 / 0, "b": lambda: 2})


@pytest.fixture(scope="module")
def many_shipments(spark):
    """150,000 completed shipments as training rows; their delay hangs on distance and reliability."""
    from ledgerline.operators import shipment_features as sfe

    u = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0
    df = spark.range(150_000).select(F.col("id").cast("string").alias("shipment_key"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("id", F.lit(700)).cast("int")).alias("order_date"),
                                     *[F.round(u(i), 2).alias(c) for i, c in enumerate(sfe.NUMERIC_FEATURE_COLUMNS)], F.concat(F.lit("m"), F.pmod("id", F.lit(3))).alias("transport_mode"),
                                     F.concat(F.lit("c"), F.pmod("id", F.lit(4))).alias("carrier"), u(99).alias("luck"))
    chance = 0.1 + 0.5 * (F.col("distance_km") > 0.6).cast("double") * (1 - F.col("supplier_reliability"))
    return df.withColumn("is_delayed", (F.col("luck") < chance).cast("double")).drop("luck")


def test_classifiers_are_fitted_on_every_row_of_their_split(spark, many_shipments, monkeypatch):
    """More training rows than FIT_ROWS: forest, boosting and regression take all of the inner split, the refit all of the training."""
    from pyspark.ml.classification import LogisticRegression

    seen, real, linear = [], dl.fit, LogisticRegression._fit
    monkeypatch.setattr(dl, "fit", lambda spec, packed, n=None: seen.append(packed.rows) or real(spec, packed, n))
    monkeypatch.setattr(LogisticRegression, "_fit", lambda self, df: seen.append(df.count()) or linear(self, df))
    m = dl.train_delay_classifier(many_shipments, n_estimators=3)
    n = m.metrics["train_rows"]
    assert n > dm.FIT_ROWS and len(seen) == 4 and seen[3] == n
    assert seen[0] == seen[1] == seen[2] and 0.7 * n < seen[0] < n and set(m.metrics["validation_auc"]) == set(dl.classifier_candidates(1.0))


def test_a_classifier_of_many_rows_scores_and_is_stored(spark, many_shipments, tmp_path, monkeypatch):
    for name in dl.CLASSIFIER_TREES:
        monkeypatch.setattr(dl, "_auc", lambda df, name=name: 0.0)
        monkeypatch.setattr(dl, "each_fit", lambda *_, name=name: {name: 1.0})
        clf = dl.train_delay_classifier(many_shipments, n_estimators=4)
        assert clf.name == name and clf.metrics["comparison"][name]["roc_auc"] > 0.6
        dl.save_model(clf, str(tmp_path / name))
        some = many_shipments.where("shipment_key < '2'").drop("is_delayed")
        pick = lambda m: sorted((r["shipment_key"], r["delay_probability"], tuple(map(tuple, r["top_risk_factors"]))) for r in dl.score_shipments(some, m).collect())
        assert pick(dl.load_model(spark, str(tmp_path / name))) == pick(clf)
        top = {f[0] for r in pick(clf) for f in r[2][:2]}
        assert top == {"distance_km", "supplier_reliability"} and all(0 <= r[1] <= 1 for r in pick(clf))
