import datetime as dt

from fixtures import SHIP_SCHEMA, shipments_small
from ledgerline.operators import shipment_features as sfe


def _fm(spark, rows, **kw):
    df = spark.createDataFrame(rows, SHIP_SCHEMA)
    df = df.withColumn("supplier_lead_time_days", df.quantity * 0 + 7).withColumn("supplier_reliability", df.quantity * 0 + 0.8) \
           .withColumn("supplier_cost_index", df.quantity * 0 + 1.0)
    return {r["shipment_key"]: r for r in sfe.shipment_feature_matrix(df, **kw).collect()}


def test_labels(spark):
    f = _fm(spark, shipments_small())
    assert f["S0"]["is_delayed"] == 1.0 and f["S0"]["delay_days"] == 5
    assert f["S1"]["is_delayed"] == 0.0 and f["S1"]["delay_days"] == 0


def test_route_rate_excludes_self(spark):
    assert abs(_fm(spark, shipments_small())["S3"]["historical_route_delay_rate"] - 1 / 3) < 1e-9


def test_previous_outcome_one_back(spark):
    f = _fm(spark, shipments_small())
    assert f["S1"]["previous_shipment_delayed"] == 1.0 and f["S2"]["previous_shipment_delayed"] == 0.0


def test_first_shipment_defaults(spark):
    f = _fm(spark, shipments_small())
    assert f["S0"]["previous_shipment_delayed"] == 0.0 and 0 <= f["S0"]["historical_route_delay_rate"] <= 1


def test_in_flight_excluded_by_default(spark):
    rows = shipments_small()
    rows[-1] = rows[-1][:13] + (None,) + rows[-1][14:]
    assert len(_fm(spark, rows)) == 9 and len(_fm(spark, rows, completed_only=False)) == 10


def test_later_outcome_does_not_leak(spark):
    rows = shipments_small()
    before = _fm(spark, rows)["S2"]["historical_route_delay_rate"]
    last = rows[-1]
    rows[-1] = last[:13] + (last[12] + dt.timedelta(days=99),) + last[14:]
    assert _fm(spark, rows)["S2"]["historical_route_delay_rate"] == before


def test_prior_modes_on_same_day_ties(spark):
    """Two shipments on one day: row_prior lets the first feed the second; strict_prior does not;
    known_prior only counts outcomes delivered before the order day."""
    rows = shipments_small(4)
    rows[2] = rows[2][:11] + (rows[1][11], rows[1][12], rows[1][13]) + rows[2][14:]  # S2 ordered with S1
    base = spark.createDataFrame(rows, SHIP_SCHEMA)
    df = sfe.mask_labels(sfe.delay_labels(base)).withColumn("route", sfe.route_key())
    out = {}
    for mode in ("row_prior", "strict_prior", "known_prior"):
        r = sfe.prior_rate(df, ["company_id", "route"], "rate", mode).collect()
        out[mode] = {x["shipment_key"]: x["rate"] for x in r}
    assert out["row_prior"]["S2"] == 0.5          # S0 (late) and S1 (on time, same day, earlier tie key)
    assert out["strict_prior"]["S2"] == 1.0       # only S0
    assert out["known_prior"]["S1"] is None       # S0 arrives 01-13, after S1 is ordered (01-11)
    assert abs(out["known_prior"]["S3"] - 1 / 3) < 1e-12  # S0 late, S1 and S2 on time, all delivered by 01-31


def test_new_input_gives_new_answers_in_the_same_folder(spark, tmp_path):
    """Derived tables are kept by input files and sources, not by path alone."""
    import shutil
    from pathlib import Path

    from tests.conftest import SF_SMALL
    from ledgerline.plans.register import data

    root = tmp_path / "in"
    root.mkdir()  # the given folder and its files may be read-only
    for path in Path(SF_SMALL).glob("*.parquet"):
        shutil.copyfile(path, root / path.name)
    before = data(spark, str(root)).suppliers.count()
    few = spark.read.parquet(f"{root}/supplier.parquet").limit(3).toPandas()
    (root / "supplier.parquet").unlink()
    few.to_parquet(root / "supplier.parquet")
    assert before > 3 and data(spark, str(root)).suppliers.count() == 3


def test_labels_and_keys_do_not_travel_with_the_histories(spark, monkeypatch):
    """What follows from other columns is left out of the shuffled rows and made again behind: same features, same key."""
    from types import SimpleNamespace

    from fixtures import SUPPLIER_SCHEMA, shipments_model
    from ledgerline.plans import features as pf

    seen, real = [], sfe.with_histories
    monkeypatch.setattr(sfe, "with_histories", lambda df, *a, **k: seen.append(set(df.columns)) or real(df, *a, **k))
    rows, sups = shipments_model(60)
    ships = spark.createDataFrame(rows, SHIP_SCHEMA).selectExpr("* EXCEPT (shipment_key)", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, supplier_id) AS shipment_key")
    made = pf._build_ship_features(SimpleNamespace(unkeyed_shipments=ships.drop("shipment_key"), suppliers=spark.createDataFrame(sups, SUPPLIER_SCHEMA)))
    assert len(seen) == 1 and not seen[0] & {"shipment_key", "delay_days", "target_is_delayed"} and "is_delayed_obs" in seen[0]
    want = ships.selectExpr("shipment_key", "datediff(actual_delivery, planned_delivery) AS delay_days")
    got = made.selectExpr("shipment_key", "delay_days")
    assert got.count() == 60 and got.exceptAll(want).count() == 0
    assert made.where("is_delayed IS DISTINCT FROM CAST(delay_days > 0 AS DOUBLE)").count() == 0
