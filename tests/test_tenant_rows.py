"""Tables of a row a tenant are broadcast and histories need one shuffle of the rows, so disk grows with the input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fixtures import SHIP_SCHEMA, shipments_small
from ledgerline.functions import metrics as met
from ledgerline.operators import demand_features as dfe
from ledgerline.operators import shipment_features as sfe


@pytest.fixture
def planned(spark):
    """The physical plan where no table is small enough to be broadcast by its size."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set(key, before)


def _ships(spark):
    df = spark.createDataFrame(shipments_small(), SHIP_SCHEMA)
    return df.withColumns({"supplier_lead_time_days": F.lit(7.0), "supplier_reliability": F.lit(0.8), "supplier_cost_index": F.lit(1.0)})


def test_feature_matrix_joins_nothing_by_sorting(spark, planned):
    """rows met their tenant's rate and both histories in sort-merge joins."""
    assert "SortMergeJoin" not in planned(sfe.shipment_feature_matrix(_ships(spark)))


def test_tenant_cutoffs_are_broadcast(spark, planned):
    """each split sorted all rows by tenant."""
    assert "SortMergeJoin" not in planned(dfe.time_split(_ships(spark), "order_date"))


@pytest.mark.parametrize("scope", [("company_id",), ()])
def test_class_weights_are_broadcast(spark, planned, scope):
    """All rows met two weights by (scope, label), pooled ones in two tasks."""
    assert "SortMergeJoin" not in planned(sfe.balanced_weights(sfe.delay_labels(_ships(spark)), "target_is_delayed", scope))


def test_majority_classes_are_broadcast(spark, planned):
    """the test rows were sorted by tenant to meet one class each."""
    df = sfe.delay_labels(_ships(spark))
    plan = planned(met.majority_baseline(df, df, "target_is_delayed").select("true_positive", "majority_class"))
    assert plan.count("SortMergeJoin") <= 1  # metrics with classes: a row a tenant on both sides


def test_histories_equal_a_plain_walk(spark):
    """Several groups in one shuffle, with ties, gaps, rows without group or date."""
    rows = []
    for i in range(60):
        day = None if i % 7 == 3 else dt.date(2001, 1, 1 + i * 5 % 11)
        rows.append((i % 2, f"r{i % 3}", None if i % 5 == 0 else i % 4, day, i, None if i % 9 == 4 else float(i % 4 == 1)))
    df = spark.createDataFrame(rows, "company_id int, route string, sup int, order_date date, id int, is_delayed_obs double")
    out = sfe.with_histories(df, ["company_id"], [(F.upper("route"), "a", "pa"), ("sup", "b", "pb")], tie=("id",))
    assert sorted(out.columns) == sorted([*df.columns, "a", "pa", "b", "pb"])
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(rows) == out.count()
    far = dt.date(9999, 12, 31)
    for company, route, sup, day, i, _ in rows:
        for at, group, rate, prev in ((1, route, "a", "pa"), (2, sup, "b", "pb")):
            seen = sorted((r for r in rows if r[0] == company and group is not None and r[at] == group and r[3] is not None
                           and (r[3], r[4]) < (day or far, i)), key=lambda r: (r[3], r[4]))
            known = [r[5] for r in seen if r[5] is not None]
            assert got[i][rate] == (sum(known) / len(known) if known else None), (i, rate)
            assert got[i][prev] == (seen[-1][5] if seen else None), (i, prev)


def test_rows_without_a_tenant_see_their_day_only(spark):
    rows = [(None, "r", dt.date(2001, 1, 1), 1, 1.0), (None, "r", dt.date(2001, 1, 2), 2, 0.0), (None, "r", dt.date(2001, 1, 2), 3, 1.0)]
    df = spark.createDataFrame(rows, "company_id int, route string, order_date date, id int, is_delayed_obs double")
    got = {r["id"]: r["rate"] for r in sfe.with_history(df, ["company_id"], "route", "rate", tie=("id",)).collect()}
    assert got == {1: None, 2: None, 3: 0.0}
