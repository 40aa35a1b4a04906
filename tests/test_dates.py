"""Date forms of uploads against pandas, which the reference parses them with."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerline.functions.exprs import to_date_lenient

GOOD = ["2026-02-01", "01-Feb-2026", "2026-02-01T10:00:00Z", "2026-2-1", "2026-02-01 10:00:00.123", "2026/02/01", "2026.02.01", "20260201",
        "02/01/2026", "13/02/2026", "2/1/2026 3:04 PM", "1 February 2026", "1st Feb 2026", "Feb 1, 2026", "February 1 2026", "2026-Feb-01",
        "Mon, 02 Feb 2026", "2026-02-01T10:00:00+02:00", "02-01-2026", "2026-02-01 10:00", "01 Feb 26", "02/01/26", "02/01/70", "5 Jan 95", " 2026-02-01 "]
BAD = ["not-a-date", "", "2026-13-45", "2026-02-30", "31/31/2026", "n/a", "2026-02-01 99:99", None]


@pytest.mark.filterwarnings("ignore")
def test_forms_equal_pandas(spark):
    df = spark.createDataFrame([(x,) for x in GOOD + BAD], "x string")
    got = {r["x"]: r["d"] for r in df.select("x", to_date_lenient("x").alias("d")).collect()}
    for x in GOOD:
        assert got[x] == pd.to_datetime(x.strip()).date(), x
    assert all(got[x] is None for x in BAD)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("2026-02-01",)], "x string").select(F.sum(F.year(to_date_lenient("x"))))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
