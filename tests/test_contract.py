import subprocess
import sys


def test_oracle_sql_needs_no_spark_session():
    code = "import __spark_entry__ as E; s = E.oracle_sql(); q = E.queries(); assert set(s) <= set(q); print(len(q))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=".", timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert "stockout_probability" in df.columns
