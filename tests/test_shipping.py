import os
import subprocess
import sys
import textwrap

from conftest import SF_SMALL


def test_python_tasks_find_the_package_from_another_folder(tmp_path):
    """Only the driver has the sources on its path; the workers get them from the session."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {top!r})
        from ledgerline.session import build_session
        spark = build_session("local[2]", shuffle_partitions=2, extra={{"spark.driver.memory": "2g"}})
        import __spark_entry__ as E
        from ledgerline.operators import mapping as mp
        m = mp.suggest_mapping(mp.headers_of(spark, [(1, "sales", ["SKU", "quantitys"])]))
        print("GOT", mp.mapping_dict(m, 1), E.queries()["mapped_raw_sales"](spark, {SF_SMALL!r}).columns)
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "'quantitys': 'quantity'" in r.stdout, r.stderr[-2000:]
