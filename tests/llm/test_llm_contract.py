import ast
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

TOP = Path(E.__file__).parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_one_query_for_each_operator():
    names = list(E.queries())
    assert [sum(bool(re.match(rf"op{n}_", x)) for x in names) for n in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(E.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    for path in TOP.glob("ledgerline/**/*.py"):
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("ledgerline.llm") or n == "corpus_pipeline" for n in names), path


@pytest.mark.parametrize("name", ["op2_pivot_topk", "op4_mixing", "op7_line_dedup", "op11_source_divergence", "op13_collocations"])
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_SMALL}/{t}.parquet'")
    theirs = con.execute(E.oracle_sql()[name]).df()
    ours = E.queries()[name](spark, SF_SMALL).toPandas()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (ours, theirs))
    assert len(a) == len(b) and all((a[c] == b[c]).all() for c in columns)
