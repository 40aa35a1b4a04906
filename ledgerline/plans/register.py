"""Registry of named queries: a Spark builder and (where SQL can express it) a DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import apply_defaults
from ledgerline.sources.testdata import SupplyChainData, fingerprint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_DATA_CACHE: dict[tuple[str, str, str], SupplyChainData] = {}


def data(spark: SparkSession, sf_dir: str) -> SupplyChainData:
    apply_defaults(spark)
    key = (spark.sparkContext.applicationId, sf_dir, fingerprint(spark, sf_dir))  # changed files are read anew
    if key not in _DATA_CACHE:
        _DATA_CACHE[key] = SupplyChainData(spark, sf_dir)
    return _DATA_CACHE[key]


def query(name: str, sql: str | None = None):
    """Register ``fn(d: SupplyChainData) -> DataFrame`` under ``name``."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(data(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from ledgerline.plans import analytics, features, ingest, modeling  # noqa: F401
