"""Raw uploads (S1): read delimited/columnar files as all-string frames with stripped headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tabular(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """CSV (header row, every column a string, no inference), parquet or JSON.

    Header names are stripped but keep their case; all values become strings
    so that parsing is an explicit, null-on-failure step (``try_cast``).
    Excel is not read here: convert to CSV/parquet upstream.
    """
    fmt = fmt or ("csv" if path.lower().endswith((".csv", ".txt")) else
                  "json" if path.lower().endswith((".json", ".jsonl")) else "parquet")
    if fmt == "csv":
        df = (spark.read.option("header", True).option("inferSchema", False)
              .option("mode", "PERMISSIVE").option("multiLine", False).csv(path))
    elif fmt == "json":
        df = spark.read.option("primitivesAsString", True).json(path)
    else:
        df = spark.read.format(fmt).load(path)
    renamed = df.toDF(*[c.strip() for c in df.columns])
    return renamed.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in renamed.columns])
