"""Anomaly detection (A1, A3): per-product z-scores and the merged ranking.

A1 is a ``groupBy`` of mean/std joined back to the facts, not a partition
window: the aggregate runs map-side, and the join either broadcasts the
per-product statistics (when AQE measures them small) or shuffles with AQE
skew splitting, so one giant product never lands in a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Z_THRESHOLD = 3.0
Z_EPS = 1e-9
DEMAND_EXPLANATION = "Daily demand is materially different from the product's recent distribution (Z-score > 3)."
SHIPMENT_EXPLANATION = ("Shipment profile is multidimensionally anomalous compared to historical averages "
                        "(IsolationForest).")


def daily_product_demand(sales: DataFrame, date_col: str = "sale_date") -> DataFrame:
    """One demand record per (company, product, day): the day's total quantity."""
    return (sales.groupBy("company_id", "product_id", F.col(date_col).alias("date"))
            .agg(F.sum(F.col("quantity").cast("double")).alias("quantity")))


def zscore_anomalies(records: DataFrame, group_cols: Sequence[str] = ("company_id", "product_id"),
                     record_col: str = "date", date_col: str = "date", value_col: str = "quantity",
                     threshold: float = Z_THRESHOLD) -> DataFrame:
    """A1: |z| > threshold within each group, z = (x - mean) / (std_samp + 1e-9)."""
    g = list(group_cols)
    x = F.col(value_col).cast("double")
    stats = records.groupBy(*g).agg(F.avg(x).alias("_mu"), F.stddev_samp(x).alias("_sd"))
    df = records.join(stats, g)
    z = (x - F.col("_mu")) / (F.col("_sd") + F.lit(Z_EPS))
    df = df.withColumn("abs_z", F.abs(z)).where(F.col("abs_z") > threshold)
    score = F.col("abs_z") / 10.0
    sev = F.when(score > 0.4, "CRITICAL").when(score > 0.35, "HIGH").otherwise("MEDIUM")
    return df.select(
        *g,
        F.lit("product").alias("entity_type"),
        F.col(g[-1]).cast("string").alias("entity_id"),
        F.col(record_col).cast("string").alias("record_id"),
        F.col(date_col).cast("date").alias("date"),
        F.lit("demand").alias("metric"),
        F.round(x, 2).alias("value"),
        F.round(score, 4).alias("score"),
        sev.alias("severity"),
        F.lit(DEMAND_EXPLANATION).alias("explanation"),
    )


def merged_ranking(*anomaly_frames: DataFrame, limit: int = 100) -> DataFrame:
    """A3: union of anomaly sources, top ``limit`` per company by score (ties: source, record)."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be within 1..500")
    frames = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(anomaly_frames)]
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    w = Window.partitionBy("company_id").orderBy(F.col("score").desc(), F.col("_src"), F.col("entity_id"),
                                                 F.col("record_id"))
    return u.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit).drop("_src")
