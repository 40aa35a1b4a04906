"""Public-dataset preparation (S8-S10): order tables -> shipment and daily-sales schemas.

Order status 'F' plays the e-commerce "delivered"; the estimated and actual
delivery dates the order table lacks are derived by integer arithmetic on the
order key (synthetic, as in the test adapters).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Constants the reference writes into every prepared shipment row.
PREP_CONSTANTS = {
    "product_id": "mixed", "supplier_id": "mixed", "origin": "Olist Warehouse", "destination": "Customer",
    "carrier": "Correios", "transport_mode": "road", "distance_km": 500.0, "weight_kg": 2.0, "quantity": 1.0,
    "supplier_lead_time_days": 2.0, "supplier_reliability": 0.9, "supplier_cost_index": 1.0,
}
DELIVERED_STATUS = "F"


def order_dates(orders: DataFrame) -> DataFrame:
    """Purchase, estimated and delivered dates of each order."""
    k = F.col("o_orderkey")
    purchase = F.col("o_orderdate").cast("date")
    return orders.select(
        k.alias("order_id"), F.col("o_orderstatus").alias("order_status"),
        purchase.alias("purchase_date"),
        F.date_add(purchase, (F.lit(7) + k % 5).cast("int")).alias("estimated_delivery_date"),
        F.date_add(purchase, (F.lit(3) + k % 11).cast("int")).alias("delivered_date"))


def prep_shipments(orders: DataFrame) -> DataFrame:
    """Delivered orders with all three dates present, in the shipment schema."""
    o = order_dates(orders).where(F.col("order_status") == DELIVERED_STATUS) \
        .dropna(subset=["delivered_date", "estimated_delivery_date", "purchase_date"])
    const = [F.lit(v).alias(k) for k, v in PREP_CONSTANTS.items()]
    return o.select(F.col("order_id").cast("string").alias("shipment_id"), *const,
                    F.col("purchase_date").alias("order_date"),
                    F.col("estimated_delivery_date").alias("planned_delivery"),
                    F.col("delivered_date").alias("actual_delivery"))


def prep_daily_sales(items: DataFrame, orders: DataFrame) -> DataFrame:
    """Items joined to their orders (no status filter), item count per (product, purchase day)."""
    o = orders.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").cast("date").alias("date"))
    i = items.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"))
    return (i.join(o, "order_id").groupBy("product_id", "date").agg(F.count(F.lit(1)).cast("double").alias("quantity"))
            .withColumn("promotion", F.lit(0)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_cols=()) -> None:
    """Processed table sink (parquet by default; csv with a header row)."""
    w = df.write.mode("overwrite")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)
