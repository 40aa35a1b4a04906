"""Inventory intelligence (N1-N17): stock position, demand, supply and risk per product.

Everything is computed for all tenants and products in one plan:
products LEFT JOIN (latest stock, recent demand, best supplier, incoming supply),
each input an aggregate keyed by (company_id, product_id). The per-product
"last n records" statistics use a ``row_number() <= n`` filter, which Spark
turns into a partial ``WindowGroupLimit`` before the shuffle, so a product
holding a third of all sales still ships only n rows per map partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.exprs import (INVENTORY_TIERS, ceil_long, clip, logistic_tail, nullif_zero,
                                        present_keys, round_stable, tier)

KEY = ["company_id", "product_id"]

# Fixed parameters of the reference's heuristics.
SERVICE_FACTOR = 1.65
TARGET_HORIZON_DAYS = 30
OVERSTOCK_HORIZON_DAYS = 45
DEFAULT_LEAD_DAYS = 14.0
DEFAULT_RELIABILITY = 0.85
DEMAND_MEAN_RECORDS = 30
DEMAND_STD_RECORDS = 60

SALES_TIE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def latest_inventory(inventory: DataFrame, date_col: str = "record_date",
                     tie: Sequence[str] = ("warehouse_id",), sum_warehouses: bool = False) -> DataFrame:
    """Newest record per product (ties broken by ``tie`` descending).

    A hash aggregate with ``max_by`` (partial aggregation map-side, no sort).
    ``sum_warehouses=True`` instead sums the newest record of every warehouse.
    """
    tie = present_keys(inventory, tie, ("warehouse_id",))
    order = F.struct(F.col(date_col), *[F.col(t) for t in tie])
    if not sum_warehouses:
        return (inventory.groupBy(*KEY)
                .agg(F.max_by("inventory_level", order).alias("inventory_level"),
                     F.max(date_col).alias("inventory_date")))
    per_wh = (inventory.groupBy(*KEY, "warehouse_id")
              .agg(F.max_by("inventory_level", order).alias("inventory_level"),
                   F.max(date_col).alias("inventory_date")))
    return per_wh.groupBy(*KEY).agg(F.sum("inventory_level").alias("inventory_level"),
                                    F.max("inventory_date").alias("inventory_date"))


def recent_demand(sales: DataFrame, date_col: str = "sale_date", tie: Sequence[str] = SALES_TIE,
                  n_mean: int = DEMAND_MEAN_RECORDS, n_std: int = DEMAND_STD_RECORDS) -> DataFrame:
    """Mean of the newest ``n_mean`` records and sample std of the newest ``n_std``.

    Records, not days (as the reference). Null quantities are skipped.
    """
    n = max(n_mean, n_std)
    tie = present_keys(sales, tie, ("sale_id", "external_sale_id", "quantity"))
    w = Window.partitionBy(*KEY).orderBy(F.col(date_col).desc(), *[F.col(t).desc() for t in tie])
    top = (sales.select(*KEY, date_col, "quantity", *tie)
           .withColumn("rn", F.row_number().over(w))
           .filter(F.col("rn") <= n))
    q = F.col("quantity").cast("double")
    return top.groupBy(*KEY).agg(
        F.avg(F.when(F.col("rn") <= n_mean, q)).alias("daily_demand"),
        F.coalesce(F.stddev_samp(F.when(F.col("rn") <= n_std, q)), F.lit(0.0)).alias("demand_std"),
        F.count(F.when(F.col("rn") <= n_std, q)).alias("demand_records"),
    )


def best_supplier(shipments: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Among suppliers that shipped the product, the most reliable (nulls last, then lowest id)."""
    pairs = shipments.select(*KEY, "supplier_id").where(F.col("supplier_id").isNotNull()).distinct()
    sup = suppliers.select("company_id", "supplier_id", F.col("name").alias("supplier_name"),
                           F.col("lead_time_days").alias("supplier_lead_time_days"),
                           F.col("reliability").alias("supplier_reliability_raw"))
    w = Window.partitionBy(*KEY).orderBy(F.col("supplier_reliability_raw").desc_nulls_last(),
                                         F.col("supplier_id").asc())
    return (pairs.join(sup, ["company_id", "supplier_id"])
            .withColumn("rn", F.row_number().over(w))
            .filter("rn = 1").drop("rn"))


def incoming_supply(shipments: DataFrame) -> DataFrame:
    """Open shipments (no actual delivery): total quantity and earliest planned arrival."""
    return (shipments.where(F.col("actual_delivery").isNull())
            .groupBy(*KEY)
            .agg(F.sum(F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))).alias("incoming_quantity"),
                 F.min("planned_delivery").alias("next_arrival"),
                 F.count(F.lit(1)).alias("incoming_shipments")))


def inventory_inputs(products: DataFrame, inventory: DataFrame, sales: DataFrame, shipments: DataFrame,
                     suppliers: DataFrame, sales_date_col: str = "sale_date",
                     sales_tie: Sequence[str] = SALES_TIE, sum_warehouses: bool = False) -> DataFrame:
    """Unrounded per-product inputs of every inventory formula (products without data get zeros)."""
    base = products.select(*KEY, "external_product_id", F.col("name").alias("product_name"),
                           *([c for c in ("category", "unit_cost") if c in products.columns]))
    df = (base
          .join(latest_inventory(inventory, sum_warehouses=sum_warehouses), KEY, "left")
          .join(recent_demand(sales, sales_date_col, sales_tie), KEY, "left")
          .join(best_supplier(shipments, suppliers), KEY, "left")
          .join(incoming_supply(shipments), KEY, "left"))
    has_supplier = F.col("supplier_id").isNotNull()
    return df.select(
        *base.columns,
        F.coalesce("inventory_level", F.lit(0.0)).alias("inventory"),
        F.coalesce("daily_demand", F.lit(0.0)).alias("daily"),
        F.coalesce("demand_std", F.lit(0.0)).alias("std"),
        "supplier_id", "supplier_name",
        # `lead or 14` treats 0 as missing; reliability defaults only when null
        F.when(has_supplier, F.coalesce(nullif_zero("supplier_lead_time_days"), F.lit(DEFAULT_LEAD_DAYS)))
         .otherwise(F.lit(DEFAULT_LEAD_DAYS)).alias("lead"),
        F.coalesce("supplier_reliability_raw", F.lit(DEFAULT_RELIABILITY)).alias("reliability"),
        F.coalesce("incoming_quantity", F.lit(0.0)).alias("incoming"),
        "next_arrival",
    )


def inventory_metrics(inputs: DataFrame, delay_days: float | Column = 0.0) -> DataFrame:
    """N7-N13 on unrounded inputs; ``delay_days`` may be a column (per-row delay, R1)."""
    delay = delay_days if isinstance(delay_days, Column) else F.lit(float(delay_days))
    inv, daily, std, inc = F.col("inventory"), F.col("daily"), F.col("std"), F.col("incoming")
    df = inputs.withColumn("delay_days", delay.cast("double"))
    df = df.withColumn("eff_lead", F.greatest(F.lit(1.0), F.col("lead") + F.col("delay_days")))
    df = df.withColumn("safety", F.greatest(F.lit(0.0), F.lit(SERVICE_FACTOR) * std * F.sqrt("eff_lead")))
    df = df.withColumn("horizon", daily * F.col("eff_lead"))
    stockout = clip(logistic_tail((inv + inc - F.col("horizon") - F.col("safety"))
                                  / F.greatest(F.lit(1.0), daily * 2)), 0.0, 1.0)
    overstock = clip(F.greatest(F.lit(0.0), inv / F.greatest(F.lit(1.0), daily * OVERSTOCK_HORIZON_DAYS) - 1.0)
                     * 0.75, 0.0, 1.0)
    return df.select(
        "*",
        F.when(daily > 0, inv / daily).alias("coverage"),
        (daily * F.col("eff_lead") + F.col("safety")).alias("reorder_point"),
        F.greatest(F.lit(0.0), F.col("horizon") + F.col("safety") - inv - inc).alias("shortage"),
        stockout.alias("stockout_p"),
        overstock.alias("overstock_p"),
        ceil_long(F.greatest(F.lit(0.0), daily * TARGET_HORIZON_DAYS + F.col("safety") - inv - inc))
        .alias("order_qty"),
        # next arrival shifts by whole days of delay (date + timedelta keeps the day part)
        F.when(F.col("delay_days") != 0,
               F.date_add("next_arrival", F.floor("delay_days").cast("int")))
         .otherwise(F.col("next_arrival")).alias("next_arrival_delayed"),
    )


#: The assumptions that go with every answer, as JSON.
ASSUMPTIONS = '{"service_factor":1.65,"target_inventory_horizon_days":30,"overstock_horizon_days":45}'


def present_inventory(m: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """N14 presentation: the reference's rounding of every output field. ``carry``: further input columns to keep."""
    cols = [
        "company_id", "product_id", "external_product_id", "product_name",
        round_stable("inventory", 2).alias("inventory_level"),
        round_stable("daily", 2).alias("daily_demand"),
        round_stable("std", 2).alias("demand_std"),
        round_stable("coverage", 1).alias("inventory_coverage_days"),
        F.col("supplier_id").cast("long").alias("supplier_id"),
        "supplier_name",
        round_stable("reliability", 3).alias("supplier_reliability"),
        round_stable("lead", 1).alias("lead_time_days"),
        round_stable("delay_days", 1).alias("simulated_delay_days"),
        round_stable("eff_lead", 1).alias("effective_lead_time_days"),
        round_stable("incoming", 2).alias("incoming_quantity"),
        F.col("next_arrival_delayed").alias("next_arrival"),
        round_stable("safety", 2).alias("safety_stock"),
        round_stable("reorder_point", 2).alias("reorder_point"),
        F.col("order_qty").alias("recommended_order_quantity"),
        round_stable("stockout_p", 4).alias("stockout_probability"),
        tier("stockout_p", INVENTORY_TIERS).alias("stockout_risk"),
        round_stable("shortage", 2).alias("expected_shortage"),
        round_stable("overstock_p", 4).alias("overstock_probability"),
        tier("overstock_p", INVENTORY_TIERS).alias("overstock_risk"),
    ]
    category = F.col("category") if "category" in m.columns else F.lit(None).cast("string").alias("category")
    return m.select(*cols, category, F.lit(ASSUMPTIONS).alias("assumptions"), *carry)


def inventory_health(products, inventory, sales, shipments, suppliers, delay_days=0.0, carry: Sequence[str] = (), **kw) -> DataFrame:
    """N14 company inventory for every tenant and product (order by company, name for display)."""
    return present_inventory(
        inventory_metrics(inventory_inputs(products, inventory, sales, shipments, suppliers, **kw), delay_days), carry)


def inventory_summary(health: DataFrame) -> DataFrame:
    """Per-company rollup of the presented inventory rows."""
    hi = ["HIGH", "CRITICAL"]
    return health.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("products"),
        F.count(F.when(F.col("stockout_risk").isin(hi), 1)).alias("stockout_high"),
        F.count(F.when(F.col("overstock_risk").isin(hi), 1)).alias("overstock_high"),
        F.round(F.sum("inventory_level"), 2).alias("inventory_units"),
        F.round(F.avg("stockout_probability"), 4).alias("avg_stockout_probability"),
    )


def deliveries_daily(shipments: DataFrame) -> DataFrame:
    """Arrived quantity per (product, actual delivery day)."""
    return (shipments.where(F.col("actual_delivery").isNotNull())
            .groupBy(*KEY, F.col("actual_delivery").alias("day"))
            .agg(F.sum(F.coalesce(F.col("quantity").cast("double"), F.lit(0.0))).alias("delivered")))


def inventory_rollforward(sales: DataFrame, shipments: DataFrame, opening: DataFrame | None = None,
                          sales_date_col: str = "sale_date") -> DataFrame:
    """I_t = max(0, I_{t-1} + delivered_t - sold_t) per product over its event days.

    Closed form with S_t = I_0 + sum(net): I_t = S_t - min(0, min_{u<=t} S_u).
    Facts are pre-aggregated to (product, day) first, so each window partition
    holds at most one row per calendar day however skewed the product is.
    ``opening`` (company_id, product_id, opening_level) defaults to 0.
    """
    sold = (sales.groupBy(*KEY, F.col(sales_date_col).alias("day"))
            .agg(F.sum(F.col("quantity").cast("double")).alias("sold")))
    moves = (deliveries_daily(shipments).join(sold, KEY + ["day"], "full")
             .select(*KEY, "day", F.coalesce("delivered", F.lit(0.0)).alias("delivered"),
                     F.coalesce("sold", F.lit(0.0)).alias("sold")))
    if opening is not None:
        moves = moves.join(opening.select(*KEY, "opening_level"), KEY, "left")
    else:
        moves = moves.withColumn("opening_level", F.lit(0.0))
    w = Window.partitionBy(*KEY).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = moves.withColumn("s", F.coalesce("opening_level", F.lit(0.0))
                          + F.sum(F.col("delivered") - F.col("sold")).over(w))
    df = df.withColumn("m", F.min("s").over(w))
    return df.select(*KEY, "day", "delivered", "sold",
                     (F.col("s") - F.least(F.lit(0.0), F.col("m"))).alias("inventory_level"))
