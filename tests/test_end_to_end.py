"""Upload -> map -> import -> analytics on the imported tables only (no testdata line keys)."""
from pyspark.sql import functions as F

from ledgerline.models import delay as dl
from ledgerline.operators import inventory as inv
from ledgerline.operators import loading as ld
from ledgerline.operators import supplier as sup
from ledgerline.plans import ingest as ig
from ledgerline.plans.register import data

SF = "/root/testdata/sf0.001"


def test_imported_tables_feed_the_analytics(spark):
    d = data(spark, SF)
    sales, newp, counts = ld.load_sales(ig.mapped(d, "raw_sales"), 3, d.products)
    ships, newp2, _, _ = ld.load_shipments(ig.mapped(d, "raw_shipments"), None, d.products, d.suppliers)
    sups, _ = ld.upsert_suppliers(ig.mapped(d, "raw_suppliers"), None, d.suppliers, pos=["row_version", "row_key"])
    stock, _, _, _ = ld.load_inventory(ig.mapped(d, "raw_inventory"), None, d.products,
                                       spark.createDataFrame([], "company_id int, warehouse_id long, name string"))
    products = (d.products.select("company_id", F.col("product_id").cast("long"), "external_product_id", "name")
                .unionByName(newp.select("company_id", "product_id", "external_product_id", "name"))
                .unionByName(newp2.select("company_id", "product_id", "external_product_id", "name")))
    assert "l_orderkey" not in sales.columns and "l_orderkey" not in ships.columns
    health = inv.inventory_health(products, stock, sales, ships, sups)
    assert health.count() == products.count()
    assert health.where(F.col("inventory_level") > 0).count() > 0
    assert sup.supplier_scorecard(sups, ships).count() == sups.count()
    feat = dl.serving_features(ships, sups)
    assert feat.count() == ships.count()
    c = counts.first()
    assert c["imported"] + c["skipped"] == d.raw_sales.count()
