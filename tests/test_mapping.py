from ledgerline.operators import mapping as mp


def _suggest(spark, dtype, headers):
    m = mp.suggest_mapping(mp.headers_of(spark, [(1, dtype, headers)]))
    return mp.mapping_dict(m, 1), m


def test_normalized_headers(spark):
    df = spark.createDataFrame([("Qty_Sold",), (" Unit-Price ",), ("Größe №1",), ("",)], "h string")
    assert [r[0] for r in df.select(mp.normalize_header_col("h")).collect()] == ["qtysold", "unitprice", "größe1", ""]


def test_similar_headers_choose_in_order(spark):
    """Two headers near the same field: the first by position takes it, the other its next best or none."""
    m, full = _suggest(spark, "sales", ["quantitys", "quantityy", "Region", "regions", "zzz"])
    assert m["quantitys"] == "quantity" and m["quantityy"] is None and m["Region"] == "region" and m["zzz"] is None
    by = {r["header"]: r for r in full.collect()}
    assert by["quantitys"]["method"] == "fuzzy" and 0.72 <= by["quantitys"]["score"] < 1 and by["Region"]["score"] == 1.0


def test_any_number_of_headers(spark):
    m, _ = _suggest(spark, "sales", [f"x{i}" for i in range(5000)] + ["SKU"])
    assert m["SKU"] == "product_id" and sum(v is not None for v in m.values()) == 1


def test_sales_exact_and_alias(spark):
    m, _ = _suggest(spark, "sales", ["SKU", "Qty_Sold", "Date", "Region", "Unit_Price"])
    assert m == {"SKU": "product_id", "Qty_Sold": "quantity", "Date": "date", "Region": "region",
                 "Unit_Price": "price"}


def test_inventory_unknown_header_stays_unmapped(spark):
    m, _ = _suggest(spark, "inventory", ["Product_ID", "Stock", "Delivery_Days", "Date"])
    assert m["Product_ID"] == "product_id" and m["Stock"] == "inventory_level" and m["Date"] == "date"
    assert m["Delivery_Days"] is None


def test_no_target_used_twice(spark):
    m, _ = _suggest(spark, "shipments", ["shipment_id", "product_id", "carrier", "Carrier_Name"])
    targets = [v for v in m.values() if v]
    assert len(targets) == len(set(targets))
    assert m["carrier"] == "carrier"


def test_fuzzy_pass_and_gaps(spark):
    m, full = _suggest(spark, "shipments", ["Shipment_No", "SKU", "Ship_From", "Ship_To", "ETA", "Order_Date"])
    assert m["Order_Date"] == "order_date"          # reached by the fuzzy pass
    gaps = [r["field"] for r in mp.unmapped_required(full).collect()]
    assert gaps == ["actual_delivery"]


def test_multiple_feeds_in_one_job(spark):
    hdr = mp.headers_of(spark, [(1, "sales", ["SKU", "Qty"]), (2, "suppliers", ["Vendor_ID", "Vendor_Name"])])
    m = mp.suggest_mapping(hdr)
    assert mp.mapping_dict(m, 1) == {"SKU": "product_id", "Qty": "quantity"}
    assert mp.mapping_dict(m, 2) == {"Vendor_ID": "supplier_id", "Vendor_Name": "supplier_name"}
    missing = {(r["feed_id"], r["field"]) for r in mp.unmapped_required(m).collect()}
    assert missing == {(1, "date")}


def test_apply_mapping_first_duplicate_wins(spark):
    df = spark.createDataFrame([("a", "b", "1")], "x string, y string, z string")
    out = mp.apply_mapping(df, {"x": "product_id", "y": "product_id", "z": "quantity"})
    assert out.columns == ["product_id", "quantity"]
    assert out.first()["product_id"] == "a"
