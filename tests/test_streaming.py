import os

from ledgerline.streaming import file_arrival as fa

HEADERS = ["SKU", "Qty_Sold", "Date", "Region", "Unit_Price"]
CSV = ("SKU,Qty_Sold,Date,Region,Unit_Price\n"
       "WIDGET-001,120,2026-01-05,North,499.0\n"
       "WIDGET-002,85,2026-01-05,South,299.0\n"
       "WIDGET-001,,2026-01-06,North,499.0\n"
       "WIDGET-002,-5,2026-01-06,South,299.0\n"
       "WIDGET-001,140,2026-01-07,North,499.0\n")


def _products(spark):
    return spark.createDataFrame([], "company_id int, product_id long, external_product_id string, name string")


def test_stream_ingest_is_idempotent_and_audited(spark, tmp_path):
    landing, tables, ckpt = str(tmp_path / "in"), str(tmp_path / "tables"), str(tmp_path / "ckpt")
    os.makedirs(landing)
    with open(os.path.join(landing, "upload1.csv"), "w") as f:
        f.write(CSV)
    calls = []

    def hook(cid):
        calls.append(cid)
        raise RuntimeError("training blew up")

    q = fa.start_file_ingest(spark, landing, "sales", 7, tables, ckpt, _products(spark), on_imported=hook)
    q.awaitTermination()
    audit = fa.ingest_audit(fa.read_audit(spark, tables)).collect()
    assert len(audit) == 1
    a = audit[0]
    assert (a["imported"], a["skipped"], a["row_count"]) == (3, 2, 5)
    assert a["status"] == "training_failed" and calls == [7]       # a failing hook never fails the import
    facts = spark.read.parquet(f"{tables}/sales")
    assert facts.count() == 3 and {r["company_id"] for r in facts.collect()} == {7}
    # a retried batch (same upload id) replaces its partition instead of appending
    batch = spark.read.option("header", True).schema(fa.string_schema(HEADERS)).csv(landing)
    fa.process_upload(batch, a["upload_id"], 7, "sales", tables, _products(spark))
    assert spark.read.parquet(f"{tables}/sales").count() == 3
    # a new file is a new upload; already-processed files are not read again
    with open(os.path.join(landing, "upload2.csv"), "w") as f:
        f.write(CSV)
    fa.start_file_ingest(spark, landing, "sales", 7, tables, ckpt, _products(spark)).awaitTermination()
    assert spark.read.parquet(f"{tables}/sales").count() == 6
    assert len(fa.ingest_audit(fa.read_audit(spark, tables)).collect()) == 2


def test_upload_with_unmapped_required_field_is_rejected(spark, tmp_path):
    tables = str(tmp_path / "t")
    batch = spark.createDataFrame([("A", "2026-01-01")], "SKU string, Date string")
    fa.process_upload(batch, 1, 7, "sales", tables, _products(spark))
    a = fa.ingest_audit(fa.read_audit(spark, tables)).first()
    assert a["status"] == "rejected"


def test_read_tabular_and_preview(spark, tmp_path):
    from ledgerline.operators.mapping import preview
    from ledgerline.sources.tabular import read_tabular
    p = tmp_path / "f.csv"
    p.write_text(" SKU , Qty \nA,1\nB,2\nC,x\n")
    df = read_tabular(spark, str(p))
    assert df.columns == ["SKU", "Qty"] and dict(df.dtypes) == {"SKU": "string", "Qty": "string"}
    assert [r["SKU"] for r in preview(df, 2, order=["SKU"]).collect()] == ["A", "B"]


def _land(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_two_streams_keep_rows_and_dimensions(spark, tmp_path):
    """Different new products and text supplier ids from two streams of one tenant: distinct ids, nothing lost."""
    tables, head = str(tmp_path / "t"), ["Shipment_No", "SKU", "Ship_From", "Ship_To", "ETA", "Delivery_Date", "Vendor_ID"]
    for k in (1, 2):
        _land(tmp_path / f"in{k}", "up.csv", ",".join(head) + "\n" + f"S{k}1,NEW-{k},A,B,2026-02-0{k},2026-02-0{k},V-{k}\nS{k}2,SHARED,A,B,01-Feb-2026,,V-0\n")
        fa.start_file_ingest(spark, str(tmp_path / f"in{k}"), "shipments", 7, tables, str(tmp_path / f"c{k}")).awaitTermination()
    rows = {r["external_shipment_id"]: r for r in spark.read.parquet(f"{tables}/shipments").collect()}
    assert set(rows) == {"S11", "S12", "S21", "S22"} and rows["S12"]["product_id"] == rows["S22"]["product_id"]
    assert len({r["product_id"] for r in rows.values()}) == 3 and len({r["supplier_id"] for r in rows.values()}) == 3
    assert {r["external_product_id"] for r in fa.read_dimension(spark, tables, "products").collect()} == {"NEW-1", "NEW-2", "SHARED"}
    assert {r["external_supplier_id"] for r in fa.read_dimension(spark, tables, "suppliers").collect()} == {"V-0", "V-1", "V-2"}
    audit = fa.ingest_audit(fa.read_audit(spark, tables)).collect()
    assert len({r["upload_id"] for r in audit}) == 2 and {r["file_name"] for r in audit} == {"up.csv"}


def test_supplier_upload_fills_in_what_shipments_created(spark, tmp_path):
    tables = str(tmp_path / "t")
    ships = spark.createDataFrame([("S1", "P", "A", "B", "2026-02-01", None, "V-9")], "Shipment_No string, SKU string, Ship_From string, Ship_To string, ETA string, Delivery_Date string, Vendor_ID string")
    fa.process_upload(ships, 1, 7, "shipments", tables)
    made = fa.read_dimension(spark, tables, "suppliers").first()
    assert made["name"] == "V-9" and made["reliability"] is None
    ups = spark.createDataFrame([("V-9", "Nine", "4", "0.9")], "Vendor_ID string, Vendor_Name string, Lead_Time_Days string, On_Time_Rate string")
    fa.process_upload(ups, 2, 7, "suppliers", tables)
    now = fa.read_dimension(spark, tables, "suppliers").collect()
    assert len(now) == 1 and (now[0]["supplier_id"], now[0]["name"], now[0]["reliability"]) == (made["supplier_id"], "Nine", 0.9)


def test_files_without_rows_are_audited(spark, tmp_path):
    tables, landing = str(tmp_path / "t"), str(tmp_path / "in")
    _land(landing, "empty.csv", ",".join(HEADERS) + "\n")
    _land(landing, "full.csv", CSV)
    fa.start_file_ingest(spark, landing, "sales", 7, tables, str(tmp_path / "c")).awaitTermination()
    assert fa.audit_empty_files(spark, landing, "sales", 7, tables) == 1 and fa.audit_empty_files(spark, landing, "sales", 7, tables) == 0
    assert {r["file_name"]: (r["status"], r["row_count"]) for r in fa.ingest_audit(fa.read_audit(spark, tables)).collect()} == {
        "empty.csv": ("rejected", 0), "full.csv": ("imported", 5)}


def test_every_file_is_mapped_by_its_own_header(spark, tmp_path):
    """Permuted, additional, repeated, quoted and unnamed columns; one batch holds all files, one of them not importable."""
    tables, landing = str(tmp_path / "t"), str(tmp_path / "in")
    files = {"a.csv": "Date,SKU,Qty\n2026-01-01,A,1\n", "b.csv": "Qty,SKU,Date\n2,B,2026-01-02\n", "c.csv": "SKU,Region,Date,Qty\nC,North,2026-01-03,3\n",
             "d.csv": '\ufeff"SKU",Date,,Qty,Qty\n"D, or d",2026-01-04,x,4,9\n', "e.csv": "Colour,Date\nred,2026-01-05\n", "f.csv": "", "g.csv": "SKU,Qty,Date\n"}
    for name, text in files.items():
        _land(landing, name, text)
    fa.start_file_ingest(spark, landing, "sales", 7, tables, str(tmp_path / "c")).awaitTermination()
    products = {r["product_id"]: r["external_product_id"] for r in fa.read_dimension(spark, tables, "products").collect()}
    got = {(products[r["product_id"]], str(r["sale_date"]), r["quantity"]) for r in spark.read.parquet(f"{tables}/sales").collect()}
    assert got == {("A", "2026-01-01", 1.0), ("B", "2026-01-02", 2.0), ("C", "2026-01-03", 3.0), ("D, or d", "2026-01-04", 4.0)}
    audit = {r["file_name"]: (r["status"], r["imported"]) for r in fa.ingest_audit(fa.read_audit(spark, tables)).collect()}
    assert audit == {**{f"{x}.csv": ("imported", 1) for x in "abcd"}, "e.csv": ("rejected", 0)}
    assert fa.audit_empty_files(spark, landing, "sales", 7, tables) == 2
    again = fa.read_audit(spark, tables).count()
    fa.process_files(spark, [f"file:{landing}/{x}.csv" for x in "abcd"], "sales", 7, tables)  # a repeated batch changes nothing
    assert spark.read.parquet(f"{tables}/sales").count() == 4 and fa.read_audit(spark, tables).count() == again


def test_large_uploads_land_as_more_files(spark, tmp_path, monkeypatch):
    """Every header line's files are written by as many tasks as the input's splits ask for, two at least."""
    from ledgerline.plans import ingest
    from ledgerline.plans.register import QUERIES
    monkeypatch.setattr(ingest, "SPLITS_A_FILE", 2, raising=False)
    n = 400
    spark.range(n, numPartitions=16).selectExpr("id AS l_orderkey", "1 AS l_linenumber", "id % 5 AS l_partkey", "id % 3 AS l_suppkey", "cast(id % 50 AS double) AS l_quantity",
                                                "timestamp '1998-01-01' AS l_shipdate", "'N' AS l_returnflag").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.range(5).selectExpr("id AS p_partkey", "concat('Brand#', id) AS p_brand").write.parquet(str(tmp_path / "part.parquet"))
    landed = f"{spark.conf.get('spark.checkpoint.dir')}/landing"
    before = set(os.listdir(landed)) if os.path.exists(landed) else set()
    state = QUERIES["file_arrival_ingest"](spark, str(tmp_path)).collect()
    assert [r["status"] for r in state] == ["imported"] and state[0]["row_count"] == n == state[0]["imported"] + state[0]["skipped"]
    made, = set(os.listdir(landed)) - before
    parts = spark.read.parquet(str(tmp_path / "lineitem.parquet")).rdd.getNumPartitions()
    forms = [[f for f in os.listdir(f"{landed}/{made}/{k}") if f.startswith("part-")] for k in os.listdir(f"{landed}/{made}") if not k.startswith(("_", "."))]
    assert len(forms) == 3 and all(len(f) == max(parts // 2, ingest.LANDED_FILES) for f in forms)


def test_an_upload_is_not_cached_on_disk(spark, tmp_path, monkeypatch):
    """What doesn't fit into memory is made again: a cache on disk would hold all strings of the upload."""
    from pyspark import StorageLevel
    from pyspark.sql.classic.dataframe import DataFrame

    from ledgerline.streaming import file_arrival as fa

    levels, real = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: levels.append(a) or real(self, *a))
    rows = spark.createDataFrame([("P1", "3", "2025-01-02"), ("P2", "4", "2025-01-03")], "SKU string, Qty_Sold string, Date string")
    fa.process_upload(rows, 7, 1, "sales", str(tmp_path))
    assert levels == [(StorageLevel.MEMORY_ONLY,)]
    assert {(r["status"], r["imported"]) for r in fa.ingest_audit(fa.read_audit(spark, str(tmp_path))).collect()} == {("imported", 2)}
