"""Registered ingest queries: header mapping, validation, quarantine, imports, audit, prep."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import functions as F

from ledgerline.operators import loading as ld
from ledgerline.operators import mapping as mp
from ledgerline.operators import prep
from ledgerline.operators import validation as val
from ledgerline.plans.oracle_adapters import oracle
from ledgerline.plans.register import query
from ledgerline.session import side_by_side
from ledgerline.sources import registry as reg

IMPORT_COMPANY = 3  # tenant that receives the single (tenant-less) raw sales upload

# raw upload -> (dataset type, data headers, pass-through key columns)
UPLOADS = {
    "raw_sales": ("sales", ["SKU", "Qty_Sold", "Date", "Region"],
                  ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]),
    "raw_inventory": ("inventory", ["Product_ID", "Stock", "Date", "Warehouse", "Min_Stock"],
                      ["company_id", "src_warehouse_id"]),
    "raw_shipments": ("shipments", ["Shipment_No", "SKU", "Ship_From", "Ship_To", "ETA", "Delivery_Date", "Carrier",
                                    "Distance_KM", "Weight_KG", "Mode", "Qty", "Order_Date", "Vendor_ID"],
                      ["company_id", "l_orderkey", "l_linenumber", "l_partkey", "supplier_id"]),
    "raw_suppliers": ("suppliers", ["Vendor_ID", "Vendor_Name", "Lead_Time_Days", "On_Time_Rate", "Cost_Index",
                                    "Reject_Rate"], ["company_id", "row_version", "row_key"]),
}
LANDED_FILES = 2   # of a header line, at least
SPLITS_A_FILE = 8  # splits of a large input that land in a file
FEED_IDS = {name: i + 1 for i, name in enumerate(UPLOADS)}


@lru_cache(maxsize=None)
def _mapping_for(spark_id: int, dtype: str, headers: tuple) -> tuple:
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    m = mp.suggest_mapping(mp.headers_of(spark, [(1, dtype, list(headers))]))
    return tuple(mp.mapping_dict(m, 1).items())


def mapped(d, raw_name):
    """Suggest the mapping from the upload's own headers and apply it."""
    dtype, headers, keys = UPLOADS[raw_name]
    raw = getattr(d, raw_name)
    m = dict(_mapping_for(id(d.spark), dtype, tuple(headers)))
    # pass-through keys must not collide with standard names chosen by the mapping
    keys = [k for k in keys if k not in set(v for v in m.values() if v)]
    return mp.apply_mapping(raw, m, keep=keys)


def _q(c: str) -> str:
    return '"' + c + '"'


# raw column feeding each standard field (what the mapping resolves to), per upload
SQL_MAP = {
    "raw_sales": {"product_id": "SKU", "quantity": "Qty_Sold", "date": "Date", "region": "Region"},
    "raw_inventory": {"product_id": "Product_ID", "inventory_level": "Stock", "date": "Date",
                      "warehouse": "Warehouse", "safety_stock": "Min_Stock"},
    "raw_shipments": {"shipment_id": "Shipment_No", "product_id": "SKU", "origin": "Ship_From",
                      "destination": "Ship_To", "planned_delivery": "ETA", "actual_delivery": "Delivery_Date",
                      "carrier": "Carrier", "distance": "Distance_KM", "weight": "Weight_KG",
                      "transport_mode": "Mode", "quantity": "Qty", "order_date": "Order_Date",
                      "supplier_id": "Vendor_ID"},
    "raw_suppliers": {"supplier_id": "Vendor_ID", "supplier_name": "Vendor_Name", "lead_time": "Lead_Time_Days",
                      "reliability": "On_Time_Rate", "cost": "Cost_Index", "defect_rate": "Reject_Rate"},
}


def sql_mapped(raw_name: str) -> str:
    keys = [k for k in UPLOADS[raw_name][2] if k not in SQL_MAP[raw_name]]
    cols = [f"{_q(src)} AS {std}" for std, src in SQL_MAP[raw_name].items()] + keys
    return f"mp AS (SELECT {', '.join(cols)} FROM {raw_name})"


def _miss(c):
    return f"({c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '')"


def _num(c):
    return f"TRY_CAST(trim({c}) AS DOUBLE)"


def _date(c):
    return f"TRY_CAST(trim({c}) AS DATE)"


def sql_rules(dtype: str, cols) -> list[tuple[str, str, str, bool, str, str]]:
    """Twin of the validation rules: (name, field, kind, invalidates, predicate, message)."""
    out = []
    for f in reg.STANDARD_SCHEMA[dtype]["required"]:
        if f in cols:
            out.append((f"missing_{f}", f, "missing", True, _miss(f), f"%d row(s) missing required value for ''{f}''."))
    if dtype == "sales":
        out.append(("negative_quantity", "quantity", "error", True, f"coalesce({_num('quantity')} < 0, false)",
                    "%d row(s) have negative quantity sold."))
        out.append(("bad_date", "date", "error", True, f"({_date('date')} IS NULL AND NOT {_miss('date')})",
                    "%d row(s) have an unparseable date."))
    if dtype == "inventory":
        out.append(("negative_inventory", "inventory_level", "error", True,
                    f"coalesce({_num('inventory_level')} < 0, false)", "%d row(s) have negative inventory levels."))
    if dtype == "shipments":
        out.append(("implausible_delivery", "actual_delivery", "warning", False,
                    f"coalesce({_date('actual_delivery')} < {_date('planned_delivery')} - 365, false)",
                    "%d row(s) have an actual delivery date implausibly earlier than planned."))
        out.append(("negative_distance", "distance", "warning_once", False, f"coalesce({_num('distance')} < 0, false)",
                    "Some rows have a negative distance value."))
    if dtype == "suppliers":
        out.append(("negative_lead_time", "lead_time", "error", True, f"coalesce({_num('lead_time')} < 0, false)",
                    "%d row(s) have a negative/impossible lead time."))
        out.append(("reliability_range", "reliability", "warning", False,
                    f"NOT coalesce({_num('reliability')} BETWEEN 0 AND 1, false)",
                    "%d row(s) have a reliability value outside the expected 0-1 range."))
    return out


def sql_report(raw_name: str) -> str:
    dtype = UPLOADS[raw_name][0]
    cols = list(SQL_MAP[raw_name])
    rules = sql_rules(dtype, cols)
    keys = [k for k in reg.DUPLICATE_KEYS if k in cols]
    inval = " OR ".join(r[4] for r in rules if r[3]) or "false"
    counts = ", ".join(f"count(CASE WHEN {r[4]} THEN 1 END) AS n_{r[0]}" for r in rules)
    issues = []
    for name, field, kind, _, _, msg in rules:
        if kind == "missing":
            sev = f"CASE WHEN n_{name} / greatest(row_count, 1) > {val.ERROR_SHARE} THEN 'error' ELSE 'warning' END"
            issues.append((f"n_{name} > 0", sev, field, f"printf('{msg}', n_{name})"))
        elif kind == "warning_once":
            issues.append((f"n_{name} > 0", "'warning'", field, f"'{msg}'"))
        else:
            issues.append((f"n_{name} > 0", f"'{kind}'", field, f"printf('{msg}', n_{name})"))
    klist = str(keys).replace("'", "''")
    issues.append(("n_dup > 0", "'warning'", None, f"printf('%d duplicate row(s) detected based on {klist}.', n_dup)"))
    n_warn = " + ".join(f"CASE WHEN ({c}) AND ({s}) = 'warning' THEN 1 ELSE 0 END" for c, s, _, _ in issues)
    union = "\nUNION ALL ".join(
        f"SELECT '{dtype}' AS dataset_type, {s} AS severity, {('NULL' if f is None else repr(f))} AS field, "
        f"{m} AS message, data_quality_score, row_count, valid_row_count FROM sc WHERE {c}"
        for c, s, f, m in issues)
    grp = ", ".join(keys)
    return oracle(raw_name, sql_mapped(raw_name) + f""",
agg AS (SELECT count(*) AS row_count, count(CASE WHEN {inval} THEN 1 END) AS invalid, {counts} FROM mp),
dup AS (SELECT coalesce(sum(c - 1), 0) AS n_dup FROM (SELECT count(*) AS c FROM mp GROUP BY {grp}) t),
s1 AS (SELECT * FROM agg, dup),
sc AS (SELECT *, CAST(greatest(0, least(100, round_even(100.0 - CASE WHEN row_count > 0 THEN 40.0 * invalid / row_count
                  ELSE 0 END - 2.0 * ({n_warn}), 0))) AS BIGINT) AS data_quality_score,
              greatest(row_count - invalid, 0) AS valid_row_count FROM s1)
SELECT '{dtype}' AS dataset_type, 'summary' AS severity, NULL AS field, NULL AS message, data_quality_score,
       row_count, valid_row_count FROM sc
UNION ALL {union}""")


@query("mapped_raw_sales", oracle("raw_sales", sql_mapped("raw_sales") + "\nSELECT * FROM mp"))
def q_mapped_raw_sales(d):
    """The messy sales upload renamed to standard fields by the suggested mapping."""
    return mapped(d, "raw_sales")


def _report(raw_name):
    def fn(d):
        return val.validation_report(mapped(d, raw_name), UPLOADS[raw_name][0])
    fn.__doc__ = f"V1-V12: validation issues and quality score of the {UPLOADS[raw_name][0]} upload."
    return fn


for _raw in UPLOADS:
    query(f"{UPLOADS[_raw][0]}_validation_report", sql_report(_raw))(_report(_raw))


def sql_quarantine(raw_name: str, out_cols) -> str:
    dtype = UPLOADS[raw_name][0]
    rules = [r for r in sql_rules(dtype, list(SQL_MAP[raw_name])) if r[3]]
    reasons = "concat_ws(',', " + ", ".join(f"CASE WHEN {r[4]} THEN '{r[0]}' END" for r in rules) + ")"
    return oracle(raw_name, sql_mapped(raw_name) + f"""
SELECT {', '.join(out_cols)}, {reasons} AS reasons FROM mp WHERE {' OR '.join(r[4] for r in rules)}""")


@query("sales_quarantine", sql_quarantine("raw_sales", ["product_id", "quantity", "date", "region", "l_orderkey",
                                                         "l_linenumber", "l_partkey", "l_suppkey"]))
def q_sales_quarantine(d):
    """Invalid sales upload rows with the rules they break."""
    return val.quarantine(mapped(d, "raw_sales"), "sales")


def sql_id(kind: str, ext: str) -> str:
    """Twin of ``loading.stable_id``."""
    return f"('0x' || substr(md5('{kind}|' || company_id || '|' || {ext}), 1, 15))::BIGINT"


SQL_NEW_PRODUCTS = f"""
newp AS (
  SELECT n.company_id, {sql_id('product_id', 'ext')} AS product_id, n.ext AS external_product_id, n.ext AS name
  FROM (SELECT DISTINCT a.company_id, a.ext FROM acc a
        WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.company_id = a.company_id
                                                      AND p.external_product_id = a.ext)) n),
ids AS (SELECT company_id, external_product_id AS ext, CAST(product_id AS BIGINT) AS product_id FROM products
        UNION ALL SELECT company_id, external_product_id, product_id FROM newp)"""


@query("import_sales", oracle("products,raw_sales", sql_mapped("raw_sales") + f""",
acc AS (SELECT {IMPORT_COMPANY} AS company_id, CAST(product_id AS VARCHAR) AS ext, {_date('date')} AS sale_date,
               {_num('quantity')} AS q, CASE WHEN NOT {_miss('region')} THEN region END AS region
        FROM mp
        WHERE NOT {_miss('product_id')} AND NOT {_miss('date')} AND NOT {_miss('quantity')}
          AND {_date('date')} IS NOT NULL AND {_num('quantity')} IS NOT NULL AND NOT isnan({_num('quantity')})
          AND NOT isinf({_num('quantity')}) AND {_num('quantity')} >= 0),""" + SQL_NEW_PRODUCTS + """
SELECT a.company_id, i.product_id, a.sale_date, a.q AS quantity, a.region, CAST(NULL AS DOUBLE) AS price,
       0 AS promotion
FROM acc a LEFT JOIN ids i ON a.company_id = i.company_id AND a.ext = i.ext"""))
def q_import_sales(d):
    """Accepted rows of the sales upload, loaded into one tenant with product keys resolved."""
    sales, _, _ = ld.load_sales(mapped(d, "raw_sales"), IMPORT_COMPANY, d.products)
    return sales


SQL_INV_ACC = sql_mapped("raw_inventory") + f""",
acc AS (SELECT company_id, CAST(product_id AS VARCHAR) AS ext,
               CASE WHEN NOT {_miss('warehouse')} THEN warehouse END AS warehouse_name,
               {_date('date')} AS record_date, {_num('inventory_level')} AS lvl, {_num('safety_stock')} AS ss
        FROM mp
        WHERE NOT {_miss('product_id')} AND NOT {_miss('date')} AND NOT {_miss('inventory_level')}
          AND {_date('date')} IS NOT NULL AND {_num('inventory_level')} IS NOT NULL
          AND NOT isnan({_num('inventory_level')}) AND NOT isinf({_num('inventory_level')})
          AND {_num('inventory_level')} >= 0),
neww AS (SELECT company_id, {sql_id('warehouse_id', 'warehouse_name')} AS warehouse_id, warehouse_name AS name
         FROM (SELECT DISTINCT company_id, warehouse_name FROM acc WHERE warehouse_name IS NOT NULL) t),"""


@query("import_inventory", oracle("products,raw_inventory", SQL_INV_ACC + SQL_NEW_PRODUCTS + """
SELECT a.company_id, i.product_id, w.warehouse_id, a.record_date, a.lvl AS inventory_level, a.ss AS safety_stock
FROM acc a LEFT JOIN ids i ON a.company_id = i.company_id AND a.ext = i.ext
LEFT JOIN neww w ON a.company_id = w.company_id AND a.warehouse_name = w.name"""))
def q_import_inventory(d):
    """Accepted inventory rows per tenant with product and warehouse keys (created as needed)."""
    rows, _, _, _ = ld.load_inventory(mapped(d, "raw_inventory"), None, d.products, _no_warehouses(d))
    return rows


def _no_warehouses(d):
    return d.spark.createDataFrame([], "company_id int, warehouse_id long, name string")


@query("conform_products", oracle("products,raw_inventory", SQL_INV_ACC + SQL_NEW_PRODUCTS + """
SELECT * FROM newp"""))
def q_conform_products(d):
    """Products of the inventory upload missing from the dimension, with new per-tenant ids."""
    _, newp, _, _ = ld.load_inventory(mapped(d, "raw_inventory"), None, d.products, _no_warehouses(d))
    return newp


@query("conform_warehouses", oracle("products,raw_inventory", SQL_INV_ACC.rstrip().rstrip(",") + """
SELECT * FROM neww"""))
def q_conform_warehouses(d):
    """Warehouses named by the inventory upload, created per tenant (blank name = no warehouse)."""
    _, _, neww, _ = ld.load_inventory(mapped(d, "raw_inventory"), None, d.products, _no_warehouses(d))
    return neww


@query("import_shipments", oracle("products,suppliers,raw_shipments", sql_mapped("raw_shipments") + f""",
acc AS (SELECT company_id, CAST(product_id AS VARCHAR) AS ext, CAST(shipment_id AS VARCHAR) AS external_shipment_id,
               CASE WHEN NOT {_miss('supplier_id')} THEN supplier_id END AS sup,
               CASE WHEN NOT {_miss('origin')} THEN origin END AS origin,
               CASE WHEN NOT {_miss('destination')} THEN destination END AS destination,
               CASE WHEN NOT {_miss('carrier')} THEN carrier END AS carrier,
               CASE WHEN NOT {_miss('transport_mode')} THEN transport_mode END AS transport_mode,
               {_num('distance')} AS distance_km, {_num('weight')} AS weight_kg, {_num('quantity')} AS quantity,
               {_date('order_date')} AS order_date, {_date('planned_delivery')} AS planned_delivery,
               {_date('actual_delivery')} AS actual_delivery
        FROM mp
        WHERE NOT {_miss('shipment_id')} AND NOT {_miss('product_id')} AND NOT {_miss('planned_delivery')}
          AND {_date('planned_delivery')} IS NOT NULL),""" + SQL_NEW_PRODUCTS + """
SELECT a.company_id, i.product_id, a.external_shipment_id, coalesce(CAST(s.supplier_id AS BIGINT), a.made) AS supplier_id, a.origin,
       a.destination, a.carrier, a.transport_mode, a.distance_km, a.weight_kg, a.quantity, a.order_date, a.planned_delivery,
       a.actual_delivery
FROM (SELECT *, """ + sql_id("supplier_id", "sup") + """ AS made FROM acc) a LEFT JOIN ids i ON a.company_id = i.company_id AND a.ext = i.ext
LEFT JOIN suppliers s ON s.company_id = a.company_id AND CAST(s.supplier_id AS VARCHAR) = a.sup"""))
def q_import_shipments(d):
    """Accepted shipment rows per tenant; unparseable actual delivery = still in flight."""
    rows, _, _, _ = ld.load_shipments(mapped(d, "raw_shipments"), None, d.products, d.suppliers)
    return rows


@query("upsert_suppliers", oracle("suppliers,raw_suppliers", sql_mapped("raw_suppliers") + f""",
acc AS (SELECT * FROM mp WHERE NOT {_miss('supplier_id')} AND NOT {_miss('supplier_name')}),
lt AS (SELECT company_id, CAST(supplier_id AS VARCHAR) AS external_supplier_id,
              arg_max(supplier_name, row_version * 1000000000 + row_key) AS name,
              arg_max({_num('lead_time')}, row_version * 1000000000 + row_key)
                FILTER (WHERE {_num('lead_time')} IS NOT NULL) AS lead_time_days,
              arg_max({_num('reliability')}, row_version * 1000000000 + row_key)
                FILTER (WHERE {_num('reliability')} IS NOT NULL) AS reliability,
              arg_max({_num('cost')}, row_version * 1000000000 + row_key)
                FILTER (WHERE {_num('cost')} IS NOT NULL) AS cost_index,
              arg_max({_num('defect_rate')}, row_version * 1000000000 + row_key)
                FILTER (WHERE {_num('defect_rate')} IS NOT NULL) AS defect_rate
       FROM acc GROUP BY company_id, CAST(supplier_id AS VARCHAR))
SELECT coalesce(o.company_id, n.company_id) AS company_id,
       coalesce(CAST(o.supplier_id AS BIGINT), ('0x' || substr(md5('supplier_id|' || n.company_id || '|' || n.external_supplier_id), 1, 15))::BIGINT)
         AS supplier_id,
       coalesce(CAST(o.supplier_id AS VARCHAR), n.external_supplier_id) AS external_supplier_id,
       coalesce(n.name, o.name) AS name,
       coalesce(n.lead_time_days, o.lead_time_days) AS lead_time_days,
       coalesce(n.reliability, o.reliability) AS reliability,
       coalesce(n.cost_index, o.cost_index) AS cost_index,
       coalesce(n.defect_rate, o.defect_rate) AS defect_rate
FROM suppliers o FULL OUTER JOIN lt n
  ON o.company_id = n.company_id AND CAST(o.supplier_id AS VARCHAR) = n.external_supplier_id"""))
def q_upsert_suppliers(d):
    """Supplier upload merged into the dimension; last non-null value per attribute wins."""
    out, _ = ld.upsert_suppliers(mapped(d, "raw_suppliers"), None, d.suppliers, pos=["row_version", "row_key"])
    return out


@query("tabular_read", oracle("raw_suppliers", """
SELECT "Vendor_ID", "Vendor_Name", "Lead_Time_Days", "On_Time_Rate", "Cost_Index", "Reject_Rate" FROM raw_suppliers"""))
def q_tabular_read(d):
    """The supplier upload written as CSV and read back, every column text."""
    from ledgerline.sources.tabular import read_tabular
    headers = UPLOADS["raw_suppliers"][1]
    path = f"{_scratch(d, 'csv')}/up.csv"
    d.raw_suppliers.select(*[F.col(h).alias(f" {h} ") for h in headers]).write.option("header", True).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_tabular(d.spark, path)


PREVIEW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("preview_sales", oracle("raw_sales", f"SELECT * FROM raw_sales ORDER BY {', '.join(PREVIEW_ORDER)} LIMIT 10"))
def q_preview_sales(d):
    """The first ten rows of an upload."""
    return mp.preview(d.raw_sales, 10, PREVIEW_ORDER)


@query("report_without_date", oracle("raw_sales", sql_mapped("raw_sales") + f""",
s AS (SELECT count(*) AS n, count(CASE WHEN {_miss('product_id')} THEN 1 END) AS np, count(CASE WHEN {_miss('quantity')} THEN 1 END) AS nq,
             count(CASE WHEN {_miss('product_id')} OR {_miss('quantity')} OR coalesce({_num('quantity')} < 0, false) THEN 1 END) AS bad,
             count(CASE WHEN coalesce({_num('quantity')} < 0, false) THEN 1 END) AS neg, count(DISTINCT product_id)
               + max(CASE WHEN product_id IS NULL THEN 1 ELSE 0 END) AS keys FROM mp)
SELECT 'sales' AS dataset_type, n AS row_count, n - bad AS valid_row_count, 'error' AS severity, 'date' AS field,
       'Required field ''date'' is not mapped to any column.' AS message,
       CAST(greatest(0, least(100, round_even(100.0 - 40.0 * bad / n - 15.0 - 2.0 * (CASE WHEN np > 0 AND np / n <= {val.ERROR_SHARE} THEN 1 ELSE 0 END
         + CASE WHEN nq > 0 AND nq / n <= {val.ERROR_SHARE} THEN 1 ELSE 0 END + CASE WHEN n > keys THEN 1 ELSE 0 END), 0))) AS BIGINT) AS data_quality_score
FROM s"""))
def q_report_without_date(d):
    """V1: the finding for a required field that no column was mapped to."""
    return val.validation_report(mapped(d, "raw_sales").drop("date"), "sales").where(F.col("field") == "date")


@query("stored_daily_sales", oracle("", """
SELECT l.l_partkey AS product_id, CAST(o.o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS quantity,
       0 AS promotion
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l.l_partkey, CAST(o.o_orderdate AS DATE)"""))
def q_stored_daily_sales(d):
    """The processed sales written to a table and read back."""
    path = _scratch(d, "tables")
    prep.write_table(prep.prep_daily_sales(d.t.lineitem, d.online_orders), path)
    return d.spark.read.parquet(path)


def _values(rows) -> str:
    """Rows as an SQL VALUES list."""
    lit = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"
    return "(VALUES " + ", ".join(f"({', '.join(map(lit, r))})" for r in rows) + ")"


_FEEDS = [(FEED_IDS[n], UPLOADS[n][0], UPLOADS[n][1]) for n in UPLOADS] + [(0, "sales", [c for c in UPLOADS["raw_sales"][1] if c != "Date"])]
SQL_UNMAPPED = f"""
WITH h AS (SELECT feed_id, dataset_type, regexp_replace(lower(header), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS norm
           FROM {_values([(i, t, c) for i, t, cs in _FEEDS for c in cs])} v(feed_id, dataset_type, header)),
f AS (SELECT * FROM {_values(reg.field_rows())} v(dataset_type, field, field_pos, required)),
a AS (SELECT * FROM {_values(reg.alias_rows())} v(field, field_order, alias)),
found AS (SELECT h.feed_id, coalesce(e.field, (SELECT min_by(a.field, a.field_order) FROM a WHERE a.alias = h.norm)) AS field
          FROM h LEFT JOIN f e ON e.dataset_type = h.dataset_type AND e.field = h.norm)
SELECT CAST(t.feed_id AS BIGINT) AS feed_id, t.dataset_type, f.field, CAST(f.field_pos AS INTEGER) AS field_pos
FROM (SELECT DISTINCT feed_id, dataset_type FROM h) t JOIN f ON f.dataset_type = t.dataset_type AND f.required
WHERE NOT EXISTS (SELECT 1 FROM found x WHERE x.feed_id = t.feed_id AND x.field = f.field)"""


@query("unmapped_required", SQL_UNMAPPED)
def q_unmapped_required(d):
    """Required fields that no header of the four uploads maps to (all map; without its date column sales lacks one)."""
    feeds = [(FEED_IDS[n], UPLOADS[n][0], [c for c in getattr(d, n).columns if c in UPLOADS[n][1]]) for n in UPLOADS]
    feeds.append((0, "sales", [c for c in d.raw_sales.columns if c in UPLOADS["raw_sales"][1] and c != "Date"]))
    return mp.unmapped_required(mp.suggest_mapping(mp.headers_of(d.spark, feeds)))


@query("prep_shipments", oracle("", f"""
SELECT CAST(o_orderkey AS VARCHAR) AS shipment_id, 'mixed' AS product_id, 'mixed' AS supplier_id,
       'Olist Warehouse' AS origin, 'Customer' AS destination, 'Correios' AS carrier, 'road' AS transport_mode,
       CAST(500.0 AS DOUBLE) AS distance_km, CAST(2.0 AS DOUBLE) AS weight_kg, CAST(1.0 AS DOUBLE) AS quantity,
       CAST(2.0 AS DOUBLE) AS supplier_lead_time_days, CAST(0.9 AS DOUBLE) AS supplier_reliability,
       CAST(1.0 AS DOUBLE) AS supplier_cost_index, CAST(o_orderdate AS DATE) AS order_date,
       CAST(o_orderdate AS DATE) + CAST(7 + o_orderkey % 5 AS INTEGER) AS planned_delivery,
       CAST(o_orderdate AS DATE) + CAST(3 + o_orderkey % 11 AS INTEGER) AS actual_delivery
FROM orders WHERE o_orderstatus = '{prep.DELIVERED_STATUS}' AND o_orderdate IS NOT NULL"""))
def q_prep_shipments(d):
    """Delivered public orders reshaped to the shipment schema with the reference's constants."""
    return prep.prep_shipments(d.online_orders)


@query("prep_daily_sales", oracle("", """
SELECT l.l_partkey AS product_id, CAST(o.o_orderdate AS DATE) AS date, CAST(count(*) AS DOUBLE) AS quantity,
       0 AS promotion
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
GROUP BY l.l_partkey, CAST(o.o_orderdate AS DATE)"""))
def q_prep_daily_sales(d):
    """Public order items counted per (product, purchase day), promotion 0."""
    return prep.prep_daily_sales(d.t.lineitem, d.online_orders)


# ----------------------------------------------------------------------------------------
# I10 file-arrival stream and S7 ingest audit
# ----------------------------------------------------------------------------------------
def _scratch(d, what):
    import uuid
    from ledgerline.session import checkpoint_root
    return f"{checkpoint_root(d.spark)}/{what}/{uuid.uuid4().hex}"


SQL_ACCEPTED = {
    "sales": f"""NOT {_miss('product_id')} AND NOT {_miss('date')} AND NOT {_miss('quantity')} AND {_date('date')} IS NOT NULL
      AND {_num('quantity')} IS NOT NULL AND NOT isnan({_num('quantity')}) AND NOT isinf({_num('quantity')}) AND {_num('quantity')} >= 0""",
    "inventory": f"""NOT {_miss('product_id')} AND NOT {_miss('date')} AND NOT {_miss('inventory_level')} AND {_date('date')} IS NOT NULL
      AND {_num('inventory_level')} IS NOT NULL AND NOT isnan({_num('inventory_level')}) AND NOT isinf({_num('inventory_level')})
      AND {_num('inventory_level')} >= 0""",
    "shipments": f"""NOT {_miss('shipment_id')} AND NOT {_miss('product_id')} AND NOT {_miss('planned_delivery')}
      AND {_date('planned_delivery')} IS NOT NULL""",
    "suppliers": f"NOT {_miss('supplier_id')} AND NOT {_miss('supplier_name')}",
}


def sql_audit(raw_name: str) -> str:
    """Row count, score, imported and skipped of an upload."""
    dtype = UPLOADS[raw_name][0]
    counts = oracle(raw_name, sql_mapped(raw_name) + f"""
SELECT count(CASE WHEN {SQL_ACCEPTED[dtype]} THEN 1 END) AS imported, count(CASE WHEN NOT ({SQL_ACCEPTED[dtype]}) THEN 1 END) AS skipped FROM mp""")
    company = IMPORT_COMPANY if raw_name == "raw_sales" else "NULL"
    return f"""SELECT CAST({FEED_IDS[raw_name]} AS BIGINT) AS upload_id, CAST({company} AS INTEGER) AS company_id, '{dtype}' AS dataset_type,
  'imported' AS status, CAST(r.row_count AS BIGINT) AS row_count, r.data_quality_score, c.imported, c.skipped, '{raw_name}' AS file_name
FROM (SELECT * FROM ({sql_report(raw_name)}) q WHERE severity = 'summary') r, ({counts}) c"""


@query("file_arrival_ingest", oracle("raw_sales", sql_mapped("raw_sales") + f"""
SELECT 'sales' AS dataset_type, 'imported' AS status, count(*) AS row_count, count(CASE WHEN {SQL_ACCEPTED['sales']} THEN 1 END) AS imported,
       count(CASE WHEN NOT ({SQL_ACCEPTED['sales']}) THEN 1 END) AS skipped,
       (SELECT count(DISTINCT product_id) FROM mp WHERE {SQL_ACCEPTED['sales']}) AS products FROM mp"""))
def q_file_arrival_ingest(d):
    """The sales upload lands as CSV files whose headers differ (permuted, and with a further column); a Structured
    Streaming job (availableNow) maps each by its own header, validates and loads it idempotently into the import tenant,
    from an empty dimension; the audits of all files, and the products that the stored dimension then holds."""
    from ledgerline.streaming import file_arrival as fa
    dtype, headers, _ = UPLOADS["raw_sales"]
    landing, tables, ckpt = _scratch(d, "landing"), _scratch(d, "tables"), _scratch(d, "streams")
    part = F.pmod(F.xxhash64(*headers), F.lit(3))
    files = max(LANDED_FILES, d.t.lineitem.select("l_orderkey").rdd.getNumPartitions() // SPLITS_A_FILE)

    def land(k, columns):
        return lambda: d.raw_sales.where(part == k).select(*columns).coalesce(files).write.option("header", True).csv(f"{landing}/{k}")

    side_by_side(d.spark, {str(k): land(k, columns) for k, columns in enumerate((headers, headers[::-1], [*headers[1:], F.lit("x").alias("Remark"), headers[0]]))})
    q = fa.start_file_ingest(d.spark, f"{landing}/*", dtype, IMPORT_COMPANY, tables, ckpt)
    q.awaitTermination()
    state = fa.ingest_audit(fa.read_audit(d.spark, tables))
    products = fa.read_dimension(d.spark, tables, "products").agg(F.count(F.lit(1))).scalar()
    return state.groupBy("dataset_type", "status").agg(*[F.sum(c).alias(c) for c in ("row_count", "imported", "skipped")]).withColumn("products", products)


@query("ingest_audit", "\nUNION ALL\n".join(sql_audit(n) for n in UPLOADS))
def q_ingest_audit(d):
    """All four raw uploads processed as batches (sales, which has no tenant column, into one tenant, the rest per
    their tenant column), then the latest state of every upload from the append-only audit events."""
    from concurrent.futures import ThreadPoolExecutor

    from ledgerline.streaming import file_arrival as fa
    tables = _scratch(d, "tables")

    def one(name):
        dtype, headers, keys = UPLOADS[name]
        own = ["company_id"] if "company_id" in keys else []
        extra = [F.col(k).alias(f"_{k}") for k in keys if k in ("row_version", "row_key")]
        fa.process_upload(getattr(d, name).select(*headers, *own, *extra), FEED_IDS[name], None if own else IMPORT_COMPANY, dtype, tables,
                          d.products, suppliers=d.suppliers, file_name=name)

    # independent uploads: their Spark jobs run concurrently (each writes only its own partitions)
    with ThreadPoolExecutor(max_workers=len(UPLOADS)) as pool:
        for f in [pool.submit(one, n) for n in UPLOADS]:
            f.result()
    audit = fa.read_audit(d.spark, tables)
    return fa.ingest_audit(audit).drop("uploaded_at", "imported_at", "position")
