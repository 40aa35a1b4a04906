"""DuckDB text of the test-data adapters, used to build the oracle SQL of each query.

These mirror ``ledgerline.sources.testdata`` expression for expression; the
oracle check compares the two engines on the same parquet tables.
"""

from __future__ import annotations

ADAPTERS: dict[str, str] = {
    "companies": """
SELECT n_nationkey AS company_id, n_name AS name FROM nation""",
    "sales": """
SELECT s.s_nationkey AS company_id,
       s.s_nationkey * 100 + CAST(substr(p.p_brand, 7) AS INT) AS product_id,
       CAST(l.l_shipdate AS DATE) AS sale_date, l.l_quantity AS quantity, r.r_name AS region,
       l.l_extendedprice / l.l_quantity AS price,
       CASE WHEN l.l_discount > 0.085 THEN 1 ELSE 0 END AS promotion, p.p_type AS category,
       l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM lineitem l
JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
JOIN part p ON l.l_partkey = p.p_partkey""",
    "products": """
SELECT DISTINCT s.s_nationkey AS company_id,
       s.s_nationkey * 100 + CAST(substr(p.p_brand, 7) AS INT) AS product_id,
       p.p_brand AS external_product_id, p.p_brand AS name,
       CAST(50 + ((s.s_nationkey * 100 + CAST(substr(p.p_brand, 7) AS INT)) * 37) % 950 AS DOUBLE) AS unit_cost,
       'Category ' || CAST((s.s_nationkey * 100 + CAST(substr(p.p_brand, 7) AS INT)) % 7 AS VARCHAR) AS category
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey""",
    "suppliers": """
SELECT s_nationkey AS company_id, s_suppkey AS supplier_id, s_name AS name,
       CAST(4 + s_suppkey % 18 AS DOUBLE) AS lead_time_days,
       CASE WHEN s_suppkey % 10 = 3 THEN 10 + (s_suppkey * 11) % 35 ELSE 55 + (s_suppkey * 37) % 45 END
         / CAST(100 AS DOUBLE) AS reliability,
       (70 + (s_suppkey * 13) % 61) / CAST(100 AS DOUBLE) AS cost_index,
       ((s_suppkey * 7) % 16) / CAST(1000 AS DOUBLE) AS defect_rate
FROM supplier""",
    "shipments_truth": """
SELECT b.*, CASE WHEN b.arrival <= DATE '2001-10-15' THEN b.arrival END AS actual_delivery FROM (
  SELECT a.*, a.planned_delivery + CAST(a.late_days AS INT) AS arrival FROM (
    SELECT s.s_nationkey AS company_id,
           s.s_nationkey * 100 + CAST(substr(p.p_brand, 7) AS INT) AS product_id,
           l.l_suppkey AS supplier_id, n1.n_name AS origin, n2.n_name AS destination,
           concat('Carrier ', CAST(l.l_suppkey % 4 + 1 AS VARCHAR)) AS carrier,
           CASE l.l_orderkey % 4 WHEN 0 THEN 'road' WHEN 1 THEN 'rail' WHEN 2 THEN 'air' ELSE 'sea' END AS transport_mode,
           CAST(300 + (abs(n1.n_nationkey - n2.n_nationkey) * 137) % 1700 AS DOUBLE) AS distance_km,
           l.l_quantity * (4 + l.l_partkey % 19) / CAST(10 AS DOUBLE) AS weight_kg, l.l_quantity AS quantity,
           CAST(l.l_shipdate AS DATE) AS order_date,
           CAST(l.l_shipdate AS DATE) + CAST(4 + l.l_suppkey % 18 AS INT) AS planned_delivery,
           CASE WHEN (l.l_orderkey * 31 + l.l_partkey * 17 + l.l_linenumber * 7) % 100 <
                     CASE WHEN l.l_suppkey % 10 = 3 THEN 90 - (l.l_suppkey * 11) % 35 ELSE 45 - (l.l_suppkey * 37) % 45 END
                THEN 1 + (l.l_orderkey + l.l_partkey) % 9 ELSE 0 END AS late_days,
           l.l_orderkey, l.l_linenumber, l.l_partkey
    FROM lineitem l
    JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN part p ON l.l_partkey = p.p_partkey
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n1 ON s.s_nationkey = n1.n_nationkey
    JOIN nation n2 ON c.c_nationkey = n2.n_nationkey) a) b""",
    "shipments": """
SELECT company_id, product_id, supplier_id, origin, destination, carrier, transport_mode, distance_km,
       weight_kg, quantity, order_date, planned_delivery, l_orderkey, l_linenumber, l_partkey, actual_delivery,
       concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(supplier_id AS VARCHAR)) AS shipment_key
FROM shipments_truth""",
    "inventory_records": """
SELECT p.company_id, p.product_id, w.warehouse_id, DATE '2001-01-01' + CAST(28 * k.k AS INT) AS record_date,
       CAST((p.product_id * 37 + k.k * 53 + w.warehouse_id * 11) % 900
            + CASE WHEN p.product_id % 13 = 0 THEN 2000 ELSE 0 END AS DOUBLE) AS inventory_level,
       CAST(p.product_id % 50 AS DOUBLE) AS safety_stock
FROM products p
CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5),(6),(7),(8),(9),(10),(11)) AS k(k)
CROSS JOIN (VALUES (1),(2)) AS w(warehouse_id)""",
    "sales_pool": """
SELECT product_id % 100 AS product_id, sale_date, sum(quantity) AS quantity, max(promotion) AS promotion
FROM sales GROUP BY product_id % 100, sale_date""",
    "event_metric": """
SELECT event_type AS product_id, CAST(ts AS DATE) AS date, value AS quantity, event_id FROM events""",
    "raw_sales": """
SELECT CASE WHEN l.l_orderkey % 97 = 0 THEN NULL WHEN l.l_orderkey % 89 = 0 THEN '  ' ELSE p.p_brand END AS "SKU",
       CASE WHEN l.l_orderkey % 83 = 0 THEN '-5' WHEN l.l_orderkey % 79 = 0 THEN 'n/a'
            ELSE CAST(CAST(l.l_quantity AS INT) AS VARCHAR) END AS "Qty_Sold",
       CASE WHEN l.l_orderkey % 73 = 0 THEN 'not-a-date' ELSE CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR) END AS "Date",
       l.l_returnflag AS "Region",
       l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey""",
    "raw_inventory": """
SELECT 'SKU-' || CAST(product_id AS VARCHAR) AS "Product_ID",
       CASE WHEN product_id % 41 = 0 THEN '-' || printf('%.1f', inventory_level)
            ELSE printf('%.1f', inventory_level) END AS "Stock",
       CAST(record_date AS VARCHAR) AS "Date", 'WH-' || CAST(warehouse_id AS VARCHAR) AS "Warehouse",
       printf('%.1f', safety_stock) AS "Min_Stock", company_id, warehouse_id AS src_warehouse_id
FROM inventory_records""",
    "raw_shipments": """
SELECT shipment_key AS "Shipment_No", 'SKU-' || CAST(product_id AS VARCHAR) AS "SKU",
       origin AS "Ship_From", destination AS "Ship_To", CAST(planned_delivery AS VARCHAR) AS "ETA",
       CASE WHEN l_orderkey % 67 = 0 THEN CAST(planned_delivery - 730 AS VARCHAR)
            ELSE CAST(actual_delivery AS VARCHAR) END AS "Delivery_Date",
       carrier AS "Carrier",
       CASE WHEN l_orderkey % 61 = 0 THEN '-' || printf('%.1f', distance_km) ELSE printf('%.1f', distance_km) END
         AS "Distance_KM",
       printf('%.2f', weight_kg) AS "Weight_KG", transport_mode AS "Mode", printf('%.1f', quantity) AS "Qty",
       CAST(order_date AS VARCHAR) AS "Order_Date", CAST(supplier_id AS VARCHAR) AS "Vendor_ID",
       company_id, l_orderkey, l_linenumber, l_partkey, supplier_id
FROM shipments""",
    "raw_suppliers": """
SELECT CAST(supplier_id AS VARCHAR) AS "Vendor_ID", name AS "Vendor_Name",
       CASE WHEN supplier_id % 23 = 0 THEN '-1' ELSE printf('%.1f', lead_time_days) END AS "Lead_Time_Days",
       CASE WHEN supplier_id % 19 = 0 THEN '1.5' WHEN supplier_id % 17 = 0 THEN NULL
            ELSE printf('%.2f', reliability) END AS "On_Time_Rate",
       printf('%.2f', cost_index) AS "Cost_Index", printf('%.3f', defect_rate) AS "Reject_Rate",
       company_id, 0 AS row_version, supplier_id AS row_key
FROM suppliers
UNION ALL
SELECT CAST(supplier_id AS VARCHAR), name || ' (renamed)', NULL, NULL, printf('%.2f', cost_index + 0.05), NULL,
       company_id, 1, supplier_id
FROM suppliers WHERE supplier_id % 7 = 0""",
}

# adapter -> adapters it reads
DEPENDS = {
    "shipments": ["shipments_truth"],
    "inventory_records": ["products"],
    "sales_pool": ["sales"],
    "raw_inventory": ["inventory_records"],
    "raw_shipments": ["shipments"],
    "raw_suppliers": ["suppliers"],
}

ORDER = list(ADAPTERS)


def _closure(names):
    out = set()
    stack = list(names)
    while stack:
        n = stack.pop()
        if n in out:
            continue
        out.add(n)
        stack.extend(DEPENDS.get(n, []))
    return [n for n in ORDER if n in out]


def oracle(adapters: str, body: str) -> str:
    """``WITH <adapters>, <body>``; ``body`` is more CTEs followed by a SELECT, or just a SELECT."""
    names = _closure([a.strip() for a in adapters.split(",") if a.strip()])
    head = ",\n".join(f"{n} AS ({ADAPTERS[n]}\n)" for n in names)
    body = body.strip()
    if not names:
        return body
    sep = "\n" if body[:6].upper() == "SELECT" else ",\n"
    return f"WITH {head}{sep}{body}"
