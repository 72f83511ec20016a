"""The role tables in SQL, for the side-by-side check."""

D = "AS DECIMAL(15,2))"
NET = "CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(15,2))"
SIGNED = "CAST(SUM(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END) AS INTEGER)"

CTES = {
    "r_stores": """SELECT CAST(n_nationkey AS VARCHAR) AS store, CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS name,
        CASE WHEN n_nationkey % 10 <> 0 THEN 'Town ' || n_regionkey END AS town,
        make_date(2001, 1, n_nationkey + 1) AS updated_on FROM nation""",
    "r_customers": """SELECT c_custkey AS customer_id, c_custkey AS customer_no,
        CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_name END AS name,
        CASE WHEN c_custkey % 2 = 0 THEN 'NIF' || c_custkey END AS tax_id,
        DATE '1995-01-01' + CAST(c_custkey % 2400 AS INTEGER) AS created_on,
        DATE '2001-01-01' + CAST(c_custkey % 200 AS INTEGER) AS last_purchase,
        CAST(c_nationkey AS VARCHAR) AS store, c_mktsegment = 'MACHINERY' AS is_wholesale FROM customer""",
    "r_items": """SELECT p_partkey AS item_id, p_type || '-' || p_partkey AS ref,
        CASE WHEN p_size <> 15 THEN p_name END AS description, CASE WHEN p_size <> 14 THEN p_type END AS family_id,
        CASE WHEN p_size = 13 THEN ' ' WHEN p_size <> 14 THEN p_type || CASE WHEN p_size % 2 = 0 THEN ' ' ELSE '' END END AS family,
        split_part(p_name, ' ', -1) AS department, split_part(p_name, ' ', 1) AS color,
        CASE WHEN p_size % 2 = 0 THEN 'PV0' ELSE 'OI0' END || (p_size % 7) AS season, p_brand AS brand,
        CASE WHEN p_partkey % 2 = 0 THEN 'H' ELSE 'M' END AS sex, p_partkey % 100 AS supplier_id,
        CAST(p_retailprice AS DECIMAL(15,2)) AS unit_cost,
        CAST(CAST(p_retailprice AS DECIMAL(15,2)) * 1.60 AS DECIMAL(15,2)) AS list_price, 21.00 AS vat_rate,
        p_size <= 45 AS active FROM part""",
    "r_suppliers": "SELECT s_suppkey AS supplier_id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE s_name END AS name FROM supplier",
    "r_reps": """SELECT n_nationkey AS rep_id, CASE WHEN n_nationkey % 6 = 1 THEN ' ' ELSE n_name END AS rep
        FROM nation WHERE n_nationkey > 0""",
    "r_tickets": f"""SELECT o_orderkey AS ticket_id, store, CAST(o_orderdate AS DATE) AS sale_date,
        CASE WHEN o_orderstatus <> 'P' THEN CAST(o_totalprice {D} ELSE -CAST(o_totalprice {D} END AS net,
        CASE WHEN o_custkey % 40 = 0 THEN 0 ELSE o_custkey END AS customer_id, o_orderstatus <> 'P' AS is_sale,
        year(o_orderdate) * 100 + month(o_orderdate) AS month
        FROM orders JOIN r_customers ON o_custkey = customer_id WHERE NOT is_wholesale""",
    "r_lines": f"""SELECT l_orderkey AS ticket_id, l_partkey AS item_id, l_linenumber AS line_no,
        CAST(l_shipdate AS DATE) AS sale_date, CAST(l_quantity AS DECIMAL(10,2)) AS units, {NET} AS net,
        CAST(l_discount AS DECIMAL(4,2)) AS discount, year(l_shipdate) * 100 + month(l_shipdate) AS month FROM lineitem""",
    "r_payments": f"""SELECT o_orderkey AS payment_id, o_orderkey AS ticket_id, o_orderpriority AS method,
        left(o_orderpriority, 1) AS method_code, CAST(o_totalprice {D} AS amount, CAST(o_orderdate AS DATE) AS paid_on,
        store, o_orderstatus <> 'P' AS is_collection
        FROM orders JOIN r_customers ON o_custkey = customer_id WHERE NOT is_wholesale""",
    "r_stock": f"""SELECT l_partkey AS item_id, CAST(s_nationkey AS VARCHAR) AS store, CAST(l_linenumber AS VARCHAR) AS size,
        {SIGNED} AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> 24 GROUP BY 1, 2, 3""",
    "r_central": f"""SELECT l_partkey AS item_id, {SIGNED} AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        WHERE s_nationkey = 24 GROUP BY 1""",
    "r_transfers": """SELECT l_orderkey AS transfer_id, l_partkey AS item_id, CAST(l_linenumber AS VARCHAR) AS size,
        CAST(l_quantity AS DECIMAL(10,2)) AS units_out, CAST(l_quantity AS DECIMAL(10,2)) AS units_in,
        CAST(s_nationkey AS VARCHAR) AS from_store, store AS to_store, CAST(l_shipdate AS DATE) AS out_date,
        CAST(l_shipdate AS DATE) + l_linenumber AS in_date, l_returnflag AS kind, is_in
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
        JOIN r_customers ON o_custkey = customer_id CROSS JOIN (VALUES (false), (true)) leg(is_in)""",
    "r_invoices": f"""SELECT o_orderkey AS invoice_id, CAST(o_orderdate AS DATE) AS invoice_date, o_custkey AS customer_id,
        CAST(store AS INTEGER) AS rep_id, CAST(CAST(o_totalprice {D} * 0.70 {D} AS base1,
        CAST(o_totalprice {D} - CAST(CAST(o_totalprice {D} * 0.70 {D} AS base2,
        CASE WHEN left(o_orderpriority, 1) <> '5' THEN CAST(0 {D} END AS base3, CAST(o_totalprice {D} AS total,
        o_orderstatus = 'P' AS credit_note FROM orders JOIN r_customers ON o_custkey = customer_id WHERE is_wholesale""",
    "r_invoice_lines": f"""SELECT l_orderkey AS invoice_id, l_partkey AS item_id, 'line ' || l_linenumber AS description,
        CAST(l_quantity AS DECIMAL(10,2)) AS units, {NET} AS total, CAST(l_shipdate AS DATE) AS line_date FROM lineitem""",
    "r_deliveries": f"""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS delivery_id,
        l_orderkey AS delivery_no, o_custkey AS customer_id, CAST(l_shipdate AS DATE) AS sent_on,
        CAST(l_quantity AS DECIMAL(10,2)) AS units, {NET} AS base1, CAST(0 {D} AS base2,
        CASE WHEN l_linenumber <> 7 THEN CAST(0 {D} END AS base3, l_returnflag = 'R' AS credit_note
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN r_customers ON o_custkey = customer_id WHERE is_wholesale""",
    "r_gc_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS ordered_on,
        SUM(CAST(l_quantity AS DECIMAL(10,2))) AS ordered,
        COALESCE(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(10,2)) END), 0) AS delivered,
        SUM(CAST(l_quantity AS DECIMAL(10,2))) - COALESCE(SUM(CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(10,2)) END), 0) AS pending,
        'PV' || strftime(o_orderdate, '%y') AS season, o_orderstatus = 'F' AS closed, o_orderstatus = 'P' AS credit_note
        FROM orders JOIN r_customers ON o_custkey = customer_id JOIN lineitem ON l_orderkey = o_orderkey
        WHERE is_wholesale GROUP BY o_orderkey, o_custkey, o_orderdate, o_orderstatus""",
    "r_collections": f"""SELECT invoice_id, CAST(total * 0.50 {D} AS amount FROM r_invoices WHERE invoice_id % 3 <> 0
        UNION ALL SELECT invoice_id, total - CAST(total * 0.50 {D} FROM r_invoices WHERE invoice_id % 3 = 1""",
    "r_po": """SELECT l_orderkey || '-' || l_suppkey AS po_id, l_suppkey AS supplier_id, CAST(o_orderdate AS DATE) AS ordered_on,
        CASE WHEN NOT bool_or(l_linestatus = 'O') THEN CAST(MAX(l_shipdate) AS DATE) END AS received_on
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_suppkey, o_orderdate""",
    "r_po_lines": f"""SELECT l_orderkey || '-' || l_suppkey || '-' || l_linenumber AS po_line_id, l_orderkey || '-' || l_suppkey AS po_id,
        l_suppkey AS supplier_id, l_partkey AS item_id, CAST(l_quantity AS DECIMAL(10,2)) AS units, {NET} AS net FROM lineitem""",
    "r_receipts": """SELECT 'R' || po_id AS receipt_id, po_id, r_po.supplier_id, name AS supplier_name, received_on
        FROM r_po LEFT JOIN r_suppliers ON r_suppliers.supplier_id = r_po.supplier_id WHERE received_on IS NOT NULL""",
    "r_events": "SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events",
    "r_timed": f"""SELECT event_id AS ticket_id, CAST(user_id % 25 AS VARCHAR) AS store, CAST(ts AS DATE) AS sale_date, hour(ts) AS hour,
        CASE WHEN event_type = 'error' THEN -CAST(value {D} ELSE CAST(value {D} END AS net, event_type <> 'error' AS is_sale FROM events""",
    "r_run_tables": """SELECT event_id AS entry_id, user_id AS run_id, event_type || '_' || (k % 4) AS feed, ts AS started_at,
        CAST(floor(value * 1000) AS BIGINT) AS duration_ms, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
        CASE WHEN event_type = 'error' THEN 0 ELSE k END AS rows_synced FROM r_events""",
    "r_runs": """SELECT run_id, MIN(started_at) AS started_at, MAX(started_at + to_milliseconds(duration_ms)) AS finished_at,
        (epoch_us(MAX(started_at + to_milliseconds(duration_ms))) - epoch_us(MIN(started_at))) // 1000 AS duration_ms,
        COUNT(*) FILTER (WHERE status = 'ok') AS tables_ok, COUNT(*) FILTER (WHERE status <> 'ok') AS tables_failed,
        COUNT(*) AS total_tables, SUM(rows_synced) AS total_rows,
        CASE WHEN COUNT(*) FILTER (WHERE status <> 'ok') = 0 THEN 'success'
             WHEN COUNT(*) FILTER (WHERE status = 'ok') = 0 THEN 'failed' ELSE 'partial' END AS status
        FROM r_run_tables GROUP BY run_id""",
    "r_watermarks": """SELECT feed, MAX(started_at) AS last_sync_at, SUM(rows_synced) AS rows_synced,
        CASE WHEN arg_max(status, (started_at, entry_id)) = 'failed' THEN 'error' ELSE 'ok' END AS status
        FROM r_run_tables GROUP BY feed""",
}
