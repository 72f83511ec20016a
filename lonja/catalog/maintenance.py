"""Ingest, merge, filters, joins, functions and streaming jobs over the test tables."""

import datetime as dt
import functools

from pyspark.sql import functions as F

from lonja.catalog.general import SALE
from lonja.catalog.params import AS_OF, IN30, LAST_30, LY30
from lonja.catalog.registry import Catalog
from lonja.functions import labels as L
from lonja.functions import periods as T
from lonja.functions import predicates as P
from lonja.functions import stats
from lonja.model import SPECS
from lonja.operators import control, ingest, merge, publish, ranking
from lonja.operators.filters import Filters
from lonja.plans import analyses, base, home, monitor
from lonja.plans import questions as q
from lonja.session import scratch_dir, written
from lonja.sources import io, telemetry
from lonja.sources.tpch import SCHEMAS, money
from lonja.streaming import jobs

TICKET_MAP = {"O_ORDERKEY": "ticket_id", "o_orderpriority": "store", "o_orderdate": "sale_date", "o_totalprice": "net", "o_custkey": "customer_id",
              "not_there": "hour"}
MARK = dt.datetime(2001, 6, 1, 8, 30, tzinfo=dt.timezone.utc)


def _line_table(s):
    """Order lines with one row per (order, line number): the merge target."""
    rows = s.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("qty"), "l_shipdate")
    return merge.latest_per_key(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "qty"])


def _changes(s, base_rows=None):
    """A change set with repeats: even orders doubled, and every seventh order under a new number."""
    base_rows = _line_table(s) if base_rows is None else base_rows
    doubled = base_rows.where("l_orderkey % 2 = 0").withColumn("qty", F.col("qty") * 2)
    stale = doubled.withColumn("l_shipdate", F.lit("1990-01-01").cast("timestamp_ntz")).withColumn("qty", F.lit(-1))
    new = base_rows.where("l_orderkey % 7 = 0").withColumn("l_orderkey", -F.col("l_orderkey") - 1)
    return doubled.unionByName(stale).unionByName(new)


LINES_SQL = """t AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS qty, l_shipdate FROM lineitem
    QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_quantity DESC) = 1)"""
CHANGES_SQL = LINES_SQL + """, d AS (SELECT l_orderkey, l_linenumber, l_partkey, qty * 2 AS qty, l_shipdate FROM t WHERE l_orderkey % 2 = 0),
    n AS (SELECT -l_orderkey - 1 AS l_orderkey, l_linenumber, l_partkey, qty, l_shipdate FROM t WHERE l_orderkey % 7 = 0)"""
LINE_SCHEMA = "l_orderkey long, l_linenumber int, l_partkey long, qty int, l_shipdate timestamp_ntz"
LINE_COLUMNS = "l_orderkey l, l_linenumber l, l_partkey l, qty l, l_shipdate ts"


def register(c: Catalog) -> None:
    _ingest(c)
    _merge(c)
    _filters(c)
    _joins(c)
    _functions(c)
    _streams(c)


def _ingest(c: Catalog) -> None:
    c.add("a1_project_rename", "ticket_id d, store s, sale_date date, net d, customer_id d, hour l",
          lambda s: ingest.project_rename(s.raw("orders"), TICKET_MAP, SPECS["tickets"]), """
        SELECT o_orderkey AS ticket_id, o_orderpriority AS store, CAST(o_orderdate AS DATE) AS sale_date, CAST(o_totalprice AS DECIMAL(15,2)) AS net,
            o_custkey AS customer_id, NULL AS hour FROM orders""")
    c.add("a2_clean_text", "doc_id l, n l, digest s", lambda s: ingest.clean_text(s.raw("documents").select(
        F.col("doc_id").alias("DOC_ID"), F.encode(F.concat("text", F.lit("\u0000end")), "UTF-8").alias("TEXT"))).select(
        "doc_id", F.length("text").alias("n"), F.md5("text").alias("digest")),
        "SELECT doc_id, length(text || 'end') AS n, md5(text || 'end') AS digest FROM documents")
    c.add("a3_quantize_key", "event_id l, key d", lambda s: s.raw("events").select("event_id", ingest.quantize_key("value").alias("key")),
          "SELECT event_id, CAST(CAST(value AS VARCHAR) AS DECIMAL(20,3)) AS key FROM events")
    c.add("a4_decode_int16", "event_id l, word l", lambda s: s.raw("events").select("event_id", ingest.decode_int16(F.pmod(F.col("user_id") * 977, F.lit(65536))).alias("word")), """
        SELECT event_id, CASE WHEN w BETWEEN 32768 AND 65535 THEN w - 65536 ELSE w END AS word FROM (SELECT event_id, user_id * 977 % 65536 AS w FROM events)""")
    c.add("a5_unpivot_slots", "item_id l, store s, size s, qty l", lambda s: ingest.unpivot_slots(s.wide_stock(), ["item_id", "store"], "talla", "stock", 7),
          "SELECT item_id, store, size, qty FROM r_stock")
    c.add("a6_sum_slots", "item_id l, qty l", lambda s: ingest.sum_slots(
        s.wide_stock().select("item_id", *[f"stock{i}" for i in range(1, 8)]), "item_id", "stock", 7).groupBy("item_id").agg(F.sum("qty").alias("qty")),
        "SELECT item_id, SUM(qty) AS qty FROM r_stock WHERE item_id <> 0 GROUP BY 1")
    c.add("a7_quarantine", "good l, bad l", lambda s: base.one_row(*[
        f.agg(F.count(F.lit(1)).alias(n)) for n, f in zip(("good", "bad"), ingest.quarantine(s.items, ["item_id", "description", "family"]))]), """
        SELECT COUNT(*) FILTER (WHERE COALESCE(TRIM(description), '') <> '' AND COALESCE(TRIM(family), '') <> '') AS good,
            COUNT(*) FILTER (WHERE NOT (COALESCE(TRIM(description), '') <> '' AND COALESCE(TRIM(family), '') <> '')) AS bad FROM r_items""")
    c.add("a8_null_if_zero", "item_id l, supplier_id l", lambda s: ingest.null_if_zero(s.items, ["supplier_id"]).select("item_id", "supplier_id"),
          "SELECT item_id, NULLIF(supplier_id, 0) AS supplier_id FROM r_items")
    c.add("a9_exclude_prefix", "item_id l, description s", lambda s: ingest.exclude_prefix(s.items, "description", "sm").select("item_id", "description"),
          "SELECT item_id, description FROM r_items WHERE description IS NULL OR description NOT LIKE 'sm%'")
    c.add("a10_cascade_exclude", "ticket_id l, item_id l, line_no l, units d", lambda s: ingest.cascade_exclude(s.lines, s.items.where("NOT active")).select(
        "ticket_id", "item_id", "line_no", "units"), """
        SELECT ticket_id, item_id, line_no, units FROM r_lines WHERE item_id NOT IN (SELECT item_id FROM r_items WHERE NOT active)""")
    def cascaded(s):
        """Rows per item of four facts after inactive items have left."""
        facts, gone = {"lines": s.lines, "stock": s.stock, "transfers": s.transfers, "purchases": s.purchase_lines}, s.items.where("NOT active")
        parts = [ingest.cascade_exclude(f.select("item_id"), gone).groupBy("item_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("fact", F.lit(n)) for n, f in facts.items()]
        return functools.reduce(lambda x, y: x.unionByName(y), parts)
    c.add("a10_cascade_four_facts", "fact s, item_id l, rows l", cascaded, " UNION ALL ".join(
        f"SELECT '{n}' AS fact, item_id, COUNT(*) AS rows FROM {t} WHERE item_id IN (SELECT item_id FROM r_items WHERE active) GROUP BY 2"
        for n, t in (("lines", "r_lines"), ("stock", "r_stock"), ("transfers", "r_transfers"), ("purchases", "r_po_lines"))))
    c.add("a11_delta_filter", "o_orderkey l, o_orderdate ts", lambda s: merge.delta_filter(s.raw("orders"), "o_orderdate", MARK, 1).select("o_orderkey", "o_orderdate"),
          "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= DATE '2001-05-31'")
    c.add("a23_pick_columns", "p_partkey l, p_brand s", lambda s: ingest.pick_columns(s.raw("part"), ["p_partkey", "missing", "p_brand"]), "SELECT p_partkey, p_brand FROM part")
    c.add("a24_table_totals", "name s, rows l", lambda s: io.row_totals({n: s.raw(n) for n in ("orders", "lineitem", "customer", "part")}).select(
        F.col("table").alias("name"), "rows"), """
        SELECT 'orders' AS name, COUNT(*) AS rows FROM orders UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem
        UNION ALL SELECT 'customer', COUNT(*) FROM customer UNION ALL SELECT 'part', COUNT(*) FROM part""")


def _merge(c: Catalog) -> None:
    key = ["l_orderkey", "l_linenumber"]
    c.add("a12_upsert", LINE_COLUMNS, lambda s: _upserted(s, key), f"""
        WITH {CHANGES_SQL} SELECT * FROM t WHERE l_orderkey % 2 <> 0 UNION ALL SELECT * FROM d UNION ALL SELECT * FROM n""")
    c.add("a13_insert_ignore", LINE_COLUMNS, lambda s: merge.insert_ignore(_line_table(s), _changes(s), key), f"""
        WITH {CHANGES_SQL} SELECT * FROM t UNION ALL SELECT * FROM n""")
    c.add("a14_append", LINE_COLUMNS, lambda s: _appended(s), f"WITH {CHANGES_SQL} SELECT * FROM t UNION ALL SELECT * FROM n")
    c.add("a12_monthly_merge", LINE_COLUMNS + ", month l", _merged_months, f"""
        WITH {CHANGES_SQL}, m AS (SELECT *, false AS changed FROM t WHERE l_orderkey % 2 <> 0 OR year(l_shipdate) <> 2001
            UNION ALL SELECT *, true FROM d WHERE year(l_shipdate) = 2001 UNION ALL SELECT *, true FROM n WHERE year(l_shipdate) = 2001),
        p AS (SELECT *, changed AND l_orderkey % 3 = 0 AS moved FROM m)
        SELECT l_orderkey, l_linenumber, l_partkey, qty, l_shipdate, CASE WHEN moved OR l_orderkey % 10 <> 0
            THEN CAST(strftime(l_shipdate + CASE WHEN moved THEN INTERVAL 1 MONTH ELSE INTERVAL 0 MONTH END, '%Y%m') AS BIGINT) END AS month FROM p""")
    c.add("a15_full_refresh", LINE_COLUMNS, lambda s: _refreshed(s), f"WITH {CHANGES_SQL} SELECT * FROM n")
    c.add("a16_replace_children", "l_orderkey l, l_linenumber l, qty l", lambda s: merge.replace_children(
        _line_table(s), s.raw("orders").where("o_orderdate >= '2001-05-31'").select(F.col("o_orderkey").alias("l_orderkey")),
        _line_table(s).where("l_linenumber <= 3").withColumn("qty", F.col("qty") + 100), "l_orderkey").select("l_orderkey", "l_linenumber", "qty"), f"""
        WITH {LINES_SQL}, p AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2001-05-31')
        SELECT l_orderkey, l_linenumber, qty FROM t WHERE l_orderkey NOT IN (SELECT o_orderkey FROM p)
        UNION ALL SELECT l_orderkey, l_linenumber, qty + 100 FROM t WHERE l_linenumber <= 3 AND l_orderkey IN (SELECT o_orderkey FROM p)""")
    c.add("a16_replace_children_by_month", "l_orderkey l, l_linenumber l, qty l", _replaced_by_month, f"""
        WITH {LINES_SQL}, p AS (SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '2001-05-31')
        SELECT l_orderkey, l_linenumber, qty + 100 AS qty FROM t SEMI JOIN p ON o_orderkey = l_orderkey WHERE l_linenumber <= 3
        UNION ALL SELECT l_orderkey, l_linenumber, qty FROM t ANTI JOIN p ON o_orderkey = l_orderkey""")
    c.add("a19_orphan_repair", "run_id l, status s, tables_ok l, tables_failed l, total_tables l, duration_ms l", lambda s: control.repair_orphans(
        s.runs.withColumn("status", F.when(F.col("run_id") % 10 == 0, "running").otherwise(F.col("status")))
        .withColumns({n: F.when(F.col("run_id") % 10 != 0, F.col(n)) for n in ("tables_failed", "total_tables", "duration_ms")}),
        F.lit(dt.datetime(2024, 2, 1)).cast("timestamp_ntz")), """
        SELECT run_id, CASE WHEN run_id % 10 = 0 THEN 'failed' ELSE status END AS status, tables_ok, CASE WHEN run_id % 10 = 0 THEN 1 ELSE tables_failed END AS tables_failed,
            CASE WHEN run_id % 10 = 0 THEN tables_ok + 1 ELSE total_tables END AS total_tables,
            CASE WHEN run_id % 10 = 0 THEN (epoch_us(TIMESTAMP '2024-02-01 00:00:00') - epoch_us(started_at)) // 1000 ELSE duration_ms END AS duration_ms FROM r_runs""")


def _replaced_by_month(s):
    """Lines kept by the month of their order; those of orders since a day are dropped and read again."""
    lines, orders = _line_table(s), s.raw("orders").select("o_orderkey", "o_orderdate", P.month_of("o_orderdate").cast("int").alias("month"))
    dated = lines.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "month"), "l_orderkey", "left")
    table = publish.stored_table(s.spark, scratch_dir(s.spark, "lines"), LINE_SCHEMA + ", month int", ["l_orderkey", "l_linenumber"], partition="month")
    table.replace(dated)
    parents = orders.where("o_orderdate >= '2001-05-31'").select(F.col("o_orderkey").alias("l_orderkey"), "month")
    table.replace_children(parents, dated.where("l_linenumber <= 3").withColumn("qty", F.col("qty") + 100), "l_orderkey")
    return table.read()


def _merged_months(s):
    """Merge the 2001 changes into a table kept by month: the folders of other years are not touched.

    Every tenth order has no month at first; changed lines of every third order move to the next month.
    """
    month = F.when(F.col("l_orderkey") % 10 != 0, P.month_of("l_shipdate"))
    moved = F.when(F.col("l_orderkey") % 3 == 0, P.month_of(F.add_months("l_shipdate", 1))).otherwise(month)
    table = publish.stored_table(s.spark, scratch_dir(s.spark, "monthly"), LINE_SCHEMA + ", month int", ["l_orderkey", "l_linenumber"], partition="month")
    table.replace(_line_table(s).select("*", month.alias("month")))
    changed = _changes(s).where("year(l_shipdate) = 2001").select("*", moved.alias("month"))
    table.merge(changed, ["l_shipdate"])
    return table.read()


def _upserted(s, keys):
    """The target and the change set are stored tables, as they are in use."""
    lines = written(_line_table(s), "lines")
    return merge.upsert(lines, written(_changes(s, lines), "changes"), keys, ["l_shipdate"])


def _refreshed(s):
    """Publish one content, replace it by another, read the current one."""
    table = publish.stored_table(s.spark, scratch_dir(s.spark, "refresh"), LINE_SCHEMA, ["l_orderkey", "l_linenumber"])
    table.replace(_line_table(s))
    table.replace(_changes(s).where("l_orderkey < 0"))
    return table.read()


def _appended(s):
    path = scratch_dir(s.spark, "append")
    io.append(_line_table(s), path)
    io.append(_changes(s).where("l_orderkey < 0"), path)
    return s.spark.read.parquet(path)


def _filters(c: Catalog) -> None:
    c.add("b1_b4_retail_sales", "ticket_id l, store s, sale_date date, net d", lambda s: s.tickets.where(P.is_retail_sale(s.ghost_store) & P.in_days("sale_date", *LAST_30)),
          f"SELECT ticket_id, store, sale_date, net FROM r_tickets WHERE {SALE} AND sale_date {IN30}")
    c.add("b2_b5_retail_returns", "ticket_id l, store s, net d", lambda s: s.tickets.where(P.is_retail_return(s.ghost_store) & P.in_days_until("sale_date", *LAST_30)),
          "SELECT ticket_id, store, net FROM r_tickets WHERE NOT is_sale AND store <> '24' AND sale_date >= DATE '2001-05-17' AND sale_date < DATE '2001-06-15'")
    c.add("b3_invoices_without_credit_notes", "invoice_id l, total d", lambda s: s.invoices.where(P.is_invoice()), "SELECT invoice_id, total FROM r_invoices WHERE NOT credit_note")
    c.add("b6_month_range", "month l, lines l, net d", lambda s: s.lines.where(P.in_months("month", dt.date(2000, 11, 5), dt.date(2001, 2, 1))).groupBy("month").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("net").alias("net")),
        "SELECT month, COUNT(*) AS lines, SUM(net) AS net FROM r_lines WHERE month BETWEEN 200011 AND 200102 GROUP BY 1")
    ranges = [(n, *T.preset(n, AS_OF)) for n in ("today", "last_7_days", "last_30_days", "current_month", "last_month", "year_to_date")]
    ranges += [(f"previous_{u}", *T.previous_period(u, AS_OF)) for u in T.UNITS] + [(f"current_{u}_", *T.current_period(u, AS_OF)) for u in T.UNITS]
    ranges += [(f"vs_{k}", *T.comparison(LAST_30, k)) for k in ("previous_period", "previous_month", "previous_quarter", "previous_year", "yoy")]
    sql_ranges = """('today', 0, 0), ('last_7_days', 6, 0), ('last_30_days', 29, 0), ('current_month', 14, 0), ('last_month', 45, 15), ('year_to_date', 165, 0),
        ('previous_day', 1, 1), ('previous_week', 11, 5), ('previous_month', 45, 15), ('previous_quarter', 165, 76), ('previous_year', 531, 166),
        ('current_day_', 0, 0), ('current_week_', 4, 0), ('current_month_', 14, 0), ('current_quarter_', 75, 0), ('current_year_', 165, 0),
        ('vs_previous_period', 59, 30), ('vs_previous_month', 75, 46), ('vs_previous_quarter', 165, 76), ('vs_previous_year', 531, 166), ('vs_yoy', 394, 365)"""
    def by_range(s):
        spans = T.constants(s.spark, ranges, "name string, lo date, hi date")
        per_day = home.daily(s, F.col("is_sale") & F.col("sale_date").between(F.lit(min(r[1] for r in ranges)), F.lit(AS_OF))).groupBy("sale_date").agg(F.sum("net").alias("net"))
        days = spans.select("name", "lo", "hi", F.explode(F.sequence("lo", "hi")).alias("sale_date"))
        return days.join(per_day, "sale_date", "left").groupBy("name", "lo", "hi").agg(F.coalesce(F.sum("net"), F.lit(0)).alias("net"))
    c.add("b7_b10_period_ranges", "name s, lo date, hi date, net d", by_range, f"""
        WITH r AS (SELECT name, DATE '2001-06-15' - a AS lo, DATE '2001-06-15' - b AS hi FROM (VALUES {sql_ranges}) v(name, a, b))
        SELECT name, lo, hi, COALESCE(SUM(net), 0) AS net FROM r LEFT JOIN r_tickets ON {SALE} AND sale_date BETWEEN lo AND hi GROUP BY 1, 2, 3""")
    c.add("b11_season_dates", "item_id l, season s, season_start date, season_end date", lambda s: s.items.select(
        "item_id", "season", T.season_start("season").alias("season_start"), T.season_end("season").alias("season_end")), """
        SELECT item_id, season, make_date(2000 + CAST(right(season, 2) AS INTEGER), CASE WHEN season LIKE 'PV%' THEN 2 ELSE 9 END, 1) AS season_start,
            CASE WHEN season LIKE 'PV%' THEN make_date(2000 + CAST(right(season, 2) AS INTEGER), 8, 31) ELSE make_date(2001 + CAST(right(season, 2) AS INTEGER), 1, 31) END AS season_end FROM r_items""")
    picked = Filters({"store": "7", "family": ["PROMO", "SMALL "], "season": ["PV02", "OI05", "OI03"], "brand": [], "department": 5})
    c.add("b13_b15_filtered_sales", "department s, net d, units d", lambda s: base.item_sales(s, T.Range(dt.date(2000, 1, 1), AS_OF), picked, family=True)
          .groupBy("department").agg(F.sum("net").alias("net"), F.sum("units").alias("units")), """
        SELECT department, SUM(l.net) AS net, SUM(l.units) AS units FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id JOIN r_items p ON p.item_id = l.item_id
        WHERE v.is_sale AND v.store <> '24' AND l.net > 0 AND l.sale_date BETWEEN DATE '2000-01-01' AND DATE '2001-06-15' AND v.store = '7'
            AND p.family IN ('PROMO', 'SMALL ') AND p.season IN ('PV02', 'OI05', 'OI03') AND p.family_id IS NOT NULL GROUP BY 1""")
    every = Filters({"sex": ["H"], "department": ["widget", "rod"], "brand": ["Brand#4"], "season": ["PV01", "OI05"], "catalog_family": ["SMALL", "PROMO"],
                     "supplier": [11, 15], "purchase_supplier": [22], "wholesale_customer": [911, 299]})

    def passing(s):
        """How many rows of its table pass each filter."""
        tables = {"purchase_supplier": s.purchase_orders, "wholesale_customer": s.invoices,
                  "catalog_family": s.items.withColumn("family_trimmed", F.trim("family"))}
        counts = [every.apply(tables.get(x, s.items), x).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(x).alias("filter"), "rows") for x in every.values]
        return functools.reduce(lambda a, b: a.unionByName(b), counts)

    c.add("b15_every_filter", "filter s, rows l", passing, """
        SELECT 'sex' AS filter, COUNT(*) AS rows FROM r_items WHERE sex = 'H' UNION ALL SELECT 'department', COUNT(*) FROM r_items WHERE department IN ('rod', 'widget')
        UNION ALL SELECT 'brand', COUNT(*) FROM r_items WHERE brand = 'Brand#4' UNION ALL SELECT 'season', COUNT(*) FROM r_items WHERE season IN ('OI05', 'PV01')
        UNION ALL SELECT 'catalog_family', COUNT(*) FROM r_items WHERE trim(family) IN ('PROMO', 'SMALL') UNION ALL SELECT 'supplier', COUNT(*) FROM r_items WHERE supplier_id IN (11, 15)
        UNION ALL SELECT 'purchase_supplier', COUNT(*) FROM r_po WHERE supplier_id = 22 UNION ALL SELECT 'wholesale_customer', COUNT(*) FROM r_invoices WHERE customer_id IN (911, 299)""")
    c.add("b16_filter_options", "value s, label s", lambda s: picked.options(
        base.with_items(s, base.fold_to_items(base.retail_lines(s, base.line_window(LAST_30), positive=False), "store"), family=True), "family", "family", "family",
        cascade=("store", "family")), f"""
        SELECT DISTINCT p.family AS value, p.family AS label FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id JOIN r_items p ON p.item_id = l.item_id
        WHERE v.{SALE} AND l.sale_date {IN30} AND v.store = '7' AND p.family <> '' AND p.family_id IS NOT NULL""")
    panel = ("store", "family", "season", "brand", "sex", "department")
    lists = {x: (x, x) for x in panel}
    passes = {"store": "store = '7'", "family": "family IN ('PROMO', 'SMALL ')", "season": "season IN ('PV02', 'OI05', 'OI03')"}
    c.add("b16_panel_options", "filter s, value s, label s, rows l", lambda s: picked.facets(
        base.with_items(s, base.fold_to_items(base.retail_lines(s, base.line_window(LAST_30), positive=False), "store"), family=True), lists, panel), f"""
        WITH cells AS (SELECT DISTINCT v.store, p.* FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id JOIN r_items p ON p.item_id = l.item_id
            WHERE v.{SALE} AND l.sale_date {IN30} AND p.family_id IS NOT NULL)
        """ + " UNION ALL ".join(f"SELECT '{x}' AS filter, {x} AS value, {x} AS label, COUNT(*) AS rows FROM cells WHERE {x} <> '' AND " +
                                 " AND ".join(v for k, v in passes.items() if k != x) + " GROUP BY 2" for x in panel))
    c.add("b16_store_options", "value s, label s", lambda s: picked.options(base.retail_tickets(s, LAST_30), "store", "store", "store", cascade=("store",)),
          f"SELECT DISTINCT store AS value, store AS label FROM r_tickets WHERE {SALE} AND sale_date {IN30}")
    c.add("b17_customer_labels", "customer_id l, label s", lambda s: s.customers.select("customer_id", L.customer_label().alias("label")), """
        SELECT customer_id, COALESCE(NULLIF(TRIM(name), ''), NULLIF(TRIM(tax_id), ''), 'Cliente ' || customer_no) AS label FROM r_customers""")
    c.add("b18_channel_split", "department s, retail l, wholesale l", lambda s: s.items.groupBy("department").agg(
        F.count_if(~P.is_wholesale_ref()).alias("retail"), F.count_if(P.is_wholesale_ref()).alias("wholesale")), """
        SELECT department, COUNT(*) FILTER (WHERE ref IS NULL OR ref NOT LIKE 'M%') AS retail, COUNT(*) FILTER (WHERE ref LIKE 'M%') AS wholesale FROM r_items GROUP BY 1""")
    c.add("b19_stock_signs", "store s, positive l, negative l, zero l", lambda s: s.stock.groupBy("store").agg(
        F.count_if(P.has_stock()).alias("positive"), F.count_if(P.is_stock_incident()).alias("negative"), F.count_if(P.is_stocked_out()).alias("zero")), """
        SELECT store, COUNT(*) FILTER (WHERE qty > 0) AS positive, COUNT(*) FILTER (WHERE qty < 0) AS negative, COUNT(*) FILTER (WHERE qty = 0) AS zero FROM r_stock GROUP BY 1""")
    def clipped(s):
        rows, flags = ranking.clip(s.items.select("item_id", "ref", "description", "brand", "season"), 200, 3, F.asc("ref"), F.asc("item_id"))
        return base.one_row(rows, flags)
    c.add("b20_clip_flags", "item_id l, ref s, description s, rows_truncated b, columns_truncated b", clipped, """
        SELECT item_id, ref, description, (SELECT COUNT(*) > 200 FROM part) AS rows_truncated, true AS columns_truncated FROM r_items ORDER BY ref NULLS FIRST, item_id LIMIT 200""")


def _joins(c: Catalog) -> None:
    c.add("c1_lines_with_headers", "ticket_id l, item_id l, line_no l, store s, units d", lambda s: s.lines.where(base.line_window(LAST_30)).join(
        s.tickets.select("ticket_id", "store"), "ticket_id").select("ticket_id", "item_id", "line_no", "store", "units"),
        f"SELECT l.ticket_id, l.item_id, l.line_no, v.store, l.units FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id WHERE l.sale_date {IN30}")
    c.add("c3_unresolved_families", "family s, items l", lambda s: s.items.groupBy(L.family_label().alias("label")).agg(F.count(F.lit(1)).alias("items")).withColumnRenamed("label", "family"),
          "SELECT COALESCE(NULLIF(TRIM(family), ''), 'Sin clasificar') AS family, COUNT(*) AS items FROM r_items GROUP BY 1")
    c.add("c7_not_sold_null_safe", "item_id l", lambda s: s.items.select("item_id").join(
        s.lines.where(base.line_window(LAST_30)).select(F.when(F.col("line_no") != 1, F.col("item_id")).alias("item_id")).distinct(), "item_id", "left_anti"), f"""
        SELECT item_id FROM r_items p WHERE NOT EXISTS (SELECT 1 FROM r_lines l WHERE l.item_id = p.item_id AND l.line_no <> 1 AND l.sale_date {IN30})""")
    c.add("c17_comparison_overlay", "label s, now d, before d", lambda s: analyses.growth_bands(s, LAST_30, T.year_before(LAST_30)).withColumnRenamed("store", "label"), f"""
        SELECT n.store AS label, now, before FROM (SELECT store, SUM(net) AS now FROM r_tickets WHERE {SALE} AND sale_date {IN30} GROUP BY 1) n
        LEFT JOIN (SELECT store, SUM(net) AS before FROM r_tickets WHERE {SALE} AND sale_date {LY30} GROUP BY 1) b ON b.store = n.store""")


def _functions(c: Catalog) -> None:
    c.add("d13_mean_of_daily_totals", "store s, mean_day d, days l", lambda s: home.daily(s, F.col("is_sale") & P.in_days("sale_date", *LAST_30)).groupBy("store").agg(
        (F.sum("net").cast("double") / F.count(F.lit(1))).alias("mean_day"), F.count(F.lit(1)).alias("days")), f"""
        SELECT store, CAST(SUM(d) AS DOUBLE) / COUNT(*) AS mean_day, COUNT(*) AS days FROM (SELECT store, sale_date, SUM(net) AS d FROM r_tickets WHERE {SALE} AND sale_date {IN30} GROUP BY 1, 2) GROUP BY 1""")
    def weekly(s):
        rows = base.retail_tickets(s, T.Range(dt.date(2001, 1, 1), dt.date(2001, 6, 10))).groupBy("store", T.week_start("sale_date").alias("week")).agg(F.sum("net").alias("net"))
        out = stats.anomaly(rows, "net", "week", ("store",))
        return out.select("store", "current", F.round("mean", 6).alias("mean"), F.round("sigma", 4).alias("sigma"), "n", F.round("z_score", 4).alias("z_score"), "is_anomaly", "direction")
    c.add("f4_weekly_anomaly", "store s, current d, mean d, sigma d, n l, z_score d, is_anomaly b, direction s", weekly, f"""
        WITH w AS (SELECT store, CAST(date_trunc('week', sale_date) AS DATE) AS week, CAST(SUM(net) AS DOUBLE) AS net FROM r_tickets WHERE {SALE} AND sale_date BETWEEN DATE '2001-01-01' AND DATE '2001-06-10' GROUP BY 1, 2),
        c AS (SELECT store, MAX(week) AS newest, arg_max(net, week) AS current FROM w GROUP BY 1),
        h AS (SELECT w.store, COUNT(*) AS n, AVG(net) AS mean, stddev_pop(net) AS sigma FROM w JOIN c ON c.store = w.store AND w.week < newest GROUP BY 1),
        z AS (SELECT c.store, current, mean, sigma, COALESCE(n, 0) AS n, CASE WHEN n >= 4 THEN CASE WHEN sigma > 0 THEN (current - mean) / sigma ELSE 0 END END AS z_score FROM c LEFT JOIN h ON h.store = c.store)
        SELECT store, current, ROUND(mean, 6) AS mean, ROUND(sigma, 4) AS sigma, n, ROUND(z_score, 4) AS z_score, COALESCE(ABS(z_score) > 2, false) AS is_anomaly,
            CASE WHEN z_score > 2 THEN 'high' WHEN z_score < -2 THEN 'low' WHEN z_score IS NOT NULL THEN 'normal' END AS direction FROM z""")
    c.add("f6_latest_order_per_customer", "o_custkey l, o_orderkey l, o_orderdate ts", lambda s: merge.latest_per_key(
        s.raw("orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]),
        "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
    c.add("g1_g2_bottom_margins", "ref s, margin_pct d", lambda s: ranking.top(q.margin_by(s, "ref").select("ref", "margin_pct"), 15, F.asc_nulls_last("margin_pct"), F.asc("ref")), """
        SELECT ref, ROUND(CAST(SUM(l.net) - SUM(l.units * p.unit_cost) AS DOUBLE) / NULLIF(CAST(SUM(l.net) AS DOUBLE), 0) * 100, 1) AS margin_pct FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id
        JOIN r_items p ON p.item_id = l.item_id WHERE v.is_sale AND l.net > 0 GROUP BY 1 ORDER BY margin_pct ASC NULLS LAST, ref LIMIT 15""")
    mixed = "CASE WHEN item_id % 11 = 0 THEN NULL WHEN item_id % 5 = 0 THEN CAST(item_id * 37 % 1000 AS VARCHAR) WHEN item_id % 5 = 1 THEN ' ' ELSE description END"
    c.add("g4_mixed_sort", "position l, item_id l, cell s", lambda s: ranking.numbered(
        s.items.select("item_id", F.expr(mixed.replace("VARCHAR", "STRING")).alias("cell")), [], [*ranking.mixed_order("cell"), F.asc("item_id")], "position"), f"""
        SELECT ROW_NUMBER() OVER (ORDER BY COALESCE(TRIM(cell) = '', true), TRY_CAST(cell AS DOUBLE) NULLS LAST, lower(cell) NULLS LAST, item_id) AS position, item_id, cell
        FROM (SELECT item_id, {mixed} AS cell FROM r_items)""")
    c.add("g5_page_with_total", "o_orderkey l, o_totalprice d, total l", lambda s: ranking.page_with_total(s.raw("orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey", 7000), """
        SELECT o_orderkey, o_totalprice, (SELECT COUNT(*) FROM orders) AS total FROM orders WHERE o_orderkey > 7000 ORDER BY o_orderkey LIMIT 25""")
    c.add("g5_keyset_page", "o_orderkey l, o_totalprice d", lambda s: ranking.page_after(s.raw("orders").select("o_orderkey", "o_totalprice"), 25, "o_orderkey", 7000),
          "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey > 7000 ORDER BY o_orderkey LIMIT 25")
    c.add("h3_distinct_brands", "brand s", lambda s: s.items.select("brand").distinct(), "SELECT DISTINCT brand FROM r_items")


def _event_stream(s, columns: list[str]):
    return jobs.file_stream(s.spark, s.path, SCHEMAS["events"], glob="events.parquet").select(*columns)


def _scattered_events(s, columns: list[str], files: int = 4):
    """The events dealt to files by a hash, one file to a micro-batch: newer rows come before older ones."""
    folder = scratch_dir(s.spark, "events")
    s.raw("events").repartition(files, "event_id").write.parquet(folder)
    return jobs.file_stream(s.spark, folder, SCHEMAS["events"], files_per_batch=1).select(*columns)


def _streams(c: Catalog) -> None:
    def upserted(s):
        schema = "user_id long, event_id long, ts timestamp_ntz, event_type string, value double"
        table = publish.stored_table(s.spark, scratch_dir(s.spark, "stream-upsert"), schema, ["user_id"], buckets=8)
        jobs.upsert_stream(_scattered_events(s, ["user_id", "event_id", "ts", "event_type", "value"]), table, ["ts", "event_id"], scratch_dir(s.spark, "cp"))
        return table.read()
    c.add("j1_stream_upsert", "user_id l, event_id l, event_type s, value d", upserted, """
        SELECT user_id, event_id, event_type, value FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")

    def hourly(s):
        rows = _event_stream(s, ["ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
        table = publish.stored_table(s.spark, scratch_dir(s.spark, "stream-totals"), "window_start timestamp, total decimal(25,2), rows long", ["window_start"], buckets=4)
        jobs.publish_totals(jobs.windowed_totals(rows, "ts", money("value"), [], "1 hour"), table, scratch_dir(s.spark, "cp"))
        return table.read()

    def recomputed(s):
        """Daily totals of events that come in files over the whole time, and the log of what came when."""
        base_dir, log = scratch_dir(s.spark, "stream-base"), scratch_dir(s.spark, "stream-log")
        table = publish.stored_table(s.spark, scratch_dir(s.spark, "stream-days"), "day date, event_type string, total decimal(25,2), rows long",
                                     ["day", "event_type"], partition="day")
        jobs.recomputed_days(_scattered_events(s, ["ts", "event_type", "value"]), "ts", money("value"), ["event_type"], base_dir, table, log, scratch_dir(s.spark, "cp"))
        return table.read(), s.spark.read.schema("day date, rows long, late boolean, batch int").parquet(log)
    c.add("j2_daily_totals_with_late_data", "window_start ts, event_type s, total d, rows l", lambda s: recomputed(s)[0].withColumnRenamed("day", "window_start"), """
        SELECT date_trunc('day', ts) AS window_start, event_type, SUM(CAST(value AS DECIMAL(15,2))) AS total, COUNT(*) AS rows FROM events GROUP BY 1, 2""")
    c.add("j2_arrivals_by_day", "day date, rows l", lambda s: recomputed(s)[1].groupBy("day").agg(F.sum("rows").alias("rows")),
          "SELECT CAST(ts AS DATE) AS day, COUNT(*) AS rows FROM events GROUP BY 1")

    def once(s):
        out = scratch_dir(s.spark, "stream-once")
        rows = _scattered_events(s, ["user_id", "event_type"])
        jobs.append_once(rows, ["user_id", "event_type"], out, scratch_dir(s.spark, "cp"), buckets=8)
        return s.spark.read.parquet(out)
    c.add("j3_append_once_per_key", "user_id l, event_type s", once, "SELECT DISTINCT user_id, event_type FROM events")
    c.add("j4_running_day_by_hour", "day date, hour l, total d, running d", lambda s: jobs.running_day(hourly(s)), """
        WITH h AS (SELECT date_trunc('hour', ts) AS w, SUM(CAST(value AS DECIMAL(15,2))) AS total FROM events GROUP BY 1)
        SELECT CAST(w AS DATE) AS day, hour(w) AS hour, total, SUM(total) OVER (PARTITION BY CAST(w AS DATE) ORDER BY w) AS running FROM h""")
    def spans_until(s, plan):
        """Run a trace plan over the span stream; a closing row far ahead moves the watermark past the last trace."""
        closing, out = scratch_dir(s.spark, "closing"), scratch_dir(s.spark, "traces")
        s.spark.range(1).select(F.lit("closing").alias("trace_id"), F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz").alias("ts"),
                                F.lit(0).cast("bigint").alias("duration_ms"), F.lit(False).alias("is_error")).write.parquet(closing)
        spans = telemetry.spans_of(_event_stream(s, ["ts", "user_id", "value", "props"]))
        end = jobs.file_stream(s.spark, closing, "trace_id string, ts timestamp_ntz, duration_ms long, is_error boolean")
        rows = spans.unionByName(end).withColumn("ts", F.col("ts").cast("timestamp"))
        jobs.run_available(plan(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_dir(s.spark, "cp")))
        traces = s.spark.read.parquet(out).where("trace_id <> 'closing'")
        return traces.withColumn("keep", monitor.keep_trace(F.col("has_error"), F.col("elapsed_ms"), F.col("trace_id")))
    sampled = """, g AS (SELECT trace_id, bool_or(is_error) AS has_error, COUNT(*) AS spans, (MAX(epoch_us(ts) + duration_ms * 1000) - MIN(epoch_us(ts))) / 1000 AS elapsed_ms
            FROM sp {join} GROUP BY {by})
        SELECT trace_id, has_error, spans, elapsed_ms, has_error OR elapsed_ms > 5000 OR CAST('0x' || left(md5(trace_id), 8) AS BIGINT) % 100 < 10 AS keep FROM g"""
    span_sql = """WITH sp AS (SELECT user_id || '-' || strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y%m%d%H%M') AS trace_id, ts,
            CAST(floor(value * 20) AS BIGINT) AS duration_ms, k % 25 = 0 AS is_error FROM r_events)"""
    c.add("j5_stream_sessions", "trace_id s, has_error b, spans l, elapsed_ms d, keep b", lambda s: spans_until(s, jobs.sessions), span_sql + """,
        o AS (SELECT *, CASE WHEN ts < LAG(ts) OVER w + INTERVAL 10 SECOND THEN 0 ELSE 1 END AS fresh FROM sp WINDOW w AS (PARTITION BY trace_id ORDER BY ts)),
        sp2 AS (SELECT *, SUM(fresh) OVER (PARTITION BY trace_id ORDER BY ts) AS session FROM o)""" + sampled.format(join="", by="trace_id, session").replace("FROM sp ", "FROM sp2 "))
    c.add("j5_stream_decide_after_first", "trace_id s, has_error b, spans l, elapsed_ms d, keep b", lambda s: spans_until(s, jobs.decide_after_first), span_sql + """,
        f AS (SELECT trace_id AS t, MIN(ts) AS first_ts FROM sp GROUP BY 1)""" + sampled.format(join="JOIN f ON t = trace_id AND ts <= first_ts + INTERVAL 10 SECOND", by="trace_id"))
    c.add("j7_stale_feeds", "feed s, last_ts ts, age_hours d, is_stale b", lambda s: jobs.stale_feeds(s.run_tables.groupBy("feed").agg(F.max("started_at").alias("last_ts")),
                                                                                                     dt.datetime(2024, 2, 1, 6), 36), """
        SELECT feed, last_sync_at AS last_ts, ROUND((epoch_us(TIMESTAMP '2024-02-01 06:00:00') - epoch_us(last_sync_at)) / 1e6 / 3600, 4) AS age_hours,
            (epoch_us(TIMESTAMP '2024-02-01 06:00:00') - epoch_us(last_sync_at)) / 1e6 / 3600 > 36 AS is_stale FROM r_watermarks""")

