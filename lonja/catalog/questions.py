"""Standing business questions."""

import datetime as dt

from lonja.catalog.general import NET_SAFE, SALE
from lonja.catalog.params import IN30, LAST_30, LY30, YTD, money_avg
from lonja.catalog.registry import Catalog
from lonja.functions.periods import Range, year_before
from lonja.plans import questions as q

LINES = "r_lines l JOIN r_tickets v ON l.ticket_id = v.ticket_id JOIN r_items p ON l.item_id = p.item_id WHERE v.is_sale"
COST = "SUM(l.units * p.unit_cost)"
MARGIN = f"ROUND(CAST(SUM(l.net) - {COST} AS DOUBLE) / NULLIF(CAST(SUM(l.net) AS DOUBLE), 0) * 100, 1)"
YEAR = "BETWEEN DATE '2001-01-01' AND DATE '2001-06-15'"
YEAR_LY = "BETWEEN DATE '2000-01-01' AND DATE '2000-06-15'"
STOCK = "r_stock s JOIN r_items p ON s.item_id = p.item_id WHERE s.qty > 0"


def register(c: Catalog) -> None:
    _items(c)
    _sales(c)
    _stock(c)
    _wholesale(c)
    _customers(c)
    _payments(c)
    _margins(c)
    _transfers(c)


def _items(c: Catalog) -> None:
    c.add("e10_1_top_items_by_units", "ref s, description s, units d", q.top_items_by_units,
          f"SELECT ref, description, SUM(units) AS units FROM {LINES} GROUP BY 1, 2 ORDER BY units DESC, ref LIMIT 10")
    c.add("e10_1_top_items_by_amount", "ref s, description s, net d, units d", q.top_items_by_amount,
          f"SELECT ref, description, SUM(l.net) AS net, SUM(units) AS units FROM {LINES} GROUP BY 1, 2 ORDER BY net DESC, ref LIMIT 10")
    c.add("e10_1_top_items_with_stock", "ref s, description s, units d, stock l", lambda s: q.top_items_with_stock(s, LAST_30), f"""
        WITH sold AS (SELECT l.item_id, SUM(units) AS units FROM {LINES} AND l.sale_date {IN30} GROUP BY 1), held AS (SELECT item_id, SUM(qty) AS qty FROM r_stock GROUP BY 1)
        SELECT ref, description, SUM(units) AS units, COALESCE(SUM(qty), 0) AS stock FROM sold JOIN r_items p ON p.item_id = sold.item_id
        LEFT JOIN held ON held.item_id = sold.item_id GROUP BY 1, 2 ORDER BY units DESC, ref LIMIT 20""")
    c.add("e10_1_top_wholesale_items", "ref s, description s, units d, total d", q.wholesale_items_by_units, """
        WITH billed AS (SELECT item_id, SUM(units) AS units, SUM(total) AS total FROM r_invoice_lines SEMI JOIN r_invoices USING (invoice_id) WHERE units > 0 GROUP BY item_id),
        named AS (SELECT ref, description, billed.* FROM billed JOIN r_items USING (item_id))
        SELECT ref, description, SUM(units) AS units, SUM(total) AS total FROM named GROUP BY ref, description ORDER BY units DESC, ref LIMIT 20""")


def _sales(c: Catalog) -> None:
    c.add("e10_2_store_sales", "store s, net d, tickets l", lambda s: q.store_sales(s, LAST_30),
          f"SELECT store, SUM(net) AS net, COUNT(DISTINCT ticket_id) AS tickets FROM r_tickets WHERE {SALE} AND sale_date {IN30} GROUP BY 1")
    c.add("e10_2_store_sales_comparison", "store s, net d, tickets l", lambda s: q.store_sales(s, year_before(LAST_30)),
          f"SELECT store, SUM(net) AS net, COUNT(DISTINCT ticket_id) AS tickets FROM r_tickets WHERE {SALE} AND sale_date {LY30} GROUP BY 1")
    c.add("e10_3_average_ticket", "avg_ticket d", lambda s: q.average_ticket(s, LAST_30),
          f"SELECT {money_avg('SUM(net)', 'COUNT(DISTINCT ticket_id)')} AS avg_ticket FROM r_tickets WHERE {SALE} AND sale_date {IN30}")
    c.add("e10_3_average_ticket_by_store", "store s, tickets l, avg_ticket d", lambda s: q.average_ticket_by_store(s, LAST_30), f"""
        SELECT store, COUNT(DISTINCT ticket_id) AS tickets, {money_avg('SUM(net)', 'COUNT(DISTINCT ticket_id)')} AS avg_ticket
        FROM r_tickets WHERE {SALE} AND sale_date {IN30} GROUP BY 1""")
    c.add("e10_3_total_sales", "net d, tickets l", lambda s: q.total_sales(s, LAST_30),
          f"SELECT SUM(net) AS net, COUNT(DISTINCT ticket_id) AS tickets FROM r_tickets WHERE is_sale AND sale_date {IN30}")
    c.add("e10_3_units_sold", "units d", lambda s: q.units_sold(s, LAST_30),
          f"SELECT SUM(units) AS units FROM r_lines l JOIN r_tickets v ON l.ticket_id = v.ticket_id WHERE v.is_sale AND v.sale_date {IN30}")
    c.add("e10_4_returns", "returns l, amount d", lambda s: q.returns(s, LAST_30),
          f"SELECT COUNT(*) AS returns, ABS(SUM(net)) AS amount FROM r_tickets WHERE NOT is_sale AND sale_date {IN30}")
    c.add("e10_5_year_comparison", "period s, net d, tickets l", lambda s: q.year_comparison(s, YTD, year_before(YTD)), f"""
        WITH years AS (SELECT *, CASE WHEN sale_date {YEAR} THEN 'Este año' WHEN sale_date {YEAR_LY} THEN 'Año anterior' END AS period FROM r_tickets)
        SELECT period, SUM(net) AS net, COUNT(*) AS tickets FROM years WHERE is_sale AND period IS NOT NULL GROUP BY period""")
    c.add("e10_5_store_year_comparison", "store s, this_year d, last_year d", lambda s: q.store_year_comparison(s, YTD, year_before(YTD)), f"""
        WITH sold AS (SELECT store, net, sale_date {YEAR} AS newer, sale_date {YEAR_LY} AS older FROM r_tickets WHERE {SALE})
        SELECT store, COALESCE(SUM(net) FILTER (newer), 0) AS this_year, COALESCE(SUM(net) FILTER (older), 0) AS last_year FROM sold WHERE newer OR older GROUP BY store""")
    c.add("e10_6_store_months", "month date, store s, net d, tickets l", lambda s: q.store_months(s, YTD),
          f"SELECT date_trunc('month', sale_date) AS month, store, SUM(net) AS net, COUNT(DISTINCT ticket_id) AS tickets FROM r_tickets WHERE {SALE} AND sale_date {YEAR} GROUP BY 1, 2")
    c.add("e10_6_weekdays", "day s, dow l, net d, tickets l", lambda s: q.weekdays(s, YTD),
          f"SELECT dayname(sale_date) AS day, dayofweek(sale_date) AS dow, SUM(net) AS net, COUNT(DISTINCT ticket_id) AS tickets FROM r_tickets WHERE {SALE} AND sale_date {YEAR} GROUP BY 1, 2")
    for column in ("family", "department", "season", "brand", "color"):
        inner = " AND family_id IS NOT NULL" if column == "family" else ""
        name = f"e10_7_sales_by_{column}" if column != "color" else "e11_12_sales_by_color"
        c.add(name, f"{column} s, net d, units d, refs l", lambda s, col=column: q.sales_by(s, col, family=col == "family"),
              f"SELECT {column}, SUM(l.net) AS net, SUM(units) AS units, COUNT(DISTINCT ref) AS refs FROM {LINES}{inner} GROUP BY 1")
    c.add("e10_7_sales_by_season_in_range", "season s, net d, units d, refs l", lambda s: q.sales_by(s, "season", LAST_30),
          f"SELECT season, SUM(l.net) AS net, SUM(units) AS units, COUNT(DISTINCT ref) AS refs FROM {LINES} AND l.sale_date {IN30} GROUP BY 1")


def _stock(c: Catalog) -> None:
    c.add("e10_8_catalog_counts", "items l, retail l, wholesale l", q.catalog_counts, """
        WITH kinds AS (SELECT IFNULL(starts_with(ref, 'M'), false) AS bulk, COUNT(*) AS n FROM r_items WHERE active GROUP BY bulk)
        SELECT SUM(n) AS items, COALESCE(SUM(n) FILTER (NOT bulk), 0) AS retail, COALESCE(SUM(n) FILTER (bulk), 0) AS wholesale FROM kinds""")
    c.add("e10_8_items_by_season", "season s, items l, active l", q.items_by_season,
          "SELECT season, COUNT(item_id) AS items, SUM(CASE WHEN active THEN 1 ELSE 0 END) AS active FROM r_items GROUP BY 1")
    c.add("e10_9_stock_by_store", "store s, qty l, items l", q.stock_by_store,
          "SELECT store, SUM(qty) AS qty, COUNT(DISTINCT item_id) AS items FROM r_stock WHERE qty > 0 GROUP BY 1")
    c.add("e10_9_central_stock", "item_id l, ref s, description s, qty l", q.central_stock,
          "SELECT s.item_id, ref, description, qty FROM r_central s JOIN r_items p ON s.item_id = p.item_id WHERE qty > 0 ORDER BY qty DESC, 1 LIMIT 20")
    c.add("e10_9_stock_value", "value d, units l, refs l", q.stock_value,
          f"SELECT SUM(qty * unit_cost) AS value, SUM(qty) AS units, COUNT(DISTINCT s.item_id) AS refs FROM {STOCK} AND active")
    c.add("e10_9_stock_by_item_size", "item_id l, ref s, size s, qty l", q.stock_by_item_size,
          f"SELECT s.item_id, ref, size, SUM(qty) AS qty FROM {STOCK} GROUP BY 1, 2, 3")
    c.add("e10_9_negative_stock", "item_id l, ref s, store s, size s, qty l", q.negative_stock,
          "SELECT s.item_id, ref, store, size, qty FROM r_stock s JOIN r_items p ON s.item_id = p.item_id WHERE qty < 0 ORDER BY qty, 1, store, size LIMIT 50")
    for column in ("family", "season"):
        inner = " AND family_id IS NOT NULL" if column == "family" else ""
        c.add(f"e10_9_stock_by_{column}", f"{column} s, refs l, qty l, value d", lambda s, col=column: q.stock_by(s, col, family=col == "family"),
              f"SELECT {column}, COUNT(DISTINCT ref) AS refs, SUM(qty) AS qty, ROUND(SUM(qty * unit_cost), 2) AS value FROM {STOCK} AND active{inner} GROUP BY 1")
    c.add("e10_10_dead_stock", "ref s, description s, season s, qty l", lambda s: q.dead_stock(s, LAST_30), f"""
        WITH moving AS (SELECT item_id FROM r_lines SEMI JOIN (FROM r_tickets WHERE is_sale) USING (ticket_id) WHERE sale_date {IN30}),
        still AS (FROM r_items ANTI JOIN moving USING (item_id) WHERE active)
        SELECT ref, description, season, SUM(qty) AS qty FROM still JOIN (FROM r_stock WHERE qty > 10) USING (item_id)
        GROUP BY ALL ORDER BY qty DESC, ref LIMIT 30""")


def _wholesale(c: Catalog) -> None:
    c.add("e10_11_wholesale_by_rep", "rep s, invoices l, net d", q.wholesale_by_rep,
          f"SELECT rep, COUNT(DISTINCT invoice_id) AS invoices, SUM({NET_SAFE}) AS net FROM r_invoices f JOIN r_reps r ON f.rep_id = r.rep_id WHERE NOT credit_note GROUP BY 1")
    c.add("e10_11_wholesale_by_month", "month date, invoices l, net d", lambda s: q.wholesale_by_month(s, YTD),
          f"SELECT date_trunc('month', invoice_date) AS month, COUNT(DISTINCT invoice_id) AS invoices, SUM({NET_SAFE}) AS net FROM r_invoices WHERE NOT credit_note AND invoice_date {YEAR} GROUP BY 1")
    c.add("e10_11_wholesale_customers", "name s, invoices l, net d", q.wholesale_customers, f"""
        SELECT name, COUNT(DISTINCT invoice_id) AS invoices, SUM({NET_SAFE}) AS net FROM r_invoices f JOIN r_customers c ON f.customer_id = c.customer_id
        WHERE NOT credit_note GROUP BY 1 ORDER BY net DESC, name LIMIT 20""")
    c.add("e10_11_deliveries", "deliveries l, units d, net d", lambda s: q.deliveries(s, LAST_30),
          f"SELECT COUNT(*) AS deliveries, SUM(units) AS units, SUM({NET_SAFE}) AS net FROM r_deliveries WHERE NOT credit_note AND sent_on {IN30}")
    c.add("e10_11_credit_notes", "name s, notes l, net d", lambda s: q.credit_notes(s, YTD), f"""
        SELECT name, COUNT(*) AS notes, SUM({NET_SAFE}) AS net FROM r_deliveries a JOIN r_customers c ON a.customer_id = c.customer_id
        WHERE credit_note AND sent_on {YEAR} GROUP BY 1 ORDER BY net DESC, name LIMIT 20""")


def _customers(c: Catalog) -> None:
    known = f"is_sale AND customer_id > 0 AND sale_date {YEAR}"
    c.add("e10_12_best_customers", "name s, purchases l, net d", lambda s: q.best_customers(s, YTD), f"""
        SELECT name, COUNT(DISTINCT ticket_id) AS purchases, SUM(net) AS net FROM r_tickets v JOIN r_customers c ON v.customer_id = c.customer_id
        WHERE v.customer_id > 0 AND is_sale AND sale_date {YEAR} GROUP BY 1 ORDER BY net DESC, name LIMIT 20""")
    c.add("e10_12_unique_customers", "customers l, anonymous l, tickets l", lambda s: q.unique_customers(s, LAST_30), f"""
        WITH visits AS (SELECT customer_id, COUNT(*) AS n FROM r_tickets WHERE is_sale AND sale_date {IN30} GROUP BY customer_id)
        SELECT COUNT(customer_id) AS customers, COALESCE(SUM(n) FILTER (customer_id = 0), 0) AS anonymous, SUM(n) AS tickets FROM visits""")
    c.add("e10_12_new_customers", "customers l, retail l, wholesale l", lambda s: q.new_customers(s, Range(dt.date(1995, 3, 1), dt.date(1995, 12, 31))), f"""
        WITH new AS (SELECT is_wholesale, COUNT(*) AS n FROM r_customers WHERE created_on >= DATE '1995-03-01' AND created_on < DATE '1996-01-01' GROUP BY is_wholesale)
        SELECT SUM(n) AS customers, COALESCE(SUM(n) FILTER (NOT is_wholesale), 0) AS retail, COALESCE(SUM(n) FILTER (is_wholesale), 0) AS wholesale FROM new""")
    c.add("e10_12_purchase_frequency", "segment s, customers l", lambda s: q.purchase_frequency(s, YTD), f"""
        WITH bands (segment, least) AS (VALUES ('1 compra', 1), ('2-3 compras', 2), ('4-10 compras', 4), ('Más de 10', 11)),
        visits AS (SELECT customer_id, COUNT(*) AS least FROM r_tickets WHERE {known} GROUP BY customer_id)
        SELECT segment, COUNT(*) AS customers FROM visits ASOF JOIN bands ON visits.least >= bands.least GROUP BY segment""")


def _payments(c: Catalog) -> None:
    paid = f"FROM r_payments WHERE is_collection AND paid_on {IN30}"
    c.add("e10_13_payments_by_method", "method s, payments l, amount d", lambda s: q.payments_by_method(s, LAST_30),
          f"SELECT method, COUNT(*) AS payments, SUM(amount) AS amount {paid} GROUP BY 1")
    c.add("e10_13_payments_by_store_method", "store s, method s, payments l, amount d", lambda s: q.payments_by_store_method(s, LAST_30),
          f"SELECT store, method, COUNT(*) AS payments, SUM(amount) AS amount {paid} AND store <> '24' GROUP BY 1, 2")
    c.add("e10_13_cash_or_card", "store s, cash d, other d, total d", lambda s: q.cash_or_card(s, LAST_30, cash_code="1"), f"""
        WITH codes AS (SELECT store, method_code, SUM(amount) AS amount {paid} AND store <> '24' GROUP BY ALL)
        SELECT store, COALESCE(SUM(amount) FILTER (method_code = '1'), 0) AS cash, COALESCE(SUM(amount) FILTER (method_code <> '1'), 0) AS other, SUM(amount) AS total
        FROM codes GROUP BY store""")
    c.add("e10_13_payments_by_day_method", "paid_on date, method s, payments l, amount d", lambda s: q.payments_by_day_method(s, LAST_30),
          f"SELECT paid_on, method, COUNT(*) AS payments, SUM(amount) AS amount {paid} GROUP BY 1, 2")


def _margins(c: Catalog) -> None:
    for column in ("family", "department"):
        inner = " AND family_id IS NOT NULL" if column == "family" else ""
        c.add(f"e10_14_margin_by_{column}", f"{column} s, net d, cost d, margin_pct d", lambda s, col=column: q.margin_by(s, col, family=col == "family"),
              f"SELECT {column}, SUM(l.net) AS net, {COST} AS cost, {MARGIN} AS margin_pct FROM {LINES} AND l.net > 0{inner} GROUP BY 1")
    c.add("e10_14_margin_by_store", "store s, net d, cost d, margin_pct d", q.margin_by_store,
          f"SELECT store, SUM(l.net) AS net, {COST} AS cost, {MARGIN} AS margin_pct FROM {LINES} AND l.net > 0 AND store <> '24' GROUP BY 1")
    c.add("e10_14_low_margin_items", "ref s, description s, net d, margin_pct d", q.low_margin_items, f"""
        SELECT ref, description, SUM(l.net) AS net, {MARGIN} AS margin_pct FROM {LINES} AND l.net > 0 GROUP BY 1, 2
        HAVING CAST(SUM(l.net) - {COST} AS DOUBLE) / NULLIF(CAST(SUM(l.net) AS DOUBLE), 0) < 0.30 ORDER BY margin_pct, ref LIMIT 30""")
    c.add("e10_14_wholesale_margin_by_rep", "rep s, total d, cost d, margin_pct d", q.wholesale_margin_by_rep, f"""
        SELECT rep, SUM(l.total) AS total, {COST} AS cost, ROUND(CAST(SUM(l.total) - {COST} AS DOUBLE) / NULLIF(CAST(SUM(l.total) AS DOUBLE), 0) * 100, 1) AS margin_pct
        FROM r_invoice_lines l JOIN r_invoices f ON l.invoice_id = f.invoice_id JOIN r_reps r ON r.rep_id = f.rep_id LEFT JOIN r_items p ON p.item_id = l.item_id
        WHERE l.total > 0 GROUP BY 1""")


def _transfers(c: Catalog) -> None:
    c.add("e10_15_transfers_by_route", "from_store s, to_store s, transfers l, units d", lambda s: q.transfers_by_route(s, LAST_30), f"""
        SELECT from_store, to_store, COUNT(*) AS transfers, SUM(units_out) AS units FROM r_transfers WHERE NOT is_in AND out_date {IN30}
        GROUP BY 1, 2 ORDER BY units DESC, 1, 2 LIMIT 20""")
    c.add("e10_15_transfers_by_day", "out_date date, transfers l, units d", lambda s: q.transfers_by_day(s, LAST_30),
          f"SELECT out_date, COUNT(*) AS transfers, SUM(units_out) AS units FROM r_transfers WHERE NOT is_in AND out_date {IN30} GROUP BY 1")
    c.add("e10_15_item_movements", "out_date date, from_store s, to_store s, size s, units_out d, kind s, transfer_id l",
          lambda s: q.item_movements(s, "ECONOMY-1"), """
        SELECT out_date, from_store, to_store, size, units_out, kind, transfer_id FROM r_transfers t JOIN r_items p ON t.item_id = p.item_id
        WHERE ref = 'ECONOMY-1' AND NOT is_in ORDER BY out_date DESC, transfer_id, size LIMIT 50""")
