"""Weekly review."""

from lonja.catalog.general import NET_SAFE, SALE
from lonja.catalog.params import WEEK, money_avg
from lonja.catalog.registry import Catalog
from lonja.plans import review

MON, NEXT, BEFORE = "DATE '2001-06-04'", "DATE '2001-06-11'", "DATE '2001-05-28'"


def week(column: str) -> str:
    return f"{column} >= {MON} AND {column} < {NEXT}"


def register(c: Catalog) -> None:
    by_week = " UNION ALL ".join(f"""SELECT '{n}' AS week, COALESCE(SUM(net), 0) AS net, COUNT(DISTINCT ticket_id) AS tickets,
        {money_avg('SUM(net)', 'COUNT(DISTINCT ticket_id)')} AS avg_ticket
        FROM r_tickets WHERE {SALE} AND sale_date >= {a} AND sale_date < {b}""" for n, a, b in (("closed", MON, NEXT), ("before", BEFORE, MON)))
    c.add("e9_1_2_week_sales", "week s, net d, tickets l, avg_ticket d", lambda s: review.sales(s, WEEK), by_week)
    for name, worst, way in (("e9_3_best_stores", False, "DESC"), ("e9_4_worst_stores", True, "ASC")):
        c.add(name, "store s, net d, tickets l", lambda s, worst=worst: review.store_ranking(s, WEEK, worst=worst), f"""
            SELECT store, SUM(net) AS net, COUNT(DISTINCT ticket_id) AS tickets FROM r_tickets WHERE {SALE} AND {week('sale_date')}
            GROUP BY store ORDER BY net {way}, store LIMIT 3""")
    c.add("e9_5_top_items_by_units", "item_id l, ref s, description s, units d, net d", lambda s: review.top_items(s, WEEK), f"""
        WITH best AS (SELECT item_id, SUM(units) AS units, SUM(net) AS net FROM r_lines SEMI JOIN (FROM r_tickets WHERE {SALE}) USING (ticket_id)
            WHERE units > 0 AND {week('sale_date')} GROUP BY item_id ORDER BY 2 DESC, 1 LIMIT 5)
        SELECT item_id, IFNULL(ref, item_id::VARCHAR) AS ref, IFNULL(description, item_id::VARCHAR) AS description, units, net
        FROM best LEFT JOIN r_items USING (item_id)""")
    c.add("e9_6_return_rates", "sales d, returns d, sale_tickets l, return_tickets l, return_rate_pct d", lambda s: review.return_rates(s, WEEK), f"""
        WITH sides AS (SELECT is_sale, ABS(SUM(net)) AS amount, COUNT(*) AS n FROM r_tickets WHERE store <> '24' AND {week('sale_date')} GROUP BY is_sale),
        sums AS (SELECT COALESCE((SELECT amount FROM sides WHERE is_sale), 0) AS sales, COALESCE((SELECT amount FROM sides WHERE NOT is_sale), 0) AS returns,
            COALESCE((SELECT n FROM sides WHERE is_sale), 0) AS sale_tickets, COALESCE((SELECT n FROM sides WHERE NOT is_sale), 0) AS return_tickets)
        SELECT *, ROUND(CAST(return_tickets AS DOUBLE) / NULLIF(sale_tickets, 0) * 100, 2) AS return_rate_pct FROM sums""")
    c.add("e9_7_wholesale_net", "net d, invoices l", lambda s: review.wholesale_net(s, WEEK),
          f"SELECT COALESCE(SUM({NET_SAFE}), 0) AS net, COUNT(*) AS invoices FROM r_invoices WHERE NOT credit_note AND {week('invoice_date')}")
    c.add("e9_8_top_wholesale_customers", "customer_id l, customer s, net d, invoices l", lambda s: review.top_wholesale_customers(s, WEEK), f"""
        SELECT f.customer_id, COALESCE(c.name, CAST(f.customer_id AS VARCHAR)) AS customer, SUM({NET_SAFE}) AS net, COUNT(*) AS invoices
        FROM r_invoices f LEFT JOIN r_customers c ON c.customer_id = f.customer_id WHERE NOT credit_note AND {week('invoice_date')}
        GROUP BY 1, 2 ORDER BY net DESC, 1 LIMIT 3""")
    c.add("e9_9_uninvoiced_deliveries", "pending_deliveries l", lambda s: review.uninvoiced_deliveries(s, WEEK), f"""
        WITH sent AS (SELECT delivery_id, customer_id, sent_on FROM r_deliveries WHERE sent_on BETWEEN {MON} - 30 AND {NEXT} - 1),
        billed AS (SELECT delivery_id FROM sent JOIN r_invoices USING (customer_id) WHERE NOT credit_note AND invoice_date - sent_on BETWEEN 0 AND 29)
        SELECT COUNT(*) AS pending_deliveries FROM sent WHERE delivery_id NOT IN (FROM billed)""")
    c.add("e9_10_stock_totals", "store_refs l, store_units l, central_refs l, central_units l, total_units l", review.stock_totals, """
        WITH held AS (SELECT 'shop' AS place, item_id, qty FROM r_stock WHERE store <> '24' UNION ALL SELECT 'central', item_id, qty FROM r_central)
        SELECT COUNT(DISTINCT item_id) FILTER (place = 'shop') AS store_refs, SUM(qty) FILTER (place = 'shop') AS store_units,
            COUNT(*) FILTER (place = 'central') AS central_refs, SUM(qty) FILTER (place = 'central') AS central_units, SUM(qty) AS total_units
        FROM held WHERE qty > 0""")
    c.add("e9_11_critical_stock", "item_id l, qty l", lambda s: review.critical_stock(s, limit=300), """
        SELECT item_id, SUM(qty) AS qty FROM r_stock GROUP BY 1 HAVING SUM(qty) < 300 AND SUM(qty) > 0 ORDER BY qty, item_id LIMIT 20""")
    c.add("e9_12_transfers", "shipments l, units_sent d, arrivals l, units_received d", lambda s: review.transfers(s, WEEK), f"""
        SELECT (SELECT COUNT(*) FROM r_transfers WHERE NOT is_in AND {week('out_date')}) AS shipments,
            (SELECT COALESCE(SUM(units_out), 0) FROM r_transfers WHERE NOT is_in AND {week('out_date')}) AS units_sent,
            (SELECT COUNT(*) FROM r_transfers WHERE is_in AND {week('in_date')}) AS arrivals,
            (SELECT COALESCE(SUM(units_in), 0) FROM r_transfers WHERE is_in AND {week('in_date')}) AS units_received""")
    bought = " UNION ALL ".join(f"""SELECT '{n}' AS week, (SELECT COUNT(*) FROM r_po WHERE ordered_on >= {a} AND ordered_on < {b}) AS orders,
        COUNT(DISTINCT l.po_id) AS orders_with_lines, COUNT(*) AS lines, COALESCE(SUM(units), 0) AS units, COALESCE(SUM(net), 0) AS net
        FROM r_po_lines l JOIN r_po o ON o.po_id = l.po_id WHERE ordered_on >= {a} AND ordered_on < {b}"""
                                for n, a, b in (("closed", MON, NEXT), ("before", BEFORE, MON)))
    c.add("e9_13_14_purchases", "week s, orders l, orders_with_lines l, lines l, units d, net d", lambda s: review.purchases(s, WEEK), bought)
    c.add("e9_15_top_suppliers", "supplier_id l, supplier s, orders l, units d, net d", lambda s: review.top_suppliers(s, WEEK), f"""
        SELECT l.supplier_id, COALESCE(p.name, CAST(l.supplier_id AS VARCHAR)) AS supplier, COUNT(DISTINCT l.po_id) AS orders, SUM(units) AS units, SUM(net) AS net
        FROM r_po_lines l JOIN r_po o ON o.po_id = l.po_id LEFT JOIN r_suppliers p ON p.supplier_id = l.supplier_id WHERE {week('ordered_on')}
        GROUP BY 1, 2 ORDER BY net DESC NULLS LAST, 1 LIMIT 3""")
    c.add("e9_16_top_bought_items", "item_id l, ref s, description s, units d, net d", lambda s: review.top_bought_items(s, WEEK), f"""
        SELECT l.item_id, COALESCE(a.ref, CAST(l.item_id AS VARCHAR)) AS ref, COALESCE(a.description, '') AS description, SUM(units) AS units, SUM(net) AS net
        FROM r_po_lines l JOIN r_po o ON o.po_id = l.po_id LEFT JOIN r_items a ON a.item_id = l.item_id WHERE {week('ordered_on')}
        GROUP BY 1, 2, 3 ORDER BY units DESC NULLS LAST, 1 LIMIT 5""")
