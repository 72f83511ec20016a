"""Further analyses."""

import datetime as dt

from pyspark.sql import functions as F

from lonja.catalog.general import SALE
from lonja.catalog.params import AS_OF, HI, IN30, LAST_30, LY30, YTD, money_avg
from lonja.catalog.questions import YEAR
from lonja.catalog.registry import Catalog
from lonja.functions.periods import year_before
from lonja.operators import history
from lonja.plans import analyses as a
from lonja.plans import questions as q
from lonja.session import written
from lonja.sources.tpch import intraday_star

MOVES = f"""moves AS (
    SELECT l.item_id, v.store, CASE WHEN v.is_sale THEN -l.units ELSE l.units END AS u FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id WHERE l.sale_date {IN30}
    UNION ALL SELECT item_id, to_store, units_in FROM r_transfers WHERE is_in AND in_date {IN30}
    UNION ALL SELECT item_id, from_store, -units_out FROM r_transfers WHERE NOT is_in AND out_date {IN30}
    UNION ALL SELECT item_id, '24', units FROM r_po_lines l JOIN r_po o ON o.po_id = l.po_id WHERE received_on {IN30}
    UNION ALL SELECT item_id, '24', CASE WHEN credit_note THEN units ELSE -units END FROM r_invoice_lines l JOIN r_invoices f ON f.invoice_id = l.invoice_id WHERE invoice_date {IN30})"""
EARLIER, LATER, AFTER = dt.date(2001, 6, 8), dt.date(2001, 6, 15), dt.date(2001, 6, 16)


def _counts(s):
    """Opening stock of the check, the positive cells per store, beside all cells."""
    return s.stock.groupBy("item_id", "store").agg(F.sum(F.when(F.col("qty") > 0, F.col("qty"))).alias("initial"), F.sum("qty").alias("actual"))


def _snapshots(s):
    """Two days of snapshots: today's, and a week earlier without the cells of size 1."""
    early = a.stock_snapshot(s, EARLIER).where("size <> '1'").withColumn("qty", (F.col("qty") / 2).cast("int"))
    return early.unionByName(a.stock_snapshot(s, LATER))


def _wide_lines(s):
    """Order lines in matrix form: sizes 1 to 7 as slots with ordered and delivered units."""
    line = s.raw("lineitem")
    out = []
    for i in range(1, 8):
        hit = F.col("l_linenumber") == i
        out += [F.max(F.when(hit, F.lit(f" {i} "))).alias(f"size{i}"), F.sum(F.when(hit, F.col("l_quantity").cast("int"))).alias(f"ordered{i}"),
                F.sum(F.when(hit & (F.col("l_linestatus") == "F"), F.col("l_quantity").cast("int"))).alias(f"sent{i}")]
    return line.groupBy("l_orderkey").agg(*out)


def _metrics(s):
    parts = [q.total_sales(s, YTD).select(F.lit("net_sales").alias("metric"), F.col("net").cast("double").alias("value")),
             q.average_ticket(s, YTD).select(F.lit("average_ticket").alias("metric"), F.col("avg_ticket").alias("value")),
             q.stock_value(s).select(F.inline(F.array(F.struct(F.lit("stock_value").alias("metric"), F.col("value").cast("double").alias("value")),
                                                      F.struct(F.lit("stock_units").alias("metric"), F.col("units").cast("double").alias("value")),
                                                      F.struct(F.lit("stock_refs").alias("metric"), F.col("refs").cast("double").alias("value")))))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _history(s):
    """Three snapshots as intervals: a week ago, today, and a day later without every third item and with one more of each seventh."""
    cells = written(s.stock.where("qty <> 0").select("item_id", "store", "size", "qty"), "cells")
    first = cells.where("size <> '1'").withColumn("qty", (F.col("qty") / 2).cast("int"))
    last = cells.where("item_id % 3 <> 0").withColumn("qty", F.col("qty") + F.when(F.col("item_id") % 7 == 0, 1).otherwise(0))
    ended, lasting = [], history.first_intervals(first, EARLIER)
    for snapshot, day in ((cells, LATER), (last, AFTER)):
        rows = written(history.changed_intervals(lasting, snapshot, day, ["item_id", "store", "size"]), "intervals")
        ended.append(rows.where("valid_to IS NOT NULL"))
        lasting = rows.where("valid_to IS NULL")
    return lasting.unionByName(ended[0]).unionByName(ended[1])


def _days_read_back(s):
    rows = _history(s)
    parts = [history.as_of(rows, day).withColumn("day", F.lit(day)) for day in (EARLIER, LATER, AFTER)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def register(c: Catalog) -> None:
    c.add("e11_1_net_movement", "store s, entries d, exits d, net d", lambda s: a.net_movement(a.movements(s, LAST_30, "24"), "store"), f"""
        WITH {MOVES} SELECT store, COALESCE(SUM(u) FILTER (WHERE u > 0), 0) AS entries, COALESCE(-SUM(u) FILTER (WHERE u < 0), 0) AS exits, SUM(u) AS net FROM moves GROUP BY 1""")
    c.add("e11_1_shrinkage", "item_id l, store s, expected d, actual d, difference d",
          lambda s: a.shrinkage(_counts(s), a.movements(s, LAST_30, "24")), f"""
        WITH {MOVES}, cells AS (SELECT item_id, store, qty AS e, 0 AS a FROM r_stock WHERE qty > 0 UNION ALL SELECT item_id, store, u, 0 FROM moves
            UNION ALL SELECT item_id, store, 0, qty FROM r_stock)
        SELECT item_id, store, SUM(e) AS expected, SUM(a) AS actual, SUM(a) - SUM(e) AS difference FROM cells GROUP BY 1, 2""")
    c.add("e11_2_lost_sales", "item_id l, ref s, units d, per_day d", lambda s: a.lost_sales(s, AS_OF), f"""
        WITH sold AS (SELECT l.item_id, SUM(units) AS units FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id
            WHERE v.{SALE} AND l.sale_date BETWEEN {HI} - 30 AND {HI} GROUP BY 1 HAVING SUM(units) > 0)
        SELECT sold.item_id, ref, units, ROUND(CAST(units AS DOUBLE) / 30.0, 2) AS per_day FROM sold JOIN r_items p ON p.item_id = sold.item_id
        LEFT JOIN r_central k ON k.item_id = sold.item_id AND k.qty > 0 WHERE k.item_id IS NULL ORDER BY units DESC, 1 LIMIT 30""")
    c.add("e11_3_below_minimum", "item_id l, ref s, qty l, minimum l, deficit l",
          lambda s: a.below_minimum(s, s.raw("part").select(F.col("p_partkey").alias("item_id"), (F.col("p_size") * 30).alias("minimum"))), """
        SELECT p.item_id, ref, COALESCE(SUM(qty), 0) AS qty, p_size * 30 AS minimum, p_size * 30 - COALESCE(SUM(qty), 0) AS deficit
        FROM r_items p JOIN part ON p_partkey = p.item_id LEFT JOIN r_stock s ON s.item_id = p.item_id WHERE active AND p_size * 30 > 0
        GROUP BY 1, 2, p_size HAVING COALESCE(SUM(qty), 0) < p_size * 30 ORDER BY deficit DESC, 1 LIMIT 50""")
    c.add("e11_4_turnover", "item_id l, units d, qty l, turnover d", lambda s: a.turnover(s, YTD), f"""
        WITH sold AS (SELECT l.item_id, SUM(units) AS units FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id WHERE v.{SALE} AND l.sale_date {YEAR} GROUP BY 1),
        held AS (SELECT item_id, SUM(qty) AS qty FROM r_stock GROUP BY 1)
        SELECT sold.item_id, units, COALESCE(qty, 0) AS qty, ROUND(CAST(units AS DOUBLE) / NULLIF(CAST(qty AS DOUBLE), 0), 4) AS turnover
        FROM sold LEFT JOIN held ON held.item_id = sold.item_id WHERE units > 0 ORDER BY units DESC, 1 LIMIT 50""")
    c.add("e11_5_snapshot_change", "item_id l, store s, size s, before l, after l, change l",
          lambda s: a.snapshot_change(_snapshots(s), EARLIER, LATER), """
        SELECT item_id, store, size, CASE WHEN size <> '1' THEN CAST(trunc(qty / 2.0) AS INTEGER) ELSE 0 END AS before, qty AS after,
            qty - CASE WHEN size <> '1' THEN CAST(trunc(qty / 2.0) AS INTEGER) ELSE 0 END AS change FROM r_stock WHERE qty <> 0""")
    c.add("e11_5_history_as_of", "day date, item_id l, store s, size s, qty l", _days_read_back, """
        WITH cells AS (SELECT item_id, store, size, qty FROM r_stock WHERE qty <> 0)
        SELECT DATE '2001-06-08' AS day, item_id, store, size, CAST(trunc(qty / 2.0) AS INTEGER) AS qty FROM cells WHERE size <> '1'
        UNION ALL SELECT DATE '2001-06-15', * FROM cells
        UNION ALL SELECT DATE '2001-06-16', item_id, store, size, qty + CASE WHEN item_id % 7 = 0 THEN 1 ELSE 0 END FROM cells WHERE item_id % 3 <> 0""")
    c.add("e11_6_unpaid_invoices", "invoice_id l, customer_id l, total d, collected d, pending d", lambda s: a.unpaid_invoices(s, YTD), f"""
        SELECT f.invoice_id, customer_id, total, COALESCE(SUM(amount), 0) AS collected, total - COALESCE(SUM(amount), 0) AS pending
        FROM r_invoices f LEFT JOIN r_collections k ON k.invoice_id = f.invoice_id WHERE invoice_date {YEAR} GROUP BY 1, 2, 3
        HAVING total - COALESCE(SUM(amount), 0) > 0 ORDER BY pending DESC, 1 LIMIT 20""")
    c.add("e11_7_low_catalog_margin", "item_id l, ref s, list_price d, unit_cost d, margin_pct d, net_margin_pct d", lambda s: a.low_catalog_margin(s), """
        SELECT * FROM (SELECT item_id, ref, list_price, unit_cost,
            ROUND((CAST(list_price AS DOUBLE) - CAST(unit_cost AS DOUBLE)) / CAST(list_price AS DOUBLE) * 100, 1) AS margin_pct,
            ROUND((CAST(list_price AS DOUBLE) / (1 + CAST(vat_rate AS DOUBLE) / 100) - CAST(unit_cost AS DOUBLE)) / (CAST(list_price AS DOUBLE) / (1 + CAST(vat_rate AS DOUBLE) / 100)) * 100, 1) AS net_margin_pct
            FROM r_items WHERE active AND list_price > 0 AND unit_cost > 0) WHERE net_margin_pct < 30 ORDER BY net_margin_pct, item_id LIMIT 50""")
    c.add("e11_8_sales_by_hour", "hour l, tickets l, net d", lambda s: a.by_hour(intraday_star(s)),
          f"SELECT hour, COUNT(*) AS tickets, SUM(net) AS net FROM r_timed WHERE {SALE} GROUP BY 1")
    c.add("e11_9_customer_visits", "customer_id l, visits l, first_visit date, last_visit date, net d", lambda s: a.customer_visits(s, YTD), f"""
        SELECT customer_id, COUNT(*) AS visits, MIN(sale_date) AS first_visit, MAX(sale_date) AS last_visit, SUM(net) AS net FROM r_tickets
        WHERE customer_id > 0 AND is_sale AND sale_date {YEAR} GROUP BY 1 HAVING COUNT(*) > 1 ORDER BY visits DESC, 1 LIMIT 50""")
    c.add("e11_10_customer_concentration", "members l, top_members l, top_total d, total d, share_pct d", lambda s: a.customer_concentration(s, YTD), f"""
        WITH spent AS (SELECT customer_id, SUM(net) AS net FROM r_tickets WHERE customer_id > 0 AND is_sale AND sale_date {YEAR} GROUP BY 1),
        tiles AS (SELECT *, ntile(10) OVER (ORDER BY net DESC, customer_id) AS t FROM spent)
        SELECT COUNT(*) AS members, COUNT(*) FILTER (WHERE t = 1) AS top_members, SUM(net) FILTER (WHERE t = 1) AS top_total, SUM(net) AS total,
            ROUND(CAST(SUM(net) FILTER (WHERE t = 1) AS DOUBLE) / CAST(SUM(net) AS DOUBLE) * 100, 1) AS share_pct FROM tiles""")
    c.add("e11_11_weekly_trend", "week date, net d, tickets l, units d", lambda s: a.weekly_trend(s, AS_OF), f"""
        SELECT w AS week, COALESCE(SUM(net), 0) AS net, COUNT(ticket_id) AS tickets, (SELECT COALESCE(SUM(l.units), 0) FROM r_lines l
            JOIN r_tickets v ON v.ticket_id = l.ticket_id WHERE v.{SALE} AND l.sale_date >= w AND l.sale_date < w + 7) AS units FROM (SELECT CAST(unnest(generate_series(DATE '2001-03-26', DATE '2001-06-11', INTERVAL 7 DAY)) AS DATE) AS w)
        LEFT JOIN r_tickets ON {SALE} AND sale_date >= w AND sale_date < w + 7 GROUP BY 1""")
    line_sales = f"FROM r_lines l JOIN r_tickets v ON v.ticket_id = l.ticket_id WHERE v.{SALE} AND l.sale_date {IN30}"
    c.add("e11_12_sales_by_size", "line_no l, units d, net d, lines l", lambda s: a.sold_by_line(s, LAST_30, "line_no"),
          f"SELECT line_no, SUM(units) AS units, SUM(l.net) AS net, COUNT(*) AS lines {line_sales} GROUP BY 1")
    c.add("e11_12_sales_by_discount", "discount d, units d, net d, lines l", lambda s: a.sold_by_line(s, LAST_30, "discount"),
          f"SELECT discount, SUM(units) AS units, SUM(l.net) AS net, COUNT(*) AS lines {line_sales} GROUP BY 1")
    c.add("e11_12_discount_summary", "avg_discount_pct d, net d, units d", lambda s: a.discount_summary(s, LAST_30),
          f"SELECT ROUND(CAST(SUM(discount) AS DOUBLE) / COUNT(discount) * 100, 4) AS avg_discount_pct, SUM(l.net) AS net, SUM(units) AS units {line_sales}")
    c.add("e11_13_growth_bands", "store s, now d, before d, yoy_pct d, band s",
          lambda s: a.growth_bands(s, LAST_30, year_before(LAST_30)), f"""
        WITH n AS (SELECT store, SUM(net) AS now FROM r_tickets WHERE {SALE} AND sale_date {IN30} GROUP BY 1), b AS (SELECT store, SUM(net) AS before FROM r_tickets WHERE {SALE} AND sale_date {LY30} GROUP BY 1),
        j AS (SELECT n.store, now, before, ROUND(CAST(now - before AS DOUBLE) / NULLIF(ABS(CAST(before AS DOUBLE)), 0) * 100, 1) AS yoy_pct FROM n LEFT JOIN b ON b.store = n.store)
        SELECT *, CASE WHEN yoy_pct > 10 THEN 'strong growth' WHEN yoy_pct >= 0 THEN 'growth' WHEN yoy_pct >= -10 THEN 'decline' WHEN yoy_pct < -10 THEN 'strong decline' END AS band FROM j""")
    c.add("e11_14_voucher_redemptions", "store s, month l, vouchers l, amount d", lambda s: a.voucher_redemptions(
        s.payments.where(F.col("method_code") == "5").select("store", F.col("paid_on").alias("redeemed_on"), "amount")), """
        SELECT store, year(paid_on) * 100 + month(paid_on) AS month, COUNT(*) AS vouchers, SUM(amount) AS amount FROM r_payments WHERE method_code = '5' GROUP BY 1, 2""")
    c.add("e11_14_transfers_by_type", "kind s, transfers l, units d", lambda s: a.transfers_by_type(s, YTD),
          f"SELECT kind, COUNT(*) AS transfers, SUM(units_in) AS units FROM r_transfers WHERE is_in AND in_date {YEAR} GROUP BY 1")
    c.add("e11_15_sizes_shipped", "size s, ordered l, sent l", lambda s: a.sizes_shipped(_wide_lines(s), {"ordered": "ordered", "sent": "sent"}, n=7), """
        SELECT CAST(l_linenumber AS VARCHAR) AS size, SUM(l_quantity) AS ordered, SUM(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END) AS sent FROM lineitem GROUP BY 1""")
    c.add("e11_16_magnitude_check", "metric s, value d, low d, high d, flag s", lambda s: a.magnitude_check(_metrics(s), ("store",)), f"""
        WITH v AS (SELECT 'net_sales' AS metric, CAST(SUM(net) AS DOUBLE) AS value, 200000.0 / 50 AS low, 3000000.0 / 50 AS high FROM r_tickets WHERE is_sale AND sale_date {YEAR}
            UNION ALL SELECT 'average_ticket', {money_avg('SUM(net)', 'COUNT(*)')}, 30, 250 FROM r_tickets WHERE {SALE} AND sale_date {YEAR}
            UNION ALL SELECT 'stock_units', CAST(SUM(qty) AS DOUBLE), 20000.0 / 50, 400000.0 / 50 FROM r_stock s JOIN r_items p ON s.item_id = p.item_id WHERE qty > 0 AND active
            UNION ALL SELECT 'stock_refs', CAST(COUNT(DISTINCT s.item_id) AS DOUBLE), NULL, NULL FROM r_stock s JOIN r_items p ON s.item_id = p.item_id WHERE qty > 0 AND active
            UNION ALL SELECT 'stock_value', CAST(SUM(qty * unit_cost) AS DOUBLE), 500000.0 / 50, 15000000.0 / 50 FROM r_stock s JOIN r_items p ON s.item_id = p.item_id WHERE qty > 0 AND active)
        SELECT *, CASE WHEN value = 0 THEN 'zero' WHEN value > high * 10 THEN 'too high' ELSE 'plausible' END AS flag FROM v""")
    c.add("c19_customers_in_both_channels", "customer_id l, name s", lambda s: a.customers_in_both(
        s.customers, s.payments_of("1"), s.payments_of("5")).select("customer_id", "name"), """
        SELECT customer_id, name FROM r_customers WHERE customer_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' AND o_custkey > 0)
        AND customer_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%')""")


