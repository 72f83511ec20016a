"""Home panel: freshness, period comparisons and alerts for one day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import DAY, Range, add_months, constants, end_of, start_of
from lonja.operators.ranking import top
from lonja.plans import base, general
from lonja.sources.star import Star

DOMAINS = {
    "sales": ("ventas", "lineas_ventas"),
    "stock": ("stock",),
    "purchasing": ("compras", "lineas_compras", "facturas_compra"),
    "wholesale": ("gc_facturas", "gc_lin_facturas", "gc_pedidos"),
}


def hours_since_sync(watermarks: DataFrame, now: dt.datetime, domains: dict[str, tuple[str, ...]] = DOMAINS) -> DataFrame:
    """Hours since the newest sync of each domain; NULL for a domain never synced."""
    pairs = [(d, f) for d, feeds in domains.items() for f in feeds]
    members = constants(watermarks.sparkSession, pairs, "domain string, feed string")
    newest = members.join(watermarks, "feed", "left").groupBy("domain").agg(F.max("last_sync_at").alias("last"))
    seconds = F.unix_micros(F.lit(now).cast("timestamp")) / 1e6 - F.unix_micros(F.col("last").cast("timestamp")) / 1e6
    return newest.select("domain", F.round(seconds / 3600.0, 1).alias("hours"))


def whole(day: dt.date, unit: str) -> Range:
    return Range(start_of(day, unit), end_of(day, unit))


def period_sales(star: Star, as_of: dt.date) -> DataFrame:
    """Today, week and month against the previous one and last year's.

    Weeks and months are whole calendar periods on every side; last year's week is the one
    that holds the same date.  All nine sums come from one pass.
    """
    ly = add_months(as_of, -12)
    windows = {}
    for unit in ("day", "week", "month"):
        current = whole(as_of, unit)
        windows[unit] = current
        windows[f"{unit}_before"] = whole(current.lo - DAY, unit)
        windows[f"{unit}_last_year"] = whole(ly, unit)
    sums = [M.sum_if(P.in_days("sale_date", w.lo, w.hi), "net").alias(n) for n, w in windows.items()]
    lo, hi = min(w.lo for w in windows.values()), max(w.hi for w in windows.values())
    return base.retail_tickets(star, Range(lo, hi)).agg(*sums)


def operating_kpis(star: Star, as_of: dt.date) -> DataFrame:
    """Today's tickets, average ticket and return rate, and the month's margin."""
    today = base.retail_tickets(star, Range(as_of, as_of), returns=None)
    sale = F.col("is_sale")
    heads = today.agg(F.count_if(sale).alias("tickets"), M.sum_if(sale, "net").alias("net"),
                      M.sum_if(~sale, F.abs("net")).alias("returns"))
    month = whole(as_of, "month")
    margin = base.item_sales(star, month).agg(M.margin_pct(F.sum("net"), F.sum("cost")).alias("month_margin_pct"))
    return base.one_row(heads, margin).select(
        "tickets", M.average_ticket("net", "tickets").alias("avg_ticket"), "month_margin_pct",
        M.return_rate_of_sales("net", "returns").alias("returns_pct"))


def daily_series(star: Star, as_of: dt.date, days: int = 30) -> DataFrame:
    rows = base.retail_tickets(star, None).where(F.col("sale_date") >= F.lit(as_of - DAY * days))
    return rows.groupBy("sale_date").agg(F.sum("net").alias("net")).orderBy("sale_date")


def top_stores(star: Star, as_of: dt.date, k: int = 10) -> DataFrame:
    month = whole(as_of, "month")
    out = base.retail_tickets(star, month).groupBy("store").agg(M.total("net").alias("net"))
    return top(out, k, F.desc("net"), F.asc("store"))


def operations(star: Star, as_of: dt.date) -> DataFrame:
    """Wholesale net of the month, open orders on both sides, stock value."""
    month = whole(as_of, "month")
    billed = star.invoices.where(P.is_invoice() & P.in_days("invoice_date", month.lo, month.hi)).agg(
        M.total(M.invoice_net()).alias("wholesale_net"))
    backlog = general.open_wholesale_orders(star).agg(F.count("order_id").alias("open_wholesale"))
    purchases = star.purchase_orders.where("received_on IS NULL").agg(F.count(F.lit(1)).alias("open_purchases"))
    value = general.stock_worth(star).select("stock_value")
    return base.one_row(billed, backlog, purchases, value)


def silent_stores(star: Star, as_of: dt.date) -> DataFrame:
    """Stores without a sale on the day."""
    sold = star.tickets.where(F.col("is_sale") & (F.col("sale_date") == F.lit(as_of))).select("store").distinct()
    return (star.stores.where(P.in_real_store(star.ghost_store)).join(sold, "store", "left_anti")
            .select("store", "updated_on").orderBy("store"))


