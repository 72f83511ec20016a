"""Retail sales report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import Range, year_before
from lonja.operators.filters import NONE, Filters
from lonja.operators.ranking import top
from lonja.plans import base
from lonja.sources.star import Star


def kpis(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """All sales KPIs: one pass over the tickets and one over the lines.

    The ticket id is the key of the ticket table, so counting tickets needs no distinct.
    """
    ly = year_before(r)
    now, before, sale = P.in_days("sale_date", r.lo, r.hi), P.in_days("sale_date", ly.lo, ly.hi), F.col("is_sale")
    rows = base.retail_tickets(star, None, filters, returns=None).where(now | before)
    heads = rows.agg(
        M.sum_if(sale & now, "net").alias("net"), F.count_if(sale & now).alias("tickets"),
        F.abs(M.sum_if(~sale & now, "net")).alias("returns"), M.sum_if(sale & before, "net").alias("net_ly"))
    basket = units_per_ticket(star, r, filters)
    return base.one_row(heads, basket).select(
        "net", "tickets", M.average_ticket("net", "tickets").alias("avg_ticket"), "units_per_ticket", "returns",
        M.return_rate_of_flow("net", "returns").alias("return_pct"), M.change_pct("net", "net_ly").alias("yoy_pct"))


def units_per_ticket(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Units over tickets that have at least one line in the range."""
    lines = base.retail_lines(star, base.line_window(r), filters, positive=False)
    baskets = lines.groupBy("ticket_id").agg(F.sum("units").alias("units"))
    return baskets.agg(F.coalesce(F.round(M.ratio(F.sum("units"), F.count("ticket_id")), 2), F.lit(0.0)).alias("units_per_ticket"))


def by_store(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    return (base.retail_tickets(star, r, filters).groupBy("store")
            .agg(F.sum("net").alias("net"), F.count("ticket_id").alias("tickets"))
            .orderBy(F.desc("net"), "store"))


def daily_trend(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    return base.retail_tickets(star, r, filters).groupBy("sale_date").agg(F.sum("net").alias("net")).orderBy("sale_date")


def payment_mix(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Collected amount by method; both the payment and its ticket must be sales."""
    paid = star.payments.where(F.col("is_collection") & P.in_real_store(star.ghost_store) & P.in_days("paid_on", r.lo, r.hi))
    heads = filters.apply(star.tickets.where("is_sale"), "store").select("ticket_id")
    return (paid.join(heads, "ticket_id", "left_semi").groupBy("method").agg(F.sum("amount").alias("amount"))
            .orderBy(F.desc("amount"), "method"))


def margin_by_store(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    sales = base.item_sales(star, r, filters, by=("store",), family=True)
    return base.by_group(sales, "store").orderBy(F.desc_nulls_last("margin_pct"), "store")


def top_items(star: Star, r: Range, filters: Filters = NONE, k: int = 10) -> DataFrame:
    sales = base.item_sales(star, r, filters, family=True)
    return top(base.by_group(sales, "ref", "description"), k, F.desc("net"), F.asc("ref"))
