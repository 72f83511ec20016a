"""Wholesale report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import labels as L
from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import Range, long_view, month_start
from lonja.operators.filters import NONE, Filters
from lonja.operators.ranking import top
from lonja.plans import base
from lonja.plans.general import wholesale_items, wholesale_lines
from lonja.sources.star import Star

FILTERS = ("catalog_family", "season", "brand")


def invoices_in(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    rows = star.invoices.where(P.is_invoice() & P.in_days("invoice_date", r.lo, r.hi))
    return filters.apply(rows, "wholesale_customer").withColumn("net", M.invoice_net())


def kpis(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Net, invoices, active customers and line margin.  A missing tax base does not drop an invoice."""
    heads = invoices_in(star, r, filters).agg(
        M.total("net").alias("net"), F.count("invoice_id").alias("invoices"),
        F.count_distinct("customer_id").alias("customers"))
    lines = wholesale_lines(star, r, filters).where("total > 0")
    sold = filters.apply(wholesale_items(star, lines), *FILTERS)
    return base.one_row(heads, sold.agg(M.margin_pct(F.sum("total"), F.sum("cost")).alias("margin_pct")))


def by_rep(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Net per sales rep; invoices without a rep are shown under one label."""
    sums = invoices_in(star, r, filters).groupBy("rep_id").agg(F.sum("net").alias("net"))
    labelled = sums.join(star.reps, "rep_id", "left").groupBy(L.first_label("rep", default=L.NO_REP).alias("label"))
    return labelled.agg(F.sum("net").alias("net")).withColumnRenamed("label", "rep").orderBy(F.desc("net"), "rep")


def top_customers(star: Star, r: Range, filters: Filters = NONE, k: int = 10) -> DataFrame:
    """Customers by net with margin and last purchase.

    Only the lines of invoices in the range are read into the margin.
    """
    heads = invoices_in(star, r, filters)
    sold = wholesale_items(star, wholesale_lines(star, r, filters), "customer_id").groupBy("customer_id").agg(
        F.sum("total").alias("income"), F.sum("cost").alias("cost"))
    sums = heads.groupBy("customer_id").agg(F.count("invoice_id").alias("invoices"), F.sum("net").alias("net"))
    out = (sums.join(sold, "customer_id", "left").join(star.customers, "customer_id")
           .select("customer_id", L.customer_label().alias("customer"), "invoices", "net",
                   M.margin_pct("income", "cost").alias("margin_pct"), "last_purchase"))
    return top(out, k, F.desc("net"), F.asc("customer_id"))


def backlog_aging(star: Star, as_of: dt.date, filters: Filters = NONE, k: int = 20) -> DataFrame:
    """Open orders by age, whatever the selected dates, with the share delivered."""
    rows = star.wholesale_orders.where("NOT closed AND NOT credit_note AND coalesce(pending, 0) > 0")
    out = filters.apply(rows, "wholesale_customer").join(star.customers, "customer_id").select(
        L.customer_label().alias("customer"), F.col("order_no").alias("order_id"), "ordered_on",
        F.datediff(F.lit(as_of), "ordered_on").alias("days"), "ordered", "delivered", "pending",
        M.fill_rate("delivered", "ordered").alias("fill_pct"), "season")
    return top(out, k, F.desc("days"), F.desc("pending"), F.asc("order_id"))


def recent_deliveries(star: Star, r: Range, filters: Filters = NONE, k: int = 20) -> DataFrame:
    rows = star.deliveries.where(P.is_invoice() & P.in_days("sent_on", r.lo, r.hi))
    out = filters.apply(rows, "wholesale_customer").join(star.customers, "customer_id").select(
        "delivery_id", "delivery_no", L.customer_label().alias("customer"), "sent_on", "units", M.invoice_net().alias("net"))
    return top(out, k, F.desc("sent_on"), F.desc("delivery_id"))


def top_products(star: Star, r: Range, filters: Filters = NONE, k: int = 10) -> DataFrame:
    lines = wholesale_lines(star, r, filters).where("units > 0")
    folded = lines.groupBy("item_id", F.col("description").alias("line_text")).agg(
        F.sum("units").alias("units"), F.sum("total").alias("total"), F.sum("cost").alias("cost"))
    sold = base.with_items(star, folded, filters, FILTERS, how="left")
    out = sold.groupBy(L.first_label("ref", F.col("item_id").cast("string"), default=L.DASH).alias("ref"),
                       L.first_label("description", "line_text", default=L.DASH).alias("description")).agg(
        F.sum("units").alias("units"), F.sum("total").alias("total"),
        M.margin_pct(F.sum("total"), F.sum("cost")).alias("margin_pct"))
    return top(out, k, F.desc("total"), F.asc("ref"), F.asc("description"))


def monthly(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Net by month over at least twelve months before the month of the range end."""
    return (invoices_in(star, long_view(r, 12), filters).groupBy(month_start("invoice_date").alias("month"))
            .agg(F.sum("net").alias("net")).orderBy("month"))
