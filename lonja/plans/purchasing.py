"""Purchasing report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import labels as L
from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import Range, month_start
from lonja.operators.filters import NONE, Filters
from lonja.operators.ranking import top
from lonja.plans import base
from lonja.sources.star import Star


def ordered_in(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    return filters.apply(star.purchase_orders.where(P.in_days("ordered_on", r.lo, r.hi)), "purchase_supplier")


def received_in(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    rows = star.purchase_orders.where("ordered_on IS NOT NULL").where(P.in_days("received_on", r.lo, r.hi))
    return filters.apply(rows, "purchase_supplier")


def lead_days():
    return F.datediff("received_on", "ordered_on")


def _supplier_name():
    return F.coalesce(L.blank_to_null("name", trim=False), F.col("supplier_id").cast("string"))


def kpis(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Orders, suppliers, open orders, mean lead time of what arrived, and units ordered."""
    placed, arrived = P.in_days("ordered_on", r.lo, r.hi), P.in_days("received_on", r.lo, r.hi)
    rows = filters.apply(star.purchase_orders.where(placed | (arrived & F.col("ordered_on").isNotNull())), "purchase_supplier")
    heads = rows.agg(F.count_if(placed).alias("orders"), F.count_distinct(F.when(placed, F.col("supplier_id"))).alias("suppliers"),
                     F.count_if(placed & F.col("received_on").isNull()).alias("open_orders"),
                     F.coalesce(F.round(F.avg(F.when(arrived, lead_days())), 1), F.lit(0.0)).alias("lead_days"))
    units = (star.purchase_lines.join(ordered_in(star, r, filters).select("po_id"), "po_id", "left_semi")
             .agg(M.total("units").alias("units")))
    return base.one_row(heads, units)


def by_supplier(star: Star, r: Range, filters: Filters = NONE, k: int = 10) -> DataFrame:
    counts = ordered_in(star, r, filters).groupBy("supplier_id").agg(F.count("po_id").alias("orders"))
    out = counts.join(star.suppliers, "supplier_id").select("supplier_id", _supplier_name().alias("supplier"), "orders")
    return top(out, k, F.desc("orders"), F.asc("supplier_id"))


def lead_time_by_supplier(star: Star, r: Range, filters: Filters = NONE, k: int = 20) -> DataFrame:
    times = received_in(star, r, filters).groupBy("supplier_id").agg(
        F.count(F.lit(1)).alias("received"), F.round(F.avg(lead_days()), 1).alias("lead_days"))
    out = times.join(star.suppliers, "supplier_id").select(
        "supplier_id", _supplier_name().alias("supplier"), "received", "lead_days")
    return top(out, k, F.desc_nulls_last("lead_days"), F.asc("supplier_id"))


def _with_line_counts(star: Star, chosen: DataFrame) -> DataFrame:
    """Line counts of a few chosen orders, which are few enough to be sent to the lines, so that these do not move."""
    counts = (star.purchase_lines.join(chosen.select("po_id"), "po_id", "left_semi")
              .groupBy("po_id").agg(F.count("po_line_id").alias("lines")))
    return chosen.join(counts, "po_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))


def latest_orders(star: Star, r: Range, filters: Filters = NONE, k: int = 20) -> DataFrame:
    """The newest orders with supplier and line count; orders without a known supplier drop out."""
    rows = ordered_in(star, r, filters).join(star.suppliers, "supplier_id")
    chosen = top(rows, k, F.desc("ordered_on"), F.desc("po_id"))
    return _with_line_counts(star, chosen).select(
        "po_id", _supplier_name().alias("supplier"), "lines", "ordered_on", "received_on").orderBy(
        F.desc("ordered_on"), F.desc("po_id"))


def open_order_aging(star: Star, r: Range, filters: Filters = NONE, k: int = 20) -> DataFrame:
    """Oldest unreceived orders of the range, aged to its end."""
    rows = ordered_in(star, r, filters).where("received_on IS NULL").join(star.suppliers, "supplier_id")
    chosen = top(rows, k, F.asc("ordered_on"), F.asc("po_id"))
    return _with_line_counts(star, chosen).select(
        "po_id", _supplier_name().alias("supplier"), "ordered_on",
        F.datediff(F.lit(r.hi), "ordered_on").alias("days_open"), "lines").orderBy("ordered_on", "po_id")


def recent_receipts(star: Star, r: Range, k: int = 20) -> DataFrame:
    name = F.coalesce(L.blank_to_null("supplier_name", trim=False), F.col("supplier_id").cast("string"), F.lit(L.DASH))
    out = star.receipts.where(P.in_days("received_on", r.lo, r.hi)).select(
        "receipt_id", name.alias("supplier"), "po_id", "received_on")
    return top(out, k, F.desc("received_on"), F.desc("receipt_id"))


def monthly_trend(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    return (ordered_in(star, r, filters).groupBy(month_start("ordered_on").alias("month"))
            .agg(F.count("po_id").alias("orders")).orderBy("month"))
