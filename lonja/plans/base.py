"""Shared steps of the reports.

Shape of every line-level report: filter lines at the scan, join the ticket header once, fold to
item grain (partial aggregation absorbs hot items), and only then join the item dimension.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import Range
from lonja.operators.filters import NONE, Filters
from lonja.sources.star import Star

ITEM_FILTERS = ("family", "season", "brand", "sex", "department")
CATALOG_FILTERS = ("catalog_family", "season", "brand")


def retail_tickets(star: Star, r: Range | None, filters: Filters = NONE, returns: bool | None = False) -> DataFrame:
    """Tickets of real stores in a closed range: sales, returns (True) or both (None)."""
    rows = star.tickets.where(P.in_real_store(star.ghost_store))
    if returns is not None:
        rows = rows.where(~F.col("is_sale") if returns else F.col("is_sale"))
    if r is not None:
        rows = rows.where(P.in_days("sale_date", r.lo, r.hi))
    return filters.apply(rows, "store")


def retail_lines(star: Star, window: Column | None, filters: Filters = NONE, positive: bool = True,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Lines of sale tickets in real stores, with their store.

    The window applies to the line date, so it reaches the line scan.  So does the store where lines carry one; else
    the store is that of the ticket.
    """
    own_store = "store" in star.lines.columns
    lines = star.lines.select("ticket_id", "item_id", "sale_date", "units", "net", "cost", *["store"] * own_store, *keep)
    if window is not None:
        lines = lines.where(window)
    if positive:
        lines = lines.where("net > 0")
    if own_store:
        lines = filters.apply(lines.where(P.in_real_store(star.ghost_store)), "store")
        return lines.join(star.tickets.where("is_sale").select("ticket_id"), "ticket_id")
    heads = filters.apply(star.tickets.where(P.is_retail_sale(star.ghost_store)), "store").select("ticket_id", "store")
    return lines.join(heads, "ticket_id")


def line_window(r: Range) -> Column:
    return P.in_days("sale_date", r.lo, r.hi)


def fold_to_items(lines: DataFrame, *by: str) -> DataFrame:
    """Units, net and known cost per item (and further columns)."""
    return lines.groupBy("item_id", *by).agg(F.sum("units").alias("units"), F.sum("net").alias("net"),
                                             F.sum("cost").alias("cost"))


def with_items(star: Star, folded: DataFrame, filters: Filters = NONE, filter_ids: Sequence[str] = ITEM_FILTERS,
               how: str = "inner", family: bool = False) -> DataFrame:
    """Join item attributes to item-grain sums; cost falls back to units at the item's unit cost.

    ``family=True`` keeps only items whose family resolves.
    """
    items = star.items.where("family_id IS NOT NULL") if family else star.items
    if how == "inner":
        joined = folded.join(filters.apply(items, *filter_ids), "item_id")
    else:
        joined = filters.apply(folded.join(items, "item_id", "left"), *filter_ids)
    return joined.withColumn("cost", F.coalesce(F.col("cost"), F.col("units") * F.col("unit_cost")))


def item_sales(star: Star, r: Range | None, filters: Filters = NONE, by: Sequence[str] = (), positive: bool = True,
               family: bool = False) -> DataFrame:
    """Sales per item (and ``by``) with item attributes, over lines with a positive amount by default."""
    lines = retail_lines(star, None if r is None else line_window(r), filters, positive)
    return with_items(star, fold_to_items(lines, *by), filters, family=family)


def by_group(sales: DataFrame, *keys: Column | str) -> DataFrame:
    """Net, units, cost and margin per group of item-grain sales."""
    return (sales.groupBy(*keys).agg(F.sum("net").alias("net"), F.sum("units").alias("units"), F.sum("cost").alias("cost"))
            .withColumn("margin_pct", M.margin_pct("net", "cost")))


def stock_rows(star: Star, filters: Filters = NONE, positive: bool = True) -> DataFrame:
    rows = star.stock.where(P.in_real_store(star.ghost_store))
    return filters.apply(rows.where(P.has_stock()) if positive else rows, "stock_store")


def active_items(star: Star, filters: Filters = NONE, filter_ids: Sequence[str] = CATALOG_FILTERS) -> DataFrame:
    return filters.apply(star.items.where("active"), *filter_ids)


def trailing(as_of: dt.date, days: int, include_today: bool) -> Column:
    """Lines of the last ``days`` days; with today the window is one day longer."""
    start = as_of - dt.timedelta(days=days)
    return P.in_days("sale_date", start, as_of) if include_today else P.in_days_until("sale_date", start, as_of)


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row frames side by side."""
    out = frames[0]
    for other in frames[1:]:
        out = out.crossJoin(F.broadcast(other))
    return out
