"""Executive report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import Range, comparison, long_view, month_start, year_before
from lonja.operators.filters import NONE, Filters
from lonja.operators.ranking import share_of_total, top
from lonja.plans import base
from lonja.sources.star import Star


def _in(r: Range, column: str = "sale_date"):
    return P.in_days(column, r.lo, r.hi)


def _either(column: str, *ranges: Range):
    out = _in(ranges[0], column)
    for r in ranges[1:]:
        out = out | _in(r, column)
    return out


def retail_kpis(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Net sales, last year's net sales, growth and return rate in one pass over the tickets."""
    ly = year_before(r)
    rows = base.retail_tickets(star, None, filters, returns=None).where(_either("sale_date", r, ly))
    now, before, sale = _in(r), _in(ly), F.col("is_sale")
    sums = rows.agg(M.sum_if(sale & now, "net").alias("net"), M.sum_if(sale & before, "net").alias("net_ly"),
                    M.sum_if(~sale & now, F.abs("net")).alias("returns"))
    return sums.select("*", M.change_pct("net", "net_ly").alias("yoy_pct"),
                       M.return_rate_of_sales("net", "returns").alias("returns_pct"))


def retail_margin(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    sales = base.item_sales(star, r, filters, family=True)
    return sales.agg(M.margin_pct(F.sum("net"), F.sum("cost")).alias("margin_pct"))


def wholesale_kpis(star: Star, r: Range, strict: bool = False) -> DataFrame:
    """Invoiced net and growth; ``strict`` leaves out invoices with a missing base."""
    ly = year_before(r)
    net = M.invoice_net_strict() if strict else M.invoice_net()
    rows = star.invoices.where(P.is_invoice()).where(_either("invoice_date", r, ly))
    sums = rows.agg(M.sum_if(_in(r, "invoice_date"), net).alias("net"),
                    M.sum_if(_in(ly, "invoice_date"), net).alias("net_ly"))
    return sums.select("*", M.change_pct("net", "net_ly").alias("yoy_pct"))


def wholesale_lines(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    heads = filters.apply(star.invoices.where(P.is_invoice() & _in(r, "invoice_date")), "wholesale_customer")
    return star.invoice_lines.join(heads.select("invoice_id", "customer_id", "rep_id"), "invoice_id")


def wholesale_items(star: Star, lines: DataFrame, *by: str) -> DataFrame:
    """Wholesale amount, units and cost per item; unresolved items stay."""
    folded = lines.groupBy("item_id", *by).agg(F.sum("units").alias("units"), F.sum("total").alias("total"),
                                               F.sum("cost").alias("cost"))
    return base.with_items(star, folded, how="left")


def wholesale_margin(star: Star, r: Range) -> DataFrame:
    sold = wholesale_items(star, wholesale_lines(star, r).where("total > 0"))
    return sold.agg(M.margin_pct(F.sum("total"), F.sum("cost")).alias("margin_pct"))


def channel_mix(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    retail = base.retail_tickets(star, r, filters).agg(M.total("net").alias("net"))
    wholesale = star.invoices.where(P.is_invoice() & _in(r, "invoice_date")).agg(M.total(M.invoice_net()).alias("net"))
    both = (retail.select(F.lit("Retail").alias("channel"), "net")
            .unionByName(wholesale.select(F.lit("Mayorista").alias("channel"), "net")))
    return both


def sales_by_store(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    return (base.retail_tickets(star, r, filters).groupBy("store")
            .agg(F.sum("net").alias("net"), F.count("ticket_id").alias("tickets")))


def monthly_trend(star: Star, r: Range, filters: Filters = NONE) -> DataFrame:
    """Both channels by month over at least twelve months."""
    wide = long_view(r, 11)
    retail = base.retail_tickets(star, wide, filters).groupBy(month_start("sale_date").alias("month")).agg(F.sum("net").alias("net"))
    invoiced = star.invoices.where(P.is_invoice() & _in(wide, "invoice_date"))
    wholesale = invoiced.groupBy(month_start("invoice_date").alias("month")).agg(F.sum(M.invoice_net()).alias("net"))
    return retail.unionByName(wholesale).groupBy("month").agg(F.sum("net").alias("net")).orderBy("month")


def top_families(star: Star, r: Range, filters: Filters = NONE, k: int = 10) -> DataFrame:
    """Families by net sales: units, margin, mix and change against the previous period and last year.

    All three periods come from one pass: item-grain sums per period, then the item join.
    """
    before, ly = comparison(r, "previous_period"), year_before(r)
    lines = base.retail_lines(star, _either("sale_date", r, before, ly), filters)
    now = _in(r)
    folded = lines.groupBy("item_id").agg(
        M.sum_if(now, "units").alias("units"), F.sum(F.when(now, F.col("net"))).alias("net"),
        F.sum(F.when(now, F.col("cost"))).alias("cost"),
        F.sum(F.when(_in(before), F.col("net"))).alias("net_before"), F.sum(F.when(_in(ly), F.col("net"))).alias("net_ly"))
    sold = base.with_items(star, folded, filters, family=True)
    families = sold.groupBy("family").agg(
        F.sum("net").alias("net"), F.sum("units").alias("units"), F.sum("cost").alias("cost"),
        F.sum("net_before").alias("net_before"), F.sum("net_ly").alias("net_ly")).where("net IS NOT NULL")
    mixed = share_of_total(families, ["family"], "net", "mix_pct")
    return top(mixed.select("family", "net", "units", M.margin_pct("net", "cost").alias("margin_pct"), "mix_pct",
                            M.change_pct("net", "net_before").alias("vs_previous_pct"),
                            M.change_pct("net", "net_ly").alias("vs_last_year_pct")),
               k, F.desc("net"), F.asc("family"))


def stock_and_backlog(star: Star) -> DataFrame:
    """Stock units, stock value at cost and open wholesale orders."""
    backlog = open_wholesale_orders(star).agg(F.count("order_id").alias("open_orders"))
    return base.one_row(stock_worth(star), backlog)


def stock_worth(star: Star) -> DataFrame:
    """Units of positive stock and their value at cost (active items only), in one pass over the cells."""
    per_item = star.stock.where(P.has_stock()).groupBy("item_id").agg(F.sum("qty").alias("qty"))
    costs = star.items.where("active").select("item_id", "unit_cost")
    return per_item.join(costs, "item_id", "left").agg(
        M.total("qty").alias("stock_units"), M.total(F.col("qty") * F.col("unit_cost")).alias("stock_value"))


def open_wholesale_orders(star: Star) -> DataFrame:
    return star.wholesale_orders.where("NOT closed AND NOT credit_note AND coalesce(pending, 0) > 0")
