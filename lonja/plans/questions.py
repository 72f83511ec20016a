"""Answers to the standing business questions (item, sales, stock, wholesale, customer, payment, margin, transfer)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import Range, month_start
from lonja.operators.ranking import top
from lonja.plans import base
from lonja.plans.general import wholesale_items
from lonja.sources.star import Star


def _sale_lines(star: Star, window: Column | None = None, positive: bool = False, real_store: bool = False,
                header_window: Column | None = None) -> DataFrame:
    """Lines of sale tickets; unlike the reports, the ghost store counts unless excluded."""
    lines = star.lines if window is None else star.lines.where(window)
    if positive:
        lines = lines.where("net > 0")
    heads = star.tickets.where("is_sale")
    if real_store:
        heads = heads.where(P.in_real_store(star.ghost_store))
    if header_window is not None:
        heads = heads.where(header_window)
    return lines.select("ticket_id", "item_id", "units", "net", "cost").join(heads.select("ticket_id", "store"), "ticket_id")


def _sold(star: Star, window: Column | None = None, positive: bool = False, family: bool = False) -> DataFrame:
    return base.with_items(star, base.fold_to_items(_sale_lines(star, window, positive)), family=family)


def _in(r: Range, column: str = "sale_date") -> Column:
    return P.in_days(column, r.lo, r.hi)


# --- items and sales ---


def top_items_by_units(star: Star, k: int = 10) -> DataFrame:
    out = _sold(star).groupBy("ref", "description").agg(F.sum("units").alias("units"))
    return top(out, k, F.desc("units"), F.asc("ref"))


def top_items_by_amount(star: Star, k: int = 10) -> DataFrame:
    out = _sold(star).groupBy("ref", "description").agg(F.sum("net").alias("net"), F.sum("units").alias("units"))
    return top(out, k, F.desc("net"), F.asc("ref"))


def top_items_with_stock(star: Star, r: Range, k: int = 20) -> DataFrame:
    """Sold units next to current stock; each side is folded first, so stock cells do not multiply sales."""
    sold = base.fold_to_items(_sale_lines(star, _in(r))).select("item_id", "units")
    stock = star.stock.groupBy("item_id").agg(F.sum("qty").alias("qty"))
    joined = sold.join(star.items, "item_id").join(stock, "item_id", "left")
    out = joined.groupBy("ref", "description").agg(F.sum("units").alias("units"), M.total("qty").alias("stock"))
    return top(out, k, F.desc("units"), F.asc("ref"))


def store_sales(star: Star, r: Range) -> DataFrame:
    return base.retail_tickets(star, r).groupBy("store").agg(F.sum("net").alias("net"), F.count("ticket_id").alias("tickets"))


def average_ticket(star: Star, r: Range) -> DataFrame:
    sums = base.retail_tickets(star, r).agg(F.sum("net").alias("net"), F.count("ticket_id").alias("tickets"))
    return sums.select(M.average_ticket("net", "tickets").alias("avg_ticket"))


def average_ticket_by_store(star: Star, r: Range) -> DataFrame:
    return store_sales(star, r).select("store", "tickets", M.average_ticket("net", "tickets").alias("avg_ticket"))


def total_sales(star: Star, r: Range) -> DataFrame:
    """Net and tickets of all sale tickets, the ghost store included."""
    return star.tickets.where(F.col("is_sale") & _in(r)).agg(F.sum("net").alias("net"), F.count("ticket_id").alias("tickets"))


def units_sold(star: Star, r: Range) -> DataFrame:
    """Units of lines whose ticket falls in the range (the ticket date counts, not the line date)."""
    return _sale_lines(star, header_window=_in(r)).agg(F.sum("units").alias("units"))


def returns(star: Star, r: Range) -> DataFrame:
    return star.tickets.where(~F.col("is_sale") & _in(r)).agg(F.count(F.lit(1)).alias("returns"), F.abs(F.sum("net")).alias("amount"))


def year_comparison(star: Star, now: Range, before: Range) -> DataFrame:
    """Net and tickets of two ranges, one row each, from one pass."""
    spans = {"Este año": now, "Año anterior": before}
    rows = star.tickets.where(F.col("is_sale") & (_in(now) | _in(before)))
    sums = rows.agg(*[e for i, r in enumerate(spans.values()) for e in (
        F.sum(F.when(_in(r), F.col("net"))).alias(f"net_{i}"), F.count_if(_in(r)).alias(f"tickets_{i}"))])
    cells = [F.struct(F.lit(n).alias("period"), F.col(f"net_{i}").alias("net"), F.col(f"tickets_{i}").alias("tickets"))
             for i, n in enumerate(spans)]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def store_year_comparison(star: Star, now: Range, before: Range) -> DataFrame:
    rows = base.retail_tickets(star, None).where(_in(now) | _in(before))
    return rows.groupBy("store").agg(M.sum_if(_in(now), "net").alias("this_year"), M.sum_if(_in(before), "net").alias("last_year"))


def store_months(star: Star, r: Range) -> DataFrame:
    return (base.retail_tickets(star, r).groupBy(month_start("sale_date").alias("month"), "store")
            .agg(F.sum("net").alias("net"), F.count("ticket_id").alias("tickets")).orderBy("month", "store"))


def weekdays(star: Star, r: Range) -> DataFrame:
    """Sales by day of week; Sunday is 0."""
    return (base.retail_tickets(star, r)
            .groupBy(F.date_format("sale_date", "EEEE").alias("day"), (F.dayofweek("sale_date") - 1).alias("dow"))
            .agg(F.sum("net").alias("net"), F.count("ticket_id").alias("tickets")).orderBy("dow"))


def sales_by(star: Star, column: str, r: Range | None = None, family: bool = False) -> DataFrame:
    """Sales by an item attribute: family, department, season, brand, color, ..."""
    sold = _sold(star, None if r is None else _in(r), family=family)
    return sold.groupBy(column).agg(F.sum("net").alias("net"), F.sum("units").alias("units"), F.count_distinct("ref").alias("refs"))


# --- catalog and stock ---


def catalog_counts(star: Star) -> DataFrame:
    """Active items by channel: wholesale references carry the M prefix."""
    whole = P.is_wholesale_ref()
    return star.items.where("active").agg(F.count(F.lit(1)).alias("items"), F.count_if(~whole).alias("retail"),
                                          F.count_if(whole).alias("wholesale"))


def items_by_season(star: Star) -> DataFrame:
    return star.items.groupBy("season").agg(F.count("item_id").alias("items"), F.count_if("active").alias("active"))


def stock_by_store(star: Star) -> DataFrame:
    per_item = star.stock.where(P.has_stock()).groupBy("store", "item_id").agg(F.sum("qty").alias("qty"))
    return per_item.groupBy("store").agg(F.sum("qty").alias("qty"), F.count("item_id").alias("items"))


def central_stock(star: Star, k: int = 20) -> DataFrame:
    out = star.central_stock.where(P.has_stock()).join(star.items, "item_id").select("item_id", "ref", "description", "qty")
    return top(out, k, F.desc("qty"), F.asc("item_id"))


def _item_stock(star: Star, *by: str, active: bool = True) -> DataFrame:
    folded = star.stock.where(P.has_stock()).groupBy("item_id", *by).agg(F.sum("qty").alias("qty"))
    return folded.join(star.items.where("active") if active else star.items, "item_id")


def stock_value(star: Star) -> DataFrame:
    return _item_stock(star).agg(F.sum(F.col("qty") * F.col("unit_cost")).alias("value"), F.sum("qty").alias("units"),
                                 F.count("item_id").alias("refs"))


def stock_by_item_size(star: Star) -> DataFrame:
    return _item_stock(star, "size", active=False).select("item_id", "ref", "size", "qty")


def negative_stock(star: Star, k: int = 50) -> DataFrame:
    out = star.stock.where(P.is_stock_incident()).join(star.items, "item_id").select("item_id", "ref", "store", "size", "qty")
    return top(out, k, F.asc("qty"), F.asc("item_id"), F.asc("store"), F.asc("size"))


def stock_by(star: Star, column: str, family: bool = False) -> DataFrame:
    rows = _item_stock(star)
    rows = rows.where("family_id IS NOT NULL") if family else rows
    return rows.groupBy(column).agg(F.count_distinct("ref").alias("refs"), F.sum("qty").alias("qty"),
                                    F.round(F.sum(F.col("qty") * F.col("unit_cost")), 2).alias("value"))


def dead_stock(star: Star, r: Range, floor: int = 10, k: int = 30) -> DataFrame:
    """Cells above the floor of active items without a sale in the range."""
    sold = _sale_lines(star, _in(r)).select("item_id").distinct()
    idle = (star.stock.where(F.col("qty") > floor).groupBy("item_id").agg(F.sum("qty").alias("qty"))
            .join(sold, "item_id", "left_anti").join(star.items.where("active"), "item_id"))
    out = idle.groupBy("ref", "description", "season").agg(F.sum("qty").alias("qty"))
    return top(out, k, F.desc("qty"), F.asc("ref"))


# --- wholesale ---


def _billed(star: Star, r: Range | None = None) -> DataFrame:
    rows = star.invoices.where(P.is_invoice())
    return (rows if r is None else rows.where(_in(r, "invoice_date"))).withColumn("net", M.invoice_net())


def wholesale_by_rep(star: Star) -> DataFrame:
    sums = _billed(star).groupBy("rep_id").agg(F.count("invoice_id").alias("invoices"), F.sum("net").alias("net"))
    return sums.join(star.reps, "rep_id").groupBy("rep").agg(F.sum("invoices").alias("invoices"), F.sum("net").alias("net"))


def wholesale_by_month(star: Star, r: Range) -> DataFrame:
    return (_billed(star, r).groupBy(month_start("invoice_date").alias("month"))
            .agg(F.count("invoice_id").alias("invoices"), F.sum("net").alias("net")).orderBy("month"))


def wholesale_customers(star: Star, k: int = 20) -> DataFrame:
    sums = _billed(star).groupBy("customer_id").agg(F.count("invoice_id").alias("invoices"), F.sum("net").alias("net"))
    named = sums.join(star.customers.select("customer_id", "name"), "customer_id").groupBy("name").agg(
        F.sum("invoices").alias("invoices"), F.sum("net").alias("net"))
    return top(named, k, F.desc("net"), F.asc("name"))


def deliveries(star: Star, r: Range) -> DataFrame:
    rows = star.deliveries.where(P.is_invoice() & _in(r, "sent_on"))
    return rows.agg(F.count(F.lit(1)).alias("deliveries"), F.sum("units").alias("units"), F.sum(M.invoice_net()).alias("net"))


def credit_notes(star: Star, r: Range, k: int = 20) -> DataFrame:
    rows = star.deliveries.where(F.col("credit_note") & _in(r, "sent_on"))
    sums = rows.groupBy("customer_id").agg(F.count(F.lit(1)).alias("notes"), F.sum(M.invoice_net()).alias("net"))
    named = sums.join(star.customers.select("customer_id", "name"), "customer_id").groupBy("name").agg(
        F.sum("notes").alias("notes"), F.sum("net").alias("net"))
    return top(named, k, F.desc("net"), F.asc("name"))


def wholesale_items_by_units(star: Star, k: int = 20) -> DataFrame:
    lines = _wholesale_lines(star).where("units > 0")
    sold = lines.groupBy("item_id").agg(F.sum("units").alias("units"), F.sum("total").alias("total")).join(star.items, "item_id")
    out = sold.groupBy("ref", "description").agg(F.sum("units").alias("units"), F.sum("total").alias("total"))
    return top(out, k, F.desc("units"), F.asc("ref"))


def _wholesale_lines(star: Star) -> DataFrame:
    """Lines of the wholesale channel, whatever the kind of document."""
    return star.invoice_lines.join(star.invoices.select("invoice_id", "rep_id"), "invoice_id")


def wholesale_margin_by_rep(star: Star) -> DataFrame:
    """Joined on the record id of the invoice, which is unique (the visible number is not)."""
    sold = wholesale_items(star, _wholesale_lines(star).where("total > 0"), "rep_id")
    per_rep = sold.groupBy("rep_id").agg(F.sum("total").alias("total"), F.sum("cost").alias("cost"))
    return per_rep.join(star.reps, "rep_id").groupBy("rep").agg(F.sum("total").alias("total"), F.sum("cost").alias("cost")).withColumn(
        "margin_pct", M.margin_pct("total", "cost"))


# --- customers ---


def _identified(star: Star, r: Range) -> DataFrame:
    return star.tickets.where(F.col("is_sale") & (F.col("customer_id") > 0) & _in(r))


def best_customers(star: Star, r: Range, k: int = 20) -> DataFrame:
    sums = _identified(star, r).groupBy("customer_id").agg(F.count("ticket_id").alias("purchases"), F.sum("net").alias("net"))
    named = sums.join(star.customers.select("customer_id", "name"), "customer_id").groupBy("name").agg(
        F.sum("purchases").alias("purchases"), F.sum("net").alias("net"))
    return top(named, k, F.desc("net"), F.asc("name"))


def unique_customers(star: Star, r: Range) -> DataFrame:
    """Distinct customer ids (id 0 is one of them), anonymous tickets and all tickets.

    Folded per customer first: the anonymous customer, who may hold most tickets, becomes one row.
    """
    per_customer = star.tickets.where(F.col("is_sale") & _in(r)).groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))
    return per_customer.agg(F.count("customer_id").alias("customers"), M.sum_if(F.col("customer_id") == 0, "n").alias("anonymous"),
                            F.sum("n").alias("tickets"))


def new_customers(star: Star, r: Range) -> DataFrame:
    whole = F.col("is_wholesale")
    return star.customers.where(_in(r, "created_on")).agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(~whole).alias("retail"), F.count_if(whole).alias("wholesale"))


def purchase_frequency(star: Star, r: Range) -> DataFrame:
    per_customer = _identified(star, r).groupBy("customer_id").agg(F.count("ticket_id").alias("n"))
    return per_customer.groupBy(M.purchase_band("n").alias("segment")).agg(F.count(F.lit(1)).alias("customers"))


# --- payments ---


def _paid(star: Star, r: Range, real_store: bool = False) -> DataFrame:
    rows = star.payments.where(F.col("is_collection") & _in(r, "paid_on"))
    return rows.where(P.in_real_store(star.ghost_store)) if real_store else rows


def _payment_sums(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("payments"), F.sum("amount").alias("amount"))


def payments_by_method(star: Star, r: Range) -> DataFrame:
    return _payment_sums(_paid(star, r), "method")


def payments_by_store_method(star: Star, r: Range) -> DataFrame:
    return _payment_sums(_paid(star, r, True), "store", "method")


def cash_or_card(star: Star, r: Range, cash_code: str = "01") -> DataFrame:
    cash = F.col("method_code") == cash_code
    return _paid(star, r, True).groupBy("store").agg(
        M.sum_if(cash, "amount").alias("cash"), M.sum_if(~cash, "amount").alias("other"), F.sum("amount").alias("total"))


def payments_by_day_method(star: Star, r: Range) -> DataFrame:
    return _payment_sums(_paid(star, r), "paid_on", "method")


# --- margins ---


def margin_by(star: Star, column: str, family: bool = False) -> DataFrame:
    return base.by_group(_sold(star, positive=True, family=family), column)


def margin_by_store(star: Star) -> DataFrame:
    lines = _sale_lines(star, positive=True, real_store=True)
    return base.by_group(base.with_items(star, base.fold_to_items(lines, "store"), how="left"), "store")


def low_margin_items(star: Star, limit: float = 0.30, k: int = 30) -> DataFrame:
    items = base.by_group(_sold(star, positive=True), "ref", "description")
    low = items.where(M.ratio(M.dbl("net") - M.dbl("cost"), "net") < limit)
    return top(low, k, F.asc("margin_pct"), F.asc("ref"))


# --- transfers ---


def _shipped(star: Star, r: Range | None) -> DataFrame:
    rows = star.transfers.where(~F.col("is_in"))
    return rows if r is None else rows.where(_in(r, "out_date"))


def transfers_by_route(star: Star, r: Range, k: int = 20) -> DataFrame:
    out = _shipped(star, r).groupBy("from_store", "to_store").agg(F.count(F.lit(1)).alias("transfers"), F.sum("units_out").alias("units"))
    return top(out, k, F.desc("units"), F.asc("from_store"), F.asc("to_store"))


def transfers_by_day(star: Star, r: Range) -> DataFrame:
    return _shipped(star, r).groupBy("out_date").agg(F.count(F.lit(1)).alias("transfers"), F.sum("units_out").alias("units"))


def item_movements(star: Star, ref: str, k: int = 50) -> DataFrame:
    chosen = star.items.where(F.col("ref") == ref).select("item_id")
    out = _shipped(star, None).join(chosen, "item_id").select("out_date", "from_store", "to_store", "size", "units_out", "kind", "transfer_id")
    return top(out, k, F.desc("out_date"), F.asc("transfer_id"), F.asc("size"))


