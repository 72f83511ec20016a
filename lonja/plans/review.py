"""Weekly review: the closed ISO week against the week before."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import DAY, Range, constants
from lonja.operators.ranking import top
from lonja.plans import base
from lonja.sources.star import Star


def _in(column: str, week: Range) -> Column:
    """Monday inclusive to the next Monday exclusive."""
    return P.in_days_until(column, week.lo, week.hi + DAY)


def _week_before(week: Range) -> Range:
    return Range(week.lo - DAY * 7, week.lo - DAY)


def sales(star: Star, week: Range) -> DataFrame:
    """Net, tickets and average ticket of the closed week and of the one before, in one pass."""
    spans = {"closed": week, "before": _week_before(week)}
    rows = base.retail_tickets(star, Range(spans["before"].lo, week.hi))
    sums = rows.agg(*[e for n, w in spans.items() for e in (
        M.sum_if(_in("sale_date", w), "net").cast("decimal(38,2)").alias(f"net_{n}"),
        F.count_if(_in("sale_date", w)).alias(f"tickets_{n}"))])
    cells = [F.struct(F.lit(n).alias("week"), F.col(f"net_{n}").alias("net"), F.col(f"tickets_{n}").alias("tickets")) for n in spans]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*").withColumn(
        "avg_ticket", M.average_ticket("net", "tickets"))


def store_ranking(star: Star, week: Range, k: int = 3, worst: bool = False) -> DataFrame:
    stores = base.retail_tickets(star, week).groupBy("store").agg(
        M.total("net").alias("net"), F.count("ticket_id").alias("tickets"))
    return top(stores, k, F.asc("net") if worst else F.desc("net"), F.asc("store"))


def top_items(star: Star, week: Range, k: int = 5) -> DataFrame:
    lines = base.retail_lines(star, _in("sale_date", week), positive=False).where("units > 0")
    sold = base.with_items(star, base.fold_to_items(lines), how="left")
    out = sold.select("item_id", F.coalesce("ref", F.col("item_id").cast("string")).alias("ref"),
                      F.coalesce("description", F.col("item_id").cast("string")).alias("description"), "units", "net")
    return top(out, k, F.desc("units"), F.asc("item_id"))


def return_rates(star: Star, week: Range) -> DataFrame:
    rows = base.retail_tickets(star, None, returns=None).where(_in("sale_date", week))
    sale = F.col("is_sale")
    sums = rows.agg(M.sum_if(sale, "net").alias("sales"), F.abs(M.sum_if(~sale, "net")).alias("returns"),
                    F.count_if(sale).alias("sale_tickets"), F.count_if(~sale).alias("return_tickets"))
    return sums.withColumn("return_rate_pct", M.return_rate_of_tickets("sale_tickets", "return_tickets"))


def wholesale_net(star: Star, week: Range) -> DataFrame:
    rows = star.invoices.where(P.is_invoice() & _in("invoice_date", week))
    return rows.agg(M.total(M.invoice_net()).alias("net"), F.count(F.lit(1)).alias("invoices"))


def top_wholesale_customers(star: Star, week: Range, k: int = 3) -> DataFrame:
    sums = star.invoices.where(P.is_invoice() & _in("invoice_date", week)).groupBy("customer_id").agg(
        F.sum(M.invoice_net()).alias("net"), F.count(F.lit(1)).alias("invoices"))
    out = sums.join(star.customers.select("customer_id", "name"), "customer_id", "left").select(
        "customer_id", F.coalesce("name", F.col("customer_id").cast("string")).alias("customer"), "net", "invoices")
    return top(out, k, F.desc("net"), F.asc("customer_id"))


def uninvoiced_deliveries(star: Star, week: Range, days: int = 30) -> DataFrame:
    """Deliveries without an invoice of the same customer from their day on, within the next 30 days.

    Both sides are first folded to one row per customer and day, so the range condition never
    meets more rows than there are days, however many deliveries one customer has.
    """
    sent = star.deliveries.where(P.in_days_until("sent_on", week.lo - DAY * days, week.hi + DAY))
    per_day = sent.groupBy("customer_id", "sent_on").agg(F.count(F.lit(1)).alias("n"))
    billed = (star.invoices.where(P.is_invoice() & P.in_days_until("invoice_date", week.lo - DAY * days, week.hi + DAY * (days + 1)))
              .select("customer_id", "invoice_date").distinct())
    d, i = per_day.alias("d"), billed.alias("i")
    match = ((F.col("d.customer_id") == F.col("i.customer_id")) & (F.col("i.invoice_date") >= F.col("d.sent_on"))
             & (F.col("i.invoice_date") < F.date_add("d.sent_on", days)))
    return d.join(i, match, "left_anti").agg(M.total("n").alias("pending_deliveries"))


def stock_totals(star: Star) -> DataFrame:
    stores = base.stock_rows(star).groupBy("item_id").agg(F.sum("qty").alias("qty")).agg(
        F.count(F.lit(1)).alias("store_refs"), M.total("qty").alias("store_units"))
    central = star.central_stock.where(P.has_stock()).agg(F.count(F.lit(1)).alias("central_refs"),
                                                          M.total("qty").alias("central_units"))
    return base.one_row(stores, central).withColumn("total_units", F.col("store_units") + F.col("central_units"))


def critical_stock(star: Star, limit: int = 5, k: int = 20) -> DataFrame:
    out = star.stock.groupBy("item_id").agg(F.sum("qty").alias("qty")).where((F.col("qty") > 0) & (F.col("qty") < limit))
    return top(out, k, F.asc("qty"), F.asc("item_id"))


def transfers(star: Star, week: Range) -> DataFrame:
    """Movements of the week: what left and what arrived are separate sides of each movement."""
    sides = star.transfers
    out = sides.where(~F.col("is_in") & _in("out_date", week)).agg(
        F.count(F.lit(1)).alias("shipments"), M.total("units_out").alias("units_sent"))
    into = sides.where(F.col("is_in") & _in("in_date", week)).agg(
        F.count(F.lit(1)).alias("arrivals"), M.total("units_in").alias("units_received"))
    return base.one_row(out, into)


def purchases(star: Star, week: Range) -> DataFrame:
    """Orders and their lines of the closed week and of the one before; the two counts may differ."""
    spans = {"closed": week, "before": _week_before(week)}
    heads = star.purchase_orders.where(P.in_days("ordered_on", spans["before"].lo, week.hi)).select(
        "po_id", F.when(_in("ordered_on", week), "closed").otherwise("before").alias("week"))
    orders = heads.groupBy("week").agg(F.count("po_id").alias("orders"))
    per_order = star.purchase_lines.join(heads, "po_id").groupBy("po_id", "week").agg(
        F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"), F.sum("net").alias("net"))
    lines = per_order.groupBy("week").agg(F.count("po_id").alias("orders_with_lines"), F.sum("n").alias("lines"),
                                          F.sum("units").alias("units"), F.sum("net").alias("net"))
    weeks = constants(star.spark, [(n,) for n in spans], "week string")
    return weeks.join(orders, "week", "left").join(lines, "week", "left").na.fill(0)


def _bought(star: Star, week: Range) -> DataFrame:
    heads = star.purchase_orders.where(_in("ordered_on", week)).select("po_id")
    return star.purchase_lines.join(heads, "po_id", "left_semi")


def top_suppliers(star: Star, week: Range, k: int = 3) -> DataFrame:
    per_order = _bought(star, week).groupBy("supplier_id", "po_id").agg(F.sum("units").alias("units"), F.sum("net").alias("net"))
    sums = per_order.groupBy("supplier_id").agg(F.count("po_id").alias("orders"), F.sum("units").alias("units"), F.sum("net").alias("net"))
    out = sums.join(star.suppliers, "supplier_id", "left").select(
        "supplier_id", F.coalesce("name", F.col("supplier_id").cast("string")).alias("supplier"), "orders", "units", "net")
    return top(out, k, F.desc_nulls_last("net"), F.asc("supplier_id"))


def top_bought_items(star: Star, week: Range, k: int = 5) -> DataFrame:
    sums = _bought(star, week).groupBy("item_id").agg(F.sum("units").alias("units"), F.sum("net").alias("net"))
    out = sums.join(star.items, "item_id", "left").select(
        "item_id", F.coalesce("ref", F.col("item_id").cast("string")).alias("ref"),
        F.coalesce("description", F.lit("")).alias("description"), "units", "net")
    return top(out, k, F.desc_nulls_last("units"), F.asc("item_id"))


# --- the whole review -----------------------------------------------------------------------------

SECTIONS: dict[str, Callable[[Star, Range], DataFrame]] = {
    "sales": sales,
    "best_stores": store_ranking,
    "worst_stores": lambda s, w: store_ranking(s, w, worst=True),
    "top_items": top_items,
    "return_rates": return_rates,
    "wholesale_net": wholesale_net,
    "top_wholesale_customers": top_wholesale_customers,
    "uninvoiced_deliveries": uninvoiced_deliveries,
    "stock_totals": lambda s, w: stock_totals(s),
    "critical_stock": lambda s, w: critical_stock(s),
    "transfers": transfers,
    "purchases": purchases,
    "top_suppliers": top_suppliers,
    "top_bought_items": top_bought_items,
}


@dataclass(frozen=True)
class Outcome:
    section: str
    path: str | None
    error: str | None


def run_review(star: Star, week: Range, out_dir: str,
               sections: Mapping[str, Callable[[Star, Range], DataFrame]] = SECTIONS) -> list[Outcome]:
    """Write every section; one that fails is reported and the rest continue."""
    outcomes = []
    for name, plan in sections.items():
        path = f"{out_dir.rstrip('/')}/{week.lo:%Y-%m-%d}/{name}"
        try:
            plan(star, week).write.mode("overwrite").parquet(path)
            outcomes.append(Outcome(name, path, None))
        except Exception as exc:  # noqa: BLE001 - a failed section must not hide the others
            outcomes.append(Outcome(name, None, str(exc)))
    return outcomes


def failed_share(outcomes: DataFrame) -> DataFrame:
    """Share of failed sections in a review; 0 for an empty one."""
    share = F.avg(F.col("error").isNotNull().cast("double"))
    return outcomes.agg(F.coalesce(share, F.lit(0.0)).alias("failed_share"))


def week_of(day: dt.date) -> Range:
    monday = day - DAY * day.weekday()
    return Range(monday, monday + DAY * 6)
