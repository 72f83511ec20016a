"""Further analyses: expected stock, lost sales, turnover, collections, distributions, concentration, checks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions import periods as T
from lonja.functions import predicates as P
from lonja.functions.periods import DAY, Range
from lonja.operators.ingest import unpivot_measures
from lonja.operators.ranking import top, top_share
from lonja.plans import base
from lonja.plans.stock import velocity
from lonja.sources.star import Star

# Effect of a movement kind on the stock of its store.
MOVEMENT_SIGN = {
    "return": 1, "receipt": 1, "transfer_in": 1, "credit": 1,
    "sale": -1, "purchase_return": -1, "transfer_out": -1, "shipment": -1,
}


# --- expected stock -------------------------------------------------------------------------------


def movements(star: Star, r: Range, warehouse: str) -> DataFrame:
    """All stock movements of a range as (item, store, kind, units); wholesale and purchasing use the warehouse."""

    def inside(column: str) -> Column:
        return P.in_days(column, r.lo, r.hi)

    heads = star.tickets.select("ticket_id", "store", "is_sale")
    sold = star.lines.where(inside("sale_date")).select("ticket_id", "item_id", "units").join(heads, "ticket_id").select(
        "item_id", "store", F.when(F.col("is_sale"), "sale").otherwise("return").alias("kind"), "units")
    # both ends of a transfer from one row of its table, as far as they count
    ends = F.array(
        F.when(F.col("is_in") & inside("in_date"), F.struct(
            F.col("to_store").alias("store"), F.lit("transfer_in").alias("kind"), F.col("units_in").alias("units"))),
        F.when(~F.col("is_in") & inside("out_date"), F.struct(
            F.col("from_store").alias("store"), F.lit("transfer_out").alias("kind"), F.col("units_out").alias("units"))))
    moved = star.transfers.where(inside("in_date") | inside("out_date")).select("item_id", F.inline(F.array_compact(ends)))
    arrived = star.purchase_orders.where(inside("received_on")).select("po_id")
    received = star.purchase_lines.join(arrived, "po_id", "left_semi").select(
        "item_id", F.lit(warehouse).alias("store"), F.lit("receipt").alias("kind"), "units")
    documents = star.invoices.where(inside("invoice_date")).select("invoice_id", "credit_note")
    billed = star.invoice_lines.join(documents, "invoice_id").select(
        "item_id", F.lit(warehouse).alias("store"), F.when(F.col("credit_note"), "credit").otherwise("shipment").alias("kind"), "units")
    all_moves = sold
    for part in (moved, received, billed):
        all_moves = all_moves.unionByName(part)
    return all_moves


def signed_units(kind: str = "kind", units: str = "units") -> Column:
    positive = [k for k, sign in MOVEMENT_SIGN.items() if sign > 0]
    return F.when(F.col(kind).isin(*positive), F.col(units)).when(F.col(kind).isin(*MOVEMENT_SIGN), -F.col(units))


def net_movement(moves: DataFrame, *keys: str) -> DataFrame:
    """Entries, exits and net per group, in one aggregation of the signed movements."""
    s = signed_units()
    return moves.groupBy(*keys).agg(M.sum_if(s > 0, s).alias("entries"), M.sum_if(s < 0, -s).alias("exits"),
                                    M.total(s).alias("net"))


def shrinkage(counts: DataFrame, moves: DataFrame) -> DataFrame:
    """Expected against counted stock per item and store; the difference is loss or a recording error.

    ``counts`` has the opening and the counted stock (``initial``, ``actual``), from one or several sources.  All
    sources meet signed in one grouping, so a cell missing on any side still appears.
    """
    zero = F.lit(0)
    rows = (counts.select("item_id", "store", F.coalesce("initial", zero).alias("expected"), F.coalesce("actual", zero).alias("actual"))
            .unionByName(moves.select("item_id", "store", signed_units().alias("expected"), zero.alias("actual"))))
    sums = rows.groupBy("item_id", "store").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    return sums.withColumn("difference", F.col("actual") - F.col("expected"))


# --- stock health ---------------------------------------------------------------------------------


def lost_sales(star: Star, as_of: dt.date, k: int = 30) -> DataFrame:
    """Items that sold in the last 30 days and have no central stock left."""
    sold = velocity(star, as_of, True)
    empty = sold.join(star.central_stock.where(P.has_stock()).select("item_id"), "item_id", "left_anti")
    out = empty.join(star.items, "item_id").select("item_id", "ref", "units", F.round(M.velocity("units"), 2).alias("per_day"))
    return top(out, k, F.desc("units"), F.asc("item_id"))


def below_minimum(star: Star, minimums: DataFrame, k: int = 50) -> DataFrame:
    """Active items under their minimum stock, by deficit; ``minimums`` is (item_id, minimum)."""
    held = star.stock.groupBy("item_id").agg(F.sum("qty").alias("qty"))
    rows = star.items.where("active").join(minimums.where("minimum > 0"), "item_id").join(held, "item_id", "left")
    qty = F.coalesce("qty", F.lit(0))
    out = rows.where(qty < F.col("minimum")).select("item_id", "ref", qty.alias("qty"), "minimum", (F.col("minimum") - qty).alias("deficit"))
    return top(out, k, F.desc("deficit"), F.asc("item_id"))


def turnover(star: Star, r: Range, k: int = 50) -> DataFrame:
    """Units sold over current stock."""
    lines = base.retail_lines(star, base.line_window(r), positive=False)
    sold = lines.groupBy("item_id").agg(F.sum("units").alias("units")).where("units > 0")
    held = star.stock.groupBy("item_id").agg(F.sum("qty").alias("qty"))
    out = sold.join(held, "item_id", "left").select("item_id", "units", F.coalesce("qty", F.lit(0)).alias("qty"),
                                                    F.round(M.ratio("units", "qty"), 4).alias("turnover"))
    return top(out, k, F.desc("units"), F.asc("item_id"))


def stock_snapshot(star: Star, day: dt.date) -> DataFrame:
    """Non-zero cells stamped with the day: append them to a table partitioned by ``snapshot_date``."""
    return star.stock.where("qty <> 0").withColumn("snapshot_date", F.lit(day))


def snapshot_change(snapshots: DataFrame, earlier: dt.date, later: dt.date) -> DataFrame:
    """Change of every cell between two snapshots (a missing cell is 0), from two partitions in one grouping."""
    day = F.col("snapshot_date")
    rows = snapshots.where(day.isin(earlier, later))
    before, after = M.sum_if(day == F.lit(earlier), "qty"), M.sum_if(day == F.lit(later), "qty")
    return rows.groupBy("item_id", "store", "size").agg(before.alias("before"), after.alias("after"), (after - before).alias("change"))


# --- collections and prices -----------------------------------------------------------------------


def unpaid_invoices(star: Star, r: Range, k: int = 20) -> DataFrame:
    """Invoices not fully collected.  Collections are folded per invoice before the join."""
    paid = star.collections.groupBy("invoice_id").agg(F.sum("amount").alias("collected"))
    heads = star.invoices.where(P.in_days("invoice_date", r.lo, r.hi))
    out = heads.join(paid, "invoice_id", "left").select(
        "invoice_id", "customer_id", "total", F.coalesce("collected", F.lit(0)).alias("collected"),
        (F.col("total") - F.coalesce("collected", F.lit(0))).alias("pending")).where("pending > 0")
    return top(out, k, F.desc("pending"), F.asc("invoice_id"))


def catalog_margin() -> tuple[Column, Column]:
    """Builders for the list-price margin, with and without VAT in the price."""
    net_price = M.dbl("list_price") / (1 + M.dbl("vat_rate") / 100)
    return M.margin_pct("list_price", "unit_cost"), F.round((net_price - M.dbl("unit_cost")) / net_price * 100, 1)


def low_catalog_margin(star: Star, limit_pct: float = 30.0, k: int = 50) -> DataFrame:
    """Active items whose list price leaves little margin once VAT is taken out."""
    gross, net = catalog_margin()
    priced = star.items.where("active AND list_price > 0 AND unit_cost > 0").select(
        "item_id", "ref", "list_price", "unit_cost", gross.alias("margin_pct"), net.alias("net_margin_pct"))
    return top(priced.where(F.col("net_margin_pct") < limit_pct), k, F.asc("net_margin_pct"), F.asc("item_id"))


# --- distributions --------------------------------------------------------------------------------


def by_hour(star: Star, r: Range | None = None) -> DataFrame:
    return base.retail_tickets(star, r).where("hour IS NOT NULL").groupBy("hour").agg(
        F.count("ticket_id").alias("tickets"), F.sum("net").alias("net"))


def customer_visits(star: Star, r: Range, k: int = 50) -> DataFrame:
    rows = star.tickets.where((F.col("customer_id") > 0) & F.col("is_sale") & P.in_days("sale_date", r.lo, r.hi))
    out = rows.groupBy("customer_id").agg(
        F.count("ticket_id").alias("visits"), F.min("sale_date").alias("first_visit"), F.max("sale_date").alias("last_visit"),
        F.sum("net").alias("net")).where("visits > 1")
    return top(out, k, F.desc("visits"), F.asc("customer_id"))


def customer_concentration(star: Star, r: Range) -> DataFrame:
    """Share of sales held by the top tenth of the identified customers (exact, no global sort)."""
    spent = star.tickets.where((F.col("customer_id") > 0) & F.col("is_sale") & P.in_days("sale_date", r.lo, r.hi)).groupBy(
        "customer_id").agg(F.sum("net").cast("decimal(20,2)").alias("net"))
    return top_share(spent, "net").withColumn("share_pct", M.percent("top_total", "total"))


def weekly_trend(star: Star, as_of: dt.date, weeks: int = 12) -> DataFrame:
    """Net, tickets and units per ISO week, zero-filled; units are those of the lines dated in the week."""
    last = T.start_of(as_of, "week")
    first = last - DAY * 7 * (weeks - 1)
    span = Range(first, last + DAY * 6)
    sums = base.retail_tickets(star, span).groupBy(T.week_start("sale_date").alias("week")).agg(
        F.sum("net").alias("net"), F.count("ticket_id").alias("tickets"))
    sold = base.retail_lines(star, base.line_window(span), positive=False).groupBy(T.week_start("sale_date").alias("week")).agg(F.sum("units").alias("units"))
    zero = F.lit(0)
    return T.spine(star.spark, "week", first, last, "week").join(sums, "week", "left").join(sold, "week", "left").select(
        "week", F.coalesce("net", zero).alias("net"), F.coalesce("tickets", zero).alias("tickets"), F.coalesce("units", zero).alias("units"))


def sold_by_line(star: Star, r: Range, column: str) -> DataFrame:
    """Units and amount by a column of the lines (size slot, discount level)."""
    lines = base.retail_lines(star, base.line_window(r), positive=False, keep=(column,))
    return lines.groupBy(column).agg(F.sum("units").alias("units"), F.sum("net").alias("net"), F.count(F.lit(1)).alias("lines"))


def discount_summary(star: Star, r: Range, column: str = "discount") -> DataFrame:
    lines = base.retail_lines(star, base.line_window(r), positive=False, keep=(column,))
    sums = lines.agg(F.sum(column).alias("d"), F.count(column).alias("n"), F.sum("net").alias("net"), F.sum("units").alias("units"))
    return sums.select(F.round(M.ratio("d", "n") * 100, 4).alias("avg_discount_pct"), "net", "units")


def growth_bands(star: Star, now: Range, before: Range) -> DataFrame:
    """Growth per store in four bands, from one pass; a store without last year has no band."""
    def within(r: Range) -> Column:
        return P.in_days("sale_date", r.lo, r.hi)

    rows = base.retail_tickets(star, None).where(within(now) | within(before)).groupBy("store").agg(
        F.sum(F.when(within(now), F.col("net"))).alias("now"), F.sum(F.when(within(before), F.col("net"))).alias("before"))
    grown = rows.where("now IS NOT NULL").withColumn("yoy_pct", M.change_pct("now", "before"))
    return grown.withColumn("band", M.heat_band("yoy_pct"))


def voucher_redemptions(vouchers: DataFrame) -> DataFrame:
    """Redeemed vouchers by store and month; ``vouchers`` has store, redeemed_on, amount."""
    used = vouchers.where("redeemed_on IS NOT NULL")
    return used.groupBy("store", P.month_of("redeemed_on").alias("month")).agg(
        F.count(F.lit(1)).alias("vouchers"), F.sum("amount").alias("amount"))


def transfers_by_type(star: Star, r: Range) -> DataFrame:
    rows = star.transfers.where(F.col("is_in") & P.in_days("in_date", r.lo, r.hi))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("transfers"), F.sum("units_in").alias("units"))


def sizes_shipped(wide_lines: DataFrame, prefixes: Mapping[str, str], n: int = 34, label_prefix: str = "size") -> DataFrame:
    """Units per size from order lines that carry a slot matrix."""
    long = unpivot_measures(wide_lines, [], label_prefix, prefixes, n)
    return long.groupBy("size").agg(*[F.sum(m).alias(m) for m in prefixes])


# --- plausibility ---------------------------------------------------------------------------------

# Plausible monthly values for the whole chain (fixed values): metric, low, high.
MAGNITUDES = (
    ("net_sales", 200_000.0, 3_000_000.0),
    ("average_ticket", 30.0, 250.0),
    ("stock_units", 20_000.0, 400_000.0),
    ("stock_value", 500_000.0, 15_000_000.0),
)
# How much a narrower question divides the bounds.
SCOPE_DIVISOR = {"store": 50.0, "day": 30.0, "family": 20.0}


def magnitude_check(values: DataFrame, scopes: tuple[str, ...] = ()) -> DataFrame:
    """Flag a metric more than ten times its upper bound, or exactly 0.  ``values`` is (metric, value).

    A metric without bounds stays, and cannot be too high.
    """
    divisor = 1.0
    for scope in scopes:
        divisor *= SCOPE_DIVISOR[scope]
    bounds = T.constants(values.sparkSession, MAGNITUDES, "metric string, low double, high double")
    scaled = F.when(F.col("metric") == "average_ticket", 1.0).otherwise(divisor)
    checked = values.join(F.broadcast(bounds), "metric", "left").withColumns({"low": F.col("low") / scaled, "high": F.col("high") / scaled})
    flag = F.when(F.col("value") == 0, "zero").when(F.col("value") > F.col("high") * 10, "too high").otherwise("plausible")
    return checked.withColumn("flag", flag)


def customers_in_both(customers: DataFrame, retail: DataFrame, wholesale: DataFrame) -> DataFrame:
    """Customers that appear in both channels.  The ids are made distinct first, so a hot id moves once."""
    ids = [f.where("customer_id > 0").select("customer_id").distinct() for f in (retail, wholesale)]
    return customers.join(ids[0], "customer_id", "left_semi").join(ids[1], "customer_id", "left_semi")
