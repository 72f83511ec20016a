"""Stock report."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import labels as L
from lonja.functions import metrics as M
from lonja.functions import predicates as P
from lonja.functions.periods import Range
from lonja.operators.filters import NONE, Filters
from lonja.operators.ranking import top
from lonja.plans import base
from lonja.sources.star import Star


def _stock_by(star: Star, filters: Filters, *keys: str) -> DataFrame:
    """Positive stock folded to item grain (and keys), joined to active items."""
    folded = base.stock_rows(star, filters).groupBy("item_id", *keys).agg(F.sum("qty").alias("qty"))
    return folded.join(base.active_items(star, filters), "item_id")


def kpis(star: Star, filters: Filters = NONE) -> DataFrame:
    """Units in stores and in the central warehouse, value at cost and active references; one pass over the cells."""
    cells = base.stock_rows(star, filters).groupBy("item_id").agg(F.sum("qty").alias("qty"))
    known = base.active_items(star, filters).select("item_id", "unit_cost", F.lit(True).alias("counts"))
    sums = cells.join(known, "item_id", "left").agg(
        M.total("qty").alias("store_units"), M.sum_if(F.col("counts"), F.col("qty") * F.coalesce("unit_cost", F.lit(0))).alias("value"),
        F.count_if(F.col("counts")).alias("active_refs"))
    central = star.central_stock.agg(M.total("qty").alias("central_units"))
    return base.one_row(sums, central)


def by_store(star: Star, filters: Filters = NONE) -> DataFrame:
    return _stock_by(star, filters, "store").groupBy("store").agg(F.sum("qty").alias("qty")).orderBy(F.desc("qty"), "store")


def by_family(star: Star, filters: Filters = NONE, k: int = 10) -> DataFrame:
    out = _stock_by(star, filters).groupBy(L.family_label().alias("family")).agg(F.sum("qty").alias("qty"))
    return top(out, k, F.desc("qty"), F.asc("family"))


def by_size(star: Star, filters: Filters = NONE) -> DataFrame:
    return _stock_by(star, filters, "size").groupBy("size").agg(F.sum("qty").alias("qty")).orderBy("size")


def velocity(star: Star, as_of: dt.date, include_today: bool, *by: str, days: int = 30) -> DataFrame:
    """Units sold per item (and ``by``) in the trailing days, sellers only."""
    lines = base.retail_lines(star, base.trailing(as_of, days, include_today), positive=False)
    return lines.groupBy("item_id", *by).agg(F.sum("units").alias("units")).where("units > 0")


def critical_coverage(star: Star, as_of: dt.date, filters: Filters = NONE, limit: float = 7.0, k: int = 50,
                      include_today: bool = False) -> DataFrame:
    """Store/item pairs whose stock lasts less than a week at the current pace."""
    stock = base.stock_rows(star, filters).groupBy("item_id", "store").agg(F.sum("qty").alias("qty"))
    pace = velocity(star, as_of, include_today, "store")
    joined = stock.join(pace, ["item_id", "store"]).withColumn("days", M.coverage_days("qty", "units"))
    critical = joined.where(F.col("days") < limit).join(base.active_items(star, filters), "item_id")
    return top(critical.select("store", "item_id", L.or_dash("ref").alias("ref"), L.or_dash("description").alias("description"),
                               L.first_label("family", default=L.DASH).alias("family"), "qty",
                               F.round(M.velocity("units"), 2).alias("per_day"), F.round("days", 1).alias("coverage_days")),
               k, F.asc("coverage_days"), F.asc("store"), F.asc("item_id"))


def stockout_rate(star: Star, filters: Filters = NONE, k: int | None = 50) -> DataFrame:
    """Per family and size: references without and with stock, and the share without."""
    folded = base.stock_rows(star, filters, positive=False).groupBy("item_id", "size").agg(F.sum("qty").alias("qty"))
    refs = folded.join(base.active_items(star, filters), "item_id").withColumn("label", L.family_label())
    out = F.col("qty") <= 0
    rates = (refs.groupBy(F.col("label").alias("family"), "size")
             .agg(F.count_if(out).alias("without_stock"), F.count_if(~out).alias("with_stock"), F.count(F.lit(1)).alias("refs"))
             .where(F.col("without_stock") > 0).withColumn("stockout_pct", M.percent("without_stock", "refs")))
    order = (F.desc("stockout_pct"), F.asc("family"), F.asc("size"))
    return top(rates, k, *order) if k else rates.orderBy(*order)


def top_item_sizes(star: Star, filters: Filters = NONE, k: int = 50) -> DataFrame:
    rows = _stock_by(star, filters, "size")
    out = rows.groupBy(L.family_label().alias("family"), "size", L.or_dash("ref").alias("ref"),
                       L.or_dash("description").alias("description")).agg(F.sum("qty").alias("qty"))
    return top(out, k, F.desc("qty"), F.asc("ref"), F.asc("size"))


def low_stock(star: Star, filters: Filters = NONE, limit: int = 5, k: int = 50) -> DataFrame:
    """Cells with a few units left, summed per store and reference."""
    cells = base.stock_rows(star, filters).where(F.col("qty") < limit)
    folded = cells.groupBy("item_id", "store").agg(F.sum("qty").alias("qty")).join(base.active_items(star, filters), "item_id")
    out = folded.groupBy("store", L.or_dash("ref").alias("ref"), L.or_dash("description").alias("description"),
                         L.first_label("family", default=L.DASH).alias("family")).agg(F.sum("qty").alias("qty"))
    return top(out, k, F.asc("qty"), F.asc("store"), F.asc("ref"))


def without_stock(star: Star, filters: Filters = NONE, k: int = 50) -> DataFrame:
    """Active items with no positive stock in any (selected) store, including items never distributed."""
    stocked = base.stock_rows(star, filters).select("item_id")
    out = base.active_items(star, filters).join(stocked, "item_id", "left_anti").select(
        "item_id", L.or_dash("ref").alias("ref"), L.or_dash("description").alias("description"),
        L.first_label("family", default=L.DASH).alias("family"), "season")
    return top(out, k, F.desc_nulls_last("season"), F.asc("description"), F.asc("item_id"))


def dead_stock(star: Star, r: Range, filters: Filters = NONE, floor: int = 10, k: int = 50) -> DataFrame:
    """Stock of items without a single sale in the range (a missing item code never hides the others)."""
    sold = base.retail_lines(star, base.line_window(r), positive=False).select("item_id").distinct()
    idle = _stock_by(star, filters).join(sold, "item_id", "left_anti")
    out = idle.groupBy(L.or_dash("ref").alias("ref"), L.or_dash("description").alias("description"),
                       L.first_label("family", default=L.DASH).alias("family"), L.or_dash("season").alias("season")).agg(
        F.sum("qty").alias("qty")).where(F.col("qty") > floor)
    return top(out, k, F.desc("qty"), F.asc("ref"))


def recent_transfers(star: Star, r: Range, k: int = 50) -> DataFrame:
    """Shipments by day and route; only the outgoing row of each movement counts."""
    out = (star.transfers.where(~F.col("is_in") & P.in_days("out_date", r.lo, r.hi))
           .groupBy("out_date", L.or_dash("from_store").alias("from_store"), L.or_dash("to_store").alias("to_store"))
           .agg(F.count(F.lit(1)).alias("lines"), M.total("units_out").alias("units")))
    return top(out, k, F.desc("out_date"), F.desc("units"), F.asc("from_store"), F.asc("to_store"))
