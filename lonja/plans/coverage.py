"""Coverage report: how long the stock of each item lasts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions import labels as L
from lonja.functions import metrics as M
from lonja.operators.filters import NONE, Filters
from lonja.operators.ranking import top
from lonja.plans import base
from lonja.plans.stock import velocity
from lonja.sources.star import Star

FILTERS = ("catalog_family", "season", "brand", "supplier")
CRITICAL, OVERSTOCK, CAP, DEFAULT_LEAD = 7, 90, 365, 15


def item_coverage(star: Star, as_of: dt.date, filters: Filters = NONE, include_today: bool = True) -> DataFrame:
    """Active sellers with their stock (never below 0), pace and days of coverage."""
    rows = base.stock_rows(star, filters, positive=False)
    per_store = rows.groupBy("item_id", "store").agg(F.sum("qty").alias("qty"), F.max(F.col("qty") > 0).alias("has_any"))
    stock = per_store.groupBy("item_id").agg(F.greatest(F.sum("qty"), F.lit(0)).alias("stock"),
                                             F.count_if("has_any").alias("stores"))
    pace = velocity(star, as_of, include_today)
    return (stock.join(pace, "item_id").join(base.active_items(star, filters, FILTERS), "item_id")
            .withColumn("days", M.coverage_days("stock", "units")))


def kpis(star: Star, as_of: dt.date, filters: Filters = NONE) -> DataFrame:
    """Critical and overstocked counts, weighted mean coverage and value at risk from one shared frame."""
    cover, days = item_coverage(star, as_of, filters), F.col("days")
    counted = days < CAP
    return cover.agg(
        F.count_if(days < CRITICAL).alias("critical"),
        F.coalesce(F.round(M.ratio(F.sum(F.when(counted, F.col("stock"))),
                                   M.velocity(F.sum(F.when(counted, F.col("units"))))), 1), F.lit(0.0)).alias("mean_days"),
        F.count_if((days > OVERSTOCK) & counted).alias("overstocked"),
        M.sum_if(days < CRITICAL, F.col("stock") * F.coalesce("unit_cost", F.lit(0))).alias("value_at_risk"))


def supplier_lead_times(star: Star) -> DataFrame:
    """Mean days from order to receipt per supplier, over pairs in the right order."""
    valid = star.purchase_orders.where("received_on >= ordered_on")
    return valid.groupBy("supplier_id").agg(F.round(F.avg(F.datediff("received_on", "ordered_on")), 1).alias("lead_days"))


def _columns(*more):
    return [L.or_dash("ref").alias("ref"), L.or_dash("description").alias("description"),
            L.first_label("family", default=L.DASH).alias("family"), *more,
            F.round(M.velocity("units"), 2).alias("per_day"), F.round("days", 1).alias("coverage_days")]


def below_lead_time(star: Star, as_of: dt.date, filters: Filters = NONE, k: int = 50) -> DataFrame:
    """Items that run out before their supplier could deliver; 15 days where no delivery is known."""
    cover = item_coverage(star, as_of, filters).join(supplier_lead_times(star), "supplier_id", "left")
    lead = F.coalesce("lead_days", F.lit(float(DEFAULT_LEAD)))
    late = cover.withColumn("lead", lead).where("days < lead")
    return top(late.select("item_id", *_columns("stores", "stock"), F.col("lead").alias("lead_days")),
               k, F.asc("coverage_days"), F.asc("item_id"))


def mean_by_family(star: Star, as_of: dt.date, filters: Filters = NONE, k: int = 15) -> DataFrame:
    """Simple mean per family: every item weighs the same."""
    cover = item_coverage(star, as_of, filters).where(F.col("days") < CAP)
    out = cover.groupBy(L.family_label().alias("label")).agg(F.round(F.avg("days"), 1).alias("mean_days"))
    return top(out.withColumnRenamed("label", "family"), k, F.asc("mean_days"), F.asc("family"))


def critical_by_store(star: Star, as_of: dt.date, filters: Filters = NONE, k: int = 20) -> DataFrame:
    """Per store, the share of selling items with less than a week of stock; all stores are compared."""
    stock = (base.stock_rows(star, NONE, positive=False).groupBy("item_id", "store")
             .agg(F.greatest(F.sum("qty"), F.lit(0)).alias("stock")))
    pace = velocity(star, as_of, True, "store")
    cover = (stock.join(pace, ["item_id", "store"]).join(base.active_items(star, filters, FILTERS).select("item_id"), "item_id")
             .withColumn("days", M.coverage_days("stock", "units")))
    out = cover.groupBy("store").agg(M.percent(F.count_if(F.col("days") < CRITICAL), F.count(F.lit(1))).alias("critical_pct"))
    return top(out, k, F.desc("critical_pct"), F.asc("store"))


def overstock(star: Star, as_of: dt.date, filters: Filters = NONE, k: int = 50) -> DataFrame:
    cover = item_coverage(star, as_of, filters).where((F.col("days") > OVERSTOCK) & (F.col("days") < CAP))
    return top(cover.select("item_id", *_columns("stock")), k, F.desc("coverage_days"), F.asc("item_id"))
