"""Home view: everything one day's page shows.

Most figures come from one roll-up, sales per store and day.  It is small (stores times
days) whatever the number of tickets, and partial aggregation builds it next to the scan, so a
hot store costs nothing extra.  Line-level margins use the same roll-up at line grain.
"""

from __future__ import annotations

import datetime as dt
import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lonja.functions import labels as L
from lonja.functions import metrics as M
from lonja.functions import periods as T
from lonja.functions import predicates as P
from lonja.functions.periods import DAY, Range
from lonja.functions.stats import leading_streak, slope
from lonja.operators.publish import StoredTable
from lonja.operators.ranking import top
from lonja.operators.rollup import ROWS, RollUp
from lonja.plans import base
from lonja.sources.star import Star


# --- the day shown --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Moment:
    """The day shown, and the hour up to which days are compared (None for a closed day)."""

    as_of: dt.date
    cutoff_hour: int | None = None

    @property
    def last_year(self) -> dt.date:
        return T.add_months(self.as_of, -12)


def resolve_day(star: Star, today: dt.date, now_hour: int, requested: dt.date | None = None) -> Moment:
    """Clamp a requested day to the data; by default today if it has sales, else the newest day.

    The cutoff is the earlier of the clock and the last hour seen today.  One row with
    four values reaches the driver.
    """
    sales = star.tickets.where(P.is_retail_sale(star.ghost_store))
    is_today = F.col("sale_date") == F.lit(today)
    row = sales.agg(F.min("sale_date").alias("lo"), F.max("sale_date").alias("hi"), F.count_if(is_today).alias("n"),
                    F.max(F.when(is_today, F.col("hour"))).alias("hour")).first()
    if requested is not None:
        day = min(max(requested, row["lo"] or requested), today)
    else:
        day = today if row["n"] else (row["hi"] or today)
    if day != today or not row["n"]:
        return Moment(day)
    return Moment(day, now_hour if row["hour"] is None else min(now_hour, row["hour"]))


def day_range(star: Star, today: dt.date, requested: dt.date | None = None) -> DataFrame:
    """The same resolution as a one-row frame."""
    sales = star.tickets.where(P.is_retail_sale(star.ghost_store))
    now = F.lit(today)
    seen = sales.agg(F.min("sale_date").alias("first_day"), F.max("sale_date").alias("last_day"),
                     F.count_if(F.col("sale_date") == now).alias("rows_today"))
    if requested is not None:
        day = F.least(F.greatest(F.lit(requested), F.coalesce("first_day", F.lit(requested))), now)
    else:
        day = F.when(F.col("rows_today") > 0, now).otherwise(F.coalesce("last_day", now))
    return seen.withColumn("as_of", day)


# --- roll-ups -------------------------------------------------------------------------------------


def daily(star: Star, window: Column | None = None) -> DataFrame:
    """Sales, tickets and returned amount per store and day."""
    rows = star.tickets.where(P.in_real_store(star.ghost_store))
    if window is not None:
        rows = rows.where(window)
    sale = F.col("is_sale")
    return rows.groupBy("store", "sale_date").agg(
        F.sum(F.when(sale, F.col("net"))).alias("net"), F.count_if(sale).alias("tickets"),
        M.sum_if(~sale, F.abs("net")).alias("returns"))


def store_days() -> RollUp:
    """The cells of :func:`daily` as a roll-up that is kept from changed tickets alone."""
    sale = F.col("is_sale")
    return RollUp(("store", "sale_date", "month"), {
        "net": F.when(sale, F.col("net")), "tickets": F.when(sale, F.lit(1).cast("long")), "returns": F.when(~sale, F.abs("net"))})


#: Stored by month.
STORE_DAYS_SCHEMA = "store string, sale_date date, net decimal(38,2), tickets long, returns decimal(38,2), cell_rows long, cell_batch long, month int"


def with_month(star: Star, tickets: DataFrame) -> DataFrame:
    """Tickets as the roll-up wants them: of real stores, with the month that it is stored by."""
    return tickets.where(P.in_real_store(star.ghost_store)).withColumn("month", P.month_of("sale_date").cast("int"))


def kept_days(table: StoredTable) -> DataFrame:
    """The stored roll-up in the shape of :func:`daily`."""
    rows = table.read().where(F.col(ROWS) > 0)
    return rows.select("store", "sale_date", F.when(F.col("tickets") > 0, F.col("net")).alias("net"), "tickets", "returns")


def _days(star: Star, days: DataFrame | None, window: Column | None = None, sales_only: bool = False) -> DataFrame:
    """Store days from a kept roll-up, if there is one, else from the tickets."""
    if days is None:
        wanted = [w for w in (F.col("is_sale") if sales_only else None, window) if w is not None]
        return daily(star, functools.reduce(lambda a, b: a & b, wanted) if wanted else None)
    days = days if window is None else days.where(window)
    return days.where(F.col("tickets") > 0) if sales_only else days


def daily_margin(star: Star, window: Column) -> DataFrame:
    """Net and cost of sale lines with a positive amount, per store and line date."""
    lines = base.retail_lines(star, window)
    sold = base.with_items(star, base.fold_to_items(lines, "store", "sale_date"), how="left")
    return sold.groupBy("store", "sale_date").agg(F.sum("net").alias("net"), F.sum("cost").alias("cost"))


def _between(r: Range) -> Column:
    return P.in_days("sale_date", r.lo, r.hi)


def _any(ranges: list[Range]) -> Column:
    out = _between(ranges[0])
    for r in ranges[1:]:
        out = out | _between(r)
    return out


def period_windows(as_of: dt.date) -> dict[str, tuple[Range, Range, Range]]:
    """Per period: so far, the previous one, last year so far.

    A running week or month is compared with the whole previous one; the year has no
    previous period besides last year's.
    """
    ly = T.add_months(as_of, -12)
    out = {"day": (Range(as_of, as_of), Range(as_of - DAY, as_of - DAY), Range(ly, ly))}
    for unit in ("week", "month", "year"):
        out[unit] = (T.current_period(unit, as_of), T.previous_period(unit, as_of), T.current_period(unit, ly))
    now, _, before = out["year"]
    out["year"] = (now, before, before)
    return out


# --- hero and intraday ----------------------------------------------------------------------------


def _until(cutoff: int | None) -> Column:
    return F.lit(True) if cutoff is None else F.coalesce(F.col("hour") <= cutoff, F.lit(False))


def hero(star: Star, m: Moment) -> DataFrame:
    """Today against yesterday and last year up to the same hour.

    When nothing of the other day falls before the cutoff its full amount is used.
    """
    days = {"today": m.as_of, "yesterday": m.as_of - DAY, "last_year": m.last_year}
    rows = base.retail_tickets(star, None).where(F.col("sale_date").isin(*days.values()))
    on = {name: F.col("sale_date") == F.lit(day) for name, day in days.items()}
    sums = rows.agg(M.sum_if(on["today"], "net").alias("today"),
                    *[M.sum_if(on[d], "net").alias(f"{d}_full") for d in ("yesterday", "last_year")],
                    *[M.sum_if(on[d] & _until(m.cutoff_hour), "net").alias(f"{d}_cut") for d in ("yesterday", "last_year")])
    for d in ("yesterday", "last_year"):
        cut, full = F.col(f"{d}_cut"), F.col(f"{d}_full")
        sums = sums.withColumn(f"{d}_base", F.when((cut == 0) & (full > 0), full).otherwise(cut))
    return sums.select("today", "yesterday_full", "last_year_full", "yesterday_base", "last_year_base",
                       M.change_ratio("today", "yesterday_base").alias("vs_yesterday"),
                       M.change_ratio("today", "last_year_base").alias("vs_last_year"))


def hourly_curve(star: Star, m: Moment, now_hour: int | None = None) -> DataFrame:
    """Running sales by hour for the day and for the same weekday a week before; future hours are NULL.

    A day without a single timed ticket has no curve at all.
    """
    before = m.as_of - DAY * 7
    rows = (base.retail_tickets(star, None).where("hour IS NOT NULL")
            .where(F.col("sale_date").isin(m.as_of, before)).groupBy("hour").agg(
                F.sum(F.when(F.col("sale_date") == F.lit(m.as_of), F.col("net"))).alias("now"),
                F.sum(F.when(F.col("sale_date") == F.lit(before), F.col("net"))).alias("then")))
    so_far = W.orderBy("hour").rowsBetween(W.unboundedPreceding, 0)   # 24 rows
    everything = W.orderBy("hour").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    curve = T.hours(star.spark).join(rows, "hour", "left").select(
        "hour", F.coalesce(F.sum("now").over(so_far), F.lit(0)).alias("now"),
        F.coalesce(F.sum("then").over(so_far), F.lit(0)).alias("then"),
        F.count("now").over(everything).alias("has_now"), F.count("then").over(everything).alias("has_then"))
    past = F.lit(True) if now_hour is None else F.col("hour") <= now_hour
    return curve.select("hour", F.when((F.col("has_now") > 0) & past, F.col("now")).alias("sales"),
                        F.when(F.col("has_then") > 0, F.col("then")).alias("week_before")).orderBy("hour")


def day_operations(star: Star, m: Moment) -> DataFrame:
    """Tickets, average ticket and return rate of the day and of the day before up to the same hour."""
    yesterday = m.as_of - DAY
    rows = base.retail_tickets(star, Range(yesterday, m.as_of), returns=None)
    sale = F.col("is_sale")
    now = F.col("sale_date") == F.lit(m.as_of)
    then = (F.col("sale_date") == F.lit(yesterday)) & _until(m.cutoff_hour)
    sums = rows.agg(
        F.count_if(sale & now).alias("tickets"), M.sum_if(sale & now, "net").alias("net"),
        M.sum_if(~sale & now, F.abs("net")).alias("returns"), F.count_if(sale & then).alias("tickets_before"),
        M.sum_if(sale & then, "net").alias("net_before"), M.sum_if(~sale & then, F.abs("net")).alias("returns_before"))
    avg, avg_before = M.ratio("net", "tickets"), M.ratio("net_before", "tickets_before")
    return sums.select("*", F.coalesce(avg, F.lit(0.0)).alias("avg_ticket"),
                       M.change_ratio_or_null(avg, F.coalesce(avg_before, F.lit(0.0))).alias("avg_ticket_change"),
                       M.change_ratio_or_null("tickets", "tickets_before").alias("tickets_change"),
                       F.when(F.col("net") > 0, M.ratio("returns", "net")).otherwise(0.0).alias("return_rate"))


# --- period cards ---------------------------------------------------------------------------------


def _cards(columns: list[Column]) -> Column:
    return F.explode(F.array(*columns)).alias("card")


def period_cards(star: Star, as_of: dt.date) -> DataFrame:
    """Day, week, month and year: value, previous, last year and both changes."""
    windows = period_windows(as_of)
    rows = daily(star, F.col("is_sale") & _any([w for three in windows.values() for w in three]))
    sums = rows.agg(*[M.sum_if(_between(w), "net").alias(f"{unit}_{i}")
                      for unit, three in windows.items() for i, w in enumerate(three)])
    cards = [F.struct(F.lit(unit).alias("period"), *[F.col(f"{unit}_{i}").cast("decimal(38,2)").alias(n)
                                                     for i, n in enumerate(("value", "previous", "last_year"))])
             for unit in windows]
    return sums.select(_cards(cards)).select("card.*").select(
        "*", M.change_ratio("value", "previous").alias("vs_previous"),
        M.change_ratio_or_null("value", "last_year").alias("vs_last_year"))


SERIES = {"day": ("day", 6), "week": ("week", 5), "month": ("month", 4), "year": ("month", None)}


def _series_start(as_of: dt.date, name: str) -> dt.date:
    unit, back = SERIES[name]
    return T.start_of(as_of, "year") if back is None else T.step(T.start_of(as_of, unit), unit, -back)


def _bucket(unit: str) -> Column:
    return F.col("sale_date") if unit == "day" else T.week_start("sale_date") if unit == "week" else T.month_start("sale_date")


def _series(star: Star, per_day: DataFrame, as_of: dt.date, names: list[str]) -> DataFrame:
    """Zero-filled buckets of every card from one pass over a per-day frame.

    Each day is stamped with its bucket in every series, so buckets meet by equality, not by range.
    """
    calendar = []
    for name, (unit, _) in SERIES.items():
        bucket, last = _series_start(as_of, name), T.start_of(as_of, unit)
        while bucket <= last:
            calendar.append((name, bucket))
            bucket = T.step(bucket, unit, 1)
    stamps = F.array(*[F.struct(F.lit(n).alias("series"), _bucket(unit).alias("bucket")) for n, (unit, _) in SERIES.items()])
    sums = (per_day.withColumn("stamp", F.explode(stamps)).groupBy("stamp.series", "stamp.bucket")
            .agg(*[F.sum(c).alias(c) for c in names]))
    frame = T.constants(star.spark, calendar, "series string, bucket date")
    return frame.join(sums, ["series", "bucket"], "left").select(
        "series", "bucket", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def first_series_day(as_of: dt.date) -> dt.date:
    return min(_series_start(as_of, name) for name in SERIES)


def sales_series(star: Star, as_of: dt.date) -> DataFrame:
    """Last 7 days, 6 weeks, 5 months and the months of the year."""
    window = F.col("is_sale") & P.in_days("sale_date", first_series_day(as_of), T.end_of(as_of, "month"))
    per_day = daily(star, window).groupBy("sale_date").agg(F.sum("net").alias("value"))
    return _series(star, per_day, as_of, ["value"])


def trends(series: DataFrame) -> DataFrame:
    """Direction of each series: slope over mean beyond two percent; a single point is flat."""
    # position inside the series: its buckets are few and fixed by the calendar
    ranked = series.withColumn("x", F.row_number().over(W.partitionBy("series").orderBy("bucket")) - 1)
    fitted = ranked.groupBy("series").agg(slope("value", "x").alias("slope"), F.avg(F.col("value").cast("double")).alias("mean"),
                                          F.count(F.lit(1)).alias("points"))
    return fitted.select("series", "points", M.trend_direction("slope", "mean").alias("direction"))


def margin_cards(star: Star, as_of: dt.date) -> DataFrame:
    """Margin share of day, week, month and year with changes in points."""
    windows = period_windows(as_of)
    sold = daily_margin(star, _any([w for three in windows.values() for w in three]))
    sums = sold.agg(*[M.sum_if(_between(w), c).cast("decimal(38,4)").alias(f"{unit}_{i}_{c}")
                      for unit, three in windows.items() for i, w in enumerate(three) for c in ("net", "cost")])
    cards = [F.struct(F.lit(unit).alias("period"),
                      *[M.margin_share(f"{unit}_{i}_net", f"{unit}_{i}_cost").alias(n)
                        for i, n in enumerate(("margin", "previous", "last_year"))]) for unit in windows]
    return sums.select(_cards(cards)).select("card.*").select(
        "*", F.coalesce(F.col("margin") - F.col("previous"), F.lit(0.0)).alias("vs_previous_points"),
        (F.col("margin") - F.col("last_year")).alias("vs_last_year_points"))


def margin_series(star: Star, as_of: dt.date) -> DataFrame:
    window = P.in_days("sale_date", first_series_day(as_of), T.end_of(as_of, "month"))
    per_day = daily_margin(star, window).groupBy("sale_date").agg(F.sum("net").alias("net"), F.sum("cost").alias("cost"))
    filled = _series(star, per_day, as_of, ["net", "cost"])
    return filled.select("series", "bucket", F.coalesce(M.margin_share("net", "cost"), F.lit(0.0)).alias("margin"))


def month_margins(star: Star, as_of: dt.date) -> DataFrame:
    """Margin share of this month so far and of the whole previous month, and the change in points."""
    now, before = T.current_period("month", as_of), T.previous_period("month", as_of)
    sums = daily_margin(star, _any([now, before])).agg(
        *[M.sum_if(_between(w), c).alias(f"{n}_{c}") for n, w in (("now", now), ("before", before)) for c in ("net", "cost")])
    return sums.select(F.coalesce(M.margin_share("now_net", "now_cost"), F.lit(0.0)).alias("margin"),
                       F.coalesce(M.margin_share("before_net", "before_cost"), F.lit(0.0)).alias("margin_before")).select(
        "*", (F.col("margin") - F.col("margin_before")).alias("points"))


def store_margins(star: Star, as_of: dt.date) -> DataFrame:
    sold = daily_margin(star, _between(Range(as_of, as_of)))
    return sold.select("store", "net", "cost", M.margin_share("net", "cost").alias("margin")).where("net > 0")


# --- streaks --------------------------------------------------------------------------------------


def _streak_weeks(as_of: dt.date, weeks: int) -> list[tuple[int, dt.date, dt.date]]:
    """(position from newest, Monday, Monday of the same ISO week last year) of the closed weeks."""
    this_week = T.start_of(as_of, "week")
    mondays = [this_week - DAY * 7 * i for i in range(1, weeks + 1)]
    return [(i, monday, T.iso_week_last_year(monday)) for i, monday in enumerate(mondays, 1)]


def weekly_pairs(star: Star, as_of: dt.date, *by: str, weeks: int = 16, days: DataFrame | None = None) -> DataFrame:
    """Sales of each closed week next to the same ISO week of last year (zero where nothing was sold).

    With ``by``, groups that sold in the last 30 days.  One pass: a group's weeks fold into a map, which holds no more
    than the weeks of the window.
    """
    calendar = _streak_weeks(as_of, weeks)
    mondays, twins = [c[1] for c in calendar], [c[2] for c in calendar]
    window = _any([Range(min(mondays), max(mondays) + DAY * 6), Range(min(twins), max(twins) + DAY * 6)])
    recent = P.in_days("sale_date", as_of - DAY * 30, as_of)
    per_week = (_days(star, days, window | recent if by else window, sales_only=True).withColumn("week", T.week_start("sale_date"))
                .groupBy("week", *by).agg(F.sum("net").alias("net"), F.bool_or(recent).alias("live")))
    folded = per_week.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("week", "net"))).alias("weeks"), F.bool_or("live").alias("live"))
    pairs = F.array(*[F.struct(
        F.lit(position).alias("position"), F.lit(monday).alias("week"), *[
            F.coalesce(F.col("weeks")[F.lit(day)], F.lit(0)).alias(n) for n, day in (("now", monday), ("last_year", twin))])
        for position, monday, twin in calendar])
    return (folded.where("live") if by else folded).select(*by, F.inline(pairs))


def _declined() -> Column:
    return (F.col("last_year") > 0) & (F.col("now") < F.col("last_year"))


def business_streak(star: Star, as_of: dt.date, weeks: int = 16) -> DataFrame:
    """Closed weeks in a row below last year's same ISO week."""
    return weekly_pairs(star, as_of, weeks=weeks).agg(leading_streak(F.col("position"), ~_declined()).alias("streak_weeks"))


def store_streaks(star: Star, as_of: dt.date, weeks: int = 16, days: DataFrame | None = None) -> DataFrame:
    return weekly_pairs(star, as_of, "store", weeks=weeks, days=days).groupBy("store").agg(
        leading_streak(F.col("position"), ~_declined()).alias("streak_weeks"))


# --- calendar and stores --------------------------------------------------------------------------


def month_calendar(star: Star, as_of: dt.date) -> DataFrame:
    """Every day of the month: sales (NULL in the future) and last year's sales of the same date."""
    month = Range(T.start_of(as_of, "month"), T.end_of(as_of, "month"))
    ly = T.year_before(month)
    per_day = daily(star, F.col("is_sale") & _any([month, ly])).groupBy("sale_date").agg(F.sum("net").alias("net"))
    days = T.spine(star.spark, "day", month.lo, month.hi).withColumn("day_ly", F.add_months("day", -12))
    now, then = per_day.select(F.col("sale_date").alias("day"), F.col("net").alias("now")), \
        per_day.select(F.col("sale_date").alias("day_ly"), F.col("net").alias("then"))
    filled = days.join(now, "day", "left").join(then, "day_ly", "left")
    return filled.select(F.dayofmonth("day").alias("day_num"),
                         F.when(F.col("day") <= F.lit(as_of), F.coalesce("now", F.lit(0))).alias("sales"),
                         F.coalesce("then", F.lit(0)).alias("last_year")).orderBy("day_num")


def last_sales(star: Star, days: DataFrame | None = None) -> DataFrame:
    """Day of the last sale of each store over all history; from a kept roll-up no ticket is read."""
    if days is not None:
        return days.where(F.col("tickets") > 0).groupBy("store").agg(F.max("sale_date").alias("last_sale"))
    return star.tickets.where(P.is_retail_sale(star.ghost_store)).groupBy("store").agg(F.max("sale_date").alias("last_sale"))


def scorecard(star: Star, as_of: dt.date, days: DataFrame | None = None) -> DataFrame:
    """One row per store: day, 7-day mean, 30-day total, last sale, last year, return rate.

    The 7-day mean is over the days that had sales.  One pass over the tickets (the last sale
    needs all of history), folded by day before anything else; with a kept roll-up (``days``) none.
    """
    ly = T.add_months(as_of, -12)
    on, week = F.col("sale_date") == F.lit(as_of), P.in_days_until("sale_date", as_of - DAY * 7, as_of)
    sold = F.col("tickets") > 0
    rows = _days(star, days).groupBy("store").agg(
        M.sum_if(on, "net").alias("sales"), F.coalesce(F.sum(F.when(on, F.col("tickets"))), F.lit(0)).alias("tickets"),
        F.coalesce(M.ratio(M.sum_if(week & sold, "net"), F.count_if(week & sold)), F.lit(0.0)).alias("avg7"),
        M.sum_if(P.in_days("sale_date", as_of - DAY * 30, as_of), "net").alias("total_30d"),
        F.max(F.when(sold, F.col("sale_date"))).alias("last_sale"),
        F.sum(F.when(F.col("sale_date") == F.lit(ly), F.col("net"))).alias("sales_ly"),
        F.sum(F.when(on, F.col("returns"))).alias("returns"))
    zero = F.lit(0)
    return star.stores.where(P.in_real_store(star.ghost_store)).join(rows, "store", "left").select(
        "store", L.store_label().alias("label"), F.coalesce("sales", zero).alias("sales"),
        F.coalesce("tickets", zero).alias("tickets"), F.coalesce("avg7", F.lit(0.0)).alias("avg7"),
        F.coalesce("total_30d", zero).alias("total_30d"), "last_sale", "sales_ly",
        M.ratio("returns", "sales").alias("returns_rate"))


def store_board(star: Star, as_of: dt.date, days: DataFrame | None = None) -> DataFrame:
    """The scorecard with changes, margin, streak and traffic light; inactive stores are marked.

    With a kept roll-up tickets are read for the margins of the window only.
    """
    cards = (scorecard(star, as_of, days).join(store_streaks(star, as_of, days=days), "store", "left")
             .join(store_margins(star, as_of).select("store", "margin"), "store", "left"))
    delta = F.when(F.col("avg7") > 0, M.ratio("sales", "avg7") - 1).otherwise(0.0)
    return cards.select(
        "store", "label", "sales", "tickets", F.coalesce(M.ratio("sales", "tickets"), F.lit(0.0)).alias("avg_ticket"),
        delta.alias("delta"), M.change_ratio_or_null("sales", "sales_ly").alias("delta_yoy"),
        F.coalesce("streak_weeks", F.lit(0)).alias("streak_weeks"), "margin", "returns_rate", "last_sale",
        (F.col("total_30d") > 0).alias("is_active")).withColumn(
        "status", M.traffic_light("delta", "delta_yoy", "streak_weeks"))


def store_sparks(star: Star, as_of: dt.date) -> DataFrame:
    """Seven values per store, oldest first."""
    days = T.spine(star.spark, "sale_date", as_of - DAY * 6, as_of)
    rows = daily(star, F.col("is_sale") & P.in_days("sale_date", as_of - DAY * 6, as_of))
    grid = star.stores.where(P.in_real_store(star.ghost_store)).select("store").crossJoin(F.broadcast(days))
    filled = grid.join(rows, ["store", "sale_date"], "left")
    value = F.coalesce("net", F.lit(0)).cast("decimal(38,2)")
    return filled.groupBy("store").agg(F.transform(F.array_sort(F.collect_list(F.struct("sale_date", value.alias("v")))),
                                                   lambda p: p["v"]).alias("spark"))


def network_return_rate(star: Star, as_of: dt.date, days: DataFrame | None = None) -> DataFrame:
    """Return rate of the last 30 days over all stores."""
    rows = _days(star, days, P.in_days("sale_date", as_of - DAY * 29, as_of))
    return rows.agg(M.ratio(F.sum("returns"), M.total("net")).alias("network_rate"))


def return_outliers(star: Star, as_of: dt.date, margin: float = 0.01, days: DataFrame | None = None) -> DataFrame:
    """Stores whose return rate of the day is more than one point above the network.

    The network rate is the 30-day one, else the sales-weighted mean of the stores.
    """
    cards = scorecard(star, as_of, days).where("total_30d > 0").select("store", "sales", "returns_rate")
    known = F.col("returns_rate").isNotNull() & (F.col("sales") > 0)
    weighted = cards.agg(M.ratio(F.sum(F.when(known, F.col("returns_rate") * M.dbl("sales"))),
                                 F.sum(F.when(known, F.col("sales")))).alias("weighted"))
    network = base.one_row(network_return_rate(star, as_of, days), weighted).select(
        F.coalesce("network_rate", "weighted").alias("network_rate"))
    return cards.crossJoin(F.broadcast(network)).withColumn(
        "is_outlier", F.coalesce(F.col("returns_rate") > F.col("network_rate") + margin, F.lit(False)))


def pipeline_health(star: Star) -> DataFrame:
    """Last run, feeds that are not ok and the newest watermark."""
    last = star.runs.agg(F.max_by(F.struct("run_id", "status", "started_at", "finished_at", "total_rows"), "run_id").alias("r"))
    feeds = star.watermarks.agg(F.count_if(F.col("status") != "ok").alias("feeds_not_ok"),
                                F.max("last_sync_at").alias("newest_sync"))
    return base.one_row(last.select("r.*"), feeds)


def top_active_stores(star: Star, as_of: dt.date, k: int = 10) -> DataFrame:
    return top(store_board(star, as_of).where("is_active"), k, F.desc("sales"), F.asc("store"))
