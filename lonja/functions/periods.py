"""Calendar arithmetic: driver-side ranges (they become literals) and Column forms."""

from __future__ import annotations

import calendar
import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = dt.timedelta(days=1)
UNITS = ("day", "week", "month", "quarter", "year")


class Range(NamedTuple):
    """Closed date range."""

    lo: dt.date
    hi: dt.date

    @property
    def days(self) -> int:
        return (self.hi - self.lo).days + 1


def add_months(day: dt.date, n: int) -> dt.date:
    """Month arithmetic that clamps to the last day (Feb 29 minus a year is Feb 28)."""
    year, month0 = divmod(day.year * 12 + day.month - 1 + n, 12)
    return dt.date(year, month0 + 1, min(day.day, calendar.monthrange(year, month0 + 1)[1]))


def start_of(day: dt.date, unit: str) -> dt.date:
    if unit == "day":
        return day
    if unit == "week":
        return day - DAY * day.weekday()
    first_month = {"month": day.month, "quarter": (day.month - 1) // 3 * 3 + 1, "year": 1}[unit]
    return dt.date(day.year, first_month, 1)


def step(day: dt.date, unit: str, n: int) -> dt.date:
    if unit in ("day", "week"):
        return day + DAY * n * (7 if unit == "week" else 1)
    return add_months(day, n * {"month": 1, "quarter": 3, "year": 12}[unit])


def end_of(day: dt.date, unit: str) -> dt.date:
    return step(start_of(day, unit), unit, 1) - DAY


def preset(name: str, as_of: dt.date) -> Range:
    """today, last_7_days, last_30_days, current_month, last_month, year_to_date."""
    if name.startswith("last_") and name.endswith("_days"):
        return Range(as_of - DAY * (int(name.split("_")[1]) - 1), as_of)
    if name == "last_month":
        return previous_period("month", as_of)
    unit = {"today": "day", "current_month": "month", "year_to_date": "year"}[name]
    return current_period(unit, as_of)


def current_period(unit: str, as_of: dt.date) -> Range:
    """The period in progress; it ends today."""
    return Range(start_of(as_of, unit), as_of)


def previous_period(unit: str, as_of: dt.date) -> Range:
    """The last completed period, in full."""
    last_day = start_of(as_of, unit) - DAY
    return Range(start_of(last_day, unit), last_day)


def closed_week(as_of: dt.date) -> Range:
    """Monday and Sunday of the last completed ISO week."""
    return previous_period("week", as_of)


def detect(r: Range, as_of: dt.date, prefer_quarter: bool = False) -> str | None:
    """Name the calendar period a range covers, complete or in progress; None for a custom range."""

    def complete(unit: str) -> bool:
        return r.lo == start_of(r.lo, unit) and r.hi == end_of(r.lo, unit)

    def running(unit: str) -> bool:
        return r.hi == as_of and r.lo == start_of(as_of, unit)

    if r.lo == r.hi:
        return "day"
    if complete("week") or running("week"):
        return "week"
    if prefer_quarter and running("quarter"):
        return "quarter"
    return next((u for u in ("month", "quarter", "year") if complete(u) or running(u)), None)


def navigate(r: Range, direction: int, as_of: dt.date, unit: str | None = None,
             prefer_quarter: bool = False) -> Range:
    """Step one period back or forward; stepping into the running period stops at today."""
    unit = unit or detect(r, as_of, prefer_quarter)
    if unit is None:
        return r
    lo = step(r.lo if unit in ("day", "week") else r.lo.replace(day=1), unit, direction)
    if unit == "day":
        return Range(lo, lo)
    hi = step(lo, unit, 1) - DAY
    return Range(lo, as_of if hi > as_of >= lo else hi)


def comparison(r: Range, kind: str) -> Range | None:
    """previous_period, previous_month, previous_quarter, previous_year, yoy; None for none/custom."""
    if kind == "previous_period":
        return Range(r.lo - DAY * r.days, r.lo - DAY)
    if kind in ("previous_month", "previous_quarter", "previous_year"):
        return previous_period(kind.removeprefix("previous_"), r.lo)
    if kind == "yoy":
        return Range(add_months(r.lo, -12), add_months(r.hi, -12))
    return None


def year_before(r: Range) -> Range:
    return comparison(r, "yoy")


def long_view(r: Range, months_back: int) -> Range:
    """Extend a range backwards so that it covers at least ``months_back`` whole months before its end."""
    return Range(min(r.lo, add_months(start_of(r.hi, "month"), -months_back)), r.hi)


# --- Column forms -------------------------------------------------------------------------------


def week_start(column: Column | str) -> Column:
    return F.date_trunc("week", column).cast("date")


def month_start(column: Column | str) -> Column:
    return F.trunc(column, "month")


def iso_year(column: Column | str) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.extract(F.lit("YEAROFWEEK"), c)


def same_iso_week_last_year(monday: Column | str) -> Column:
    """Monday of the same ISO week number one ISO year earlier.

    An ISO year without week 53 maps to week 1 of the following year.
    """
    c = F.col(monday) if isinstance(monday, str) else monday
    jan4 = F.make_date(iso_year(c) - 1, F.lit(1), F.lit(4))
    return F.date_add(week_start(jan4), (F.weekofyear(c) - 1) * 7)


def _step(day: Column, unit: str, n: int) -> Column:
    days = {"day": 1, "week": 7}.get(unit)
    return F.date_add(day, days * n) if days else F.add_months(day, n * {"month": 1, "quarter": 3, "year": 12}[unit]).cast("date")


def _start(day: Column, unit: str) -> Column:
    return day if unit == "day" else F.trunc(day, unit)


def period_of(lo: Column | str, hi: Column | str, as_of: dt.date, prefer_quarter: bool = False) -> Column:
    """Column form of :func:`detect`: the calendar period that a range of a row covers, NULL for a custom one."""
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    today = F.lit(as_of)

    def running(unit: str) -> Column:
        return (hi == today) & (lo == _start(today, unit))

    def covers(unit: str) -> Column:
        return running(unit) | ((lo == _start(lo, unit)) & (hi == F.date_sub(_step(_start(lo, unit), unit, 1), 1)))

    name = F.when(lo == hi, "day").when(covers("week"), "week")
    if prefer_quarter:
        name = name.when(running("quarter"), "quarter")
    for unit in ("month", "quarter", "year"):
        name = name.when(covers(unit), unit)
    return name


def step_range(lo: Column | str, hi: Column | str, direction: int, as_of: dt.date, unit: Column | None = None) -> Column:
    """Column form of :func:`navigate`: a struct (lo, hi) one period away; a range of no period stays as it is."""
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    unit = period_of(lo, hi, as_of) if unit is None else unit

    def moved(name: str) -> Column:
        first = _step(lo if name in ("day", "week") else F.trunc(lo, "month"), name, direction)
        last = F.date_sub(_step(first, name, 1), 1)
        running = (last > F.lit(as_of)) & (first <= F.lit(as_of))
        return F.struct(first.alias("lo"), F.when(running, F.lit(as_of)).otherwise(last).alias("hi"))

    out = F.when(unit == UNITS[0], moved(UNITS[0]))
    for name in UNITS[1:]:
        out = out.when(unit == name, moved(name))
    return out.otherwise(F.struct(lo.alias("lo"), hi.alias("hi")))


def season_start(code: Column | str) -> Column:
    """First day of a season code: PVyy starts Feb 1, OIyy starts Sep 1; NULL when invalid."""
    kind, year = _season_parts(code)
    return F.when(kind == "PV", F.make_date(year, F.lit(2), F.lit(1))).when(
        kind == "OI", F.make_date(year, F.lit(9), F.lit(1)))


def season_end(code: Column | str) -> Column:
    kind, year = _season_parts(code)
    return F.when(kind == "PV", F.make_date(year, F.lit(8), F.lit(31))).when(
        kind == "OI", F.make_date(year + 1, F.lit(1), F.lit(31)))


def _season_parts(code: Column | str) -> tuple[Column, Column]:
    clean = F.upper(F.trim(code))
    valid = F.when(clean.rlike("^(PV|OI)[0-9]{2}$"), clean)
    return F.left(valid, F.lit(2)), F.right(valid, F.lit(2)).cast("int") + 2000


# --- Calendar spines ----------------------------------------------------------------------------


def spine(spark: SparkSession, name: str, lo: dt.date, hi: dt.date, unit: str = "day") -> DataFrame:
    """One row per day, week or month.  Its size is fixed by the calendar, not by the data."""
    every = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month"}[unit]
    bounds = F.sequence(F.lit(lo), F.lit(hi), F.expr(every))
    return spark.range(0, 1, 1, 1).select(F.explode(bounds).alias(name))


def constants(spark: SparkSession, rows: Sequence[Sequence], columns: str) -> DataFrame:
    """A few literal rows as a plan constant: no Python data source, and its size is known to the optimizer."""
    fields = [c.split() for c in columns.split(", ")]
    cells = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*cells)))


def hours(spark: SparkSession, name: str = "hour") -> DataFrame:
    return spark.range(0, 1, 1, 1).select(F.explode(F.sequence(F.lit(0), F.lit(23))).alias(name))


def iso_week_last_year(monday: dt.date) -> dt.date:
    """Driver-side twin of :func:`same_iso_week_last_year`."""
    year, week, _ = monday.isocalendar()
    return start_of(dt.date(year - 1, 1, 4), "week") + DAY * 7 * (week - 1)
