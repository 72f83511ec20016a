"""Reusable row predicates (Columns only, so Catalyst pushes them to the scan)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

GHOST_STORE = "99"


def is_retail_sale(ghost: str = GHOST_STORE) -> Column:
    """A sale in a real store.  A NULL store is dropped by the inequality."""
    return F.col("is_sale") & (F.col("store") != ghost)


def is_retail_return(ghost: str = GHOST_STORE) -> Column:
    return ~F.col("is_sale") & (F.col("store") != ghost)


def in_real_store(ghost: str = GHOST_STORE) -> Column:
    return F.col("store") != ghost


def is_invoice() -> Column:
    return ~F.col("credit_note")


def in_days(column: str, lo: dt.date, hi: dt.date) -> Column:
    """Closed date range ``[lo, hi]``."""
    return F.col(column).between(F.lit(lo), F.lit(hi))


def in_days_until(column: str, lo: dt.date, hi: dt.date) -> Column:
    """Half-open date range ``[lo, hi)``."""
    return (F.col(column) >= F.lit(lo)) & (F.col(column) < F.lit(hi))


def month_key(day: dt.date) -> int:
    return day.year * 100 + day.month


def month_of(column: str) -> Column:
    return F.year(column) * 100 + F.month(column)


def in_months(column: str, lo: dt.date, hi: dt.date) -> Column:
    """YYYYMM range on an integer month column; prunes month partitions."""
    return F.col(column).between(month_key(lo), month_key(hi))


def has_stock(column: str = "qty") -> Column:
    return F.col(column) > 0


def is_stock_incident(column: str = "qty") -> Column:
    return F.col(column) < 0


def is_stocked_out(column: str = "qty") -> Column:
    return F.col(column) == 0


def is_wholesale_ref(column: str = "ref", prefix: str = "M") -> Column:
    return F.coalesce(F.col(column).startswith(prefix), F.lit(False))


def contains_ci(needle: str, *columns: str) -> Column:
    """Case-insensitive containment in any of the columns; wildcards have no meaning."""
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(column)), F.lit(needle.strip().lower())), F.lit(False))
    return hit
