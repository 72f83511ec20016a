"""Fixed parameters of the registered queries (results must be reproducible)."""

import datetime as dt

from lonja.functions.periods import Range, closed_week, preset

AS_OF = dt.date(2001, 6, 15)
LAST_30 = preset("last_30_days", AS_OF)          # 2001-05-17 .. 2001-06-15
WEEK = closed_week(AS_OF)                        # 2001-06-04 .. 2001-06-10
YTD = preset("year_to_date", AS_OF)
EVENTS_NOW = dt.datetime(2024, 1, 30, 18, 0, 0)

LO, HI = "DATE '2001-05-17'", "DATE '2001-06-15'"
IN30 = f"BETWEEN {LO} AND {HI}"
LY30 = "BETWEEN DATE '2000-05-17' AND DATE '2000-06-15'"
PREV30 = "BETWEEN DATE '2001-04-17' AND DATE '2001-05-16'"
assert LAST_30 == Range(dt.date(2001, 5, 17), AS_OF) and WEEK.lo == dt.date(2001, 6, 4)


def money_avg(total: str, n: str) -> str:
    """SQL for an amount per count, rounded half up to cents in whole numbers."""
    return f"CASE WHEN {n} > 0 THEN ((2 * CAST({total} * 100 AS HUGEINT) + {n}) // (2 * {n})) / 100.0 END"
