"""Metric building blocks as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dbl(value: Column | str) -> Column:
    return _c(value).cast("double")


def total(value: Column | str) -> Column:
    """Sum that is 0 on no rows."""
    return F.coalesce(F.sum(_c(value)), F.lit(0))


def sum_if(condition: Column, value: Column | str) -> Column:
    return F.coalesce(F.sum(F.when(condition, _c(value))), F.lit(0))


def ratio(num: Column | str, den: Column | str) -> Column:
    """num / den as double; NULL when the denominator is 0."""
    den = dbl(den)
    return dbl(num) / F.when(den != 0, den)


def percent(num: Column | str, den: Column | str, digits: int = 1) -> Column:
    return F.round(ratio(num, den) * 100, digits)


def margin_pct(revenue: Column | str, cost: Column | str, digits: int = 1) -> Column:
    return percent(dbl(revenue) - dbl(cost), revenue, digits)


def margin_share(revenue: Column | str, cost: Column | str) -> Column:
    """Margin as a fraction; NULL unless the revenue is positive."""
    return F.when(_c(revenue) > 0, (dbl(revenue) - dbl(cost)) / dbl(revenue))


def change_pct(now: Column | str, before: Column | str, digits: int = 1) -> Column:
    """Growth in percent over the absolute base; NULL without a base."""
    return percent(dbl(now) - dbl(before), F.abs(_c(before)), digits)


def change_ratio(now: Column | str, before: Column | str) -> Column:
    """now / before - 1; 0 without a base."""
    return F.coalesce(ratio(now, before) - 1, F.lit(0.0))


def change_ratio_or_null(now: Column | str, before: Column | str) -> Column:
    return F.when(_c(before) > 0, ratio(now, before) - 1)


def average_ticket(sales: Column | str, tickets: Column | str, digits: int = 2) -> Column:
    """Money per ticket, divided and rounded as decimal so that half cents round up exactly."""
    n = _c(tickets).cast("decimal(14,0)")
    return F.round(_c(sales).cast("decimal(24,2)") / F.when(n != 0, n), digits)


def invoice_net() -> Column:
    """Sum of the three tax bases; a missing base counts as 0."""
    zero = F.lit(0).cast("decimal(15,2)")
    return F.coalesce("base1", zero) + F.coalesce("base2", zero) + F.coalesce("base3", zero)


def invoice_net_strict() -> Column:
    """Sum of the three tax bases; NULL when any base is missing."""
    return F.col("base1") + F.col("base2") + F.col("base3")


def return_rate_of_flow(sales: Column | str, returns: Column | str) -> Column:
    """Returns over the gross flow (sales + returns), percent."""
    return percent(returns, dbl(sales) + dbl(returns))


def return_rate_of_sales(sales: Column | str, returns: Column | str) -> Column:
    """Returns over sales, percent."""
    return percent(returns, sales)


def return_rate_of_tickets(sales_count: Column | str, return_count: Column | str) -> Column:
    """Return tickets per 100 sale tickets."""
    return percent(return_count, sales_count, 2)


def velocity(units: Column | str, days: float = 30.0) -> Column:
    return dbl(units) / days


def coverage_days(stock: Column | str, units: Column | str, days: float = 30.0) -> Column:
    return ratio(stock, velocity(units, days))


def fill_rate(delivered: Column | str, ordered: Column | str) -> Column:
    return percent(F.coalesce(_c(delivered), F.lit(0)), ordered)


def throughput(rows: Column | str, ms: Column | str) -> Column:
    ms = _c(ms)
    return F.round(F.when(ms > 0, dbl(rows) / (dbl(ms) / 1000.0)), 2)


def cache_hit_pct(read: Column | str, prompt: Column | str, written: Column | str) -> Column:
    zero = F.lit(0)
    denominator = F.coalesce(_c(prompt), zero) + F.coalesce(_c(written), zero) + F.coalesce(_c(read), zero)
    return F.when(_c(read).isNotNull() & (denominator > 0), dbl(read) / dbl(denominator) * 100)


def purchase_band(purchases: Column | str) -> Column:
    n = _c(purchases)
    return (F.when(n == 1, "1 compra").when(n.between(2, 3), "2-3 compras")
            .when(n.between(4, 10), "4-10 compras").otherwise("Más de 10"))


def heat_band(yoy_pct: Column | str) -> Column:
    y = _c(yoy_pct)
    return (F.when(y > 10, "strong growth").when(y >= 0, "growth")
            .when(y >= -10, "decline").when(y < -10, "strong decline"))


# Severity ranks of the traffic light.
SEVERITIES = ("ok", "watch", "alert")


def _severity(rank: Column) -> Column:
    return F.when(rank == 2, "alert").when(rank == 1, "watch").otherwise("ok")


def traffic_light(delta_7d: Column | str, delta_yoy: Column | str, streak: Column | str) -> Column:
    """Year-over-year first, 7-day change as fallback; a streak can only raise the level."""
    d7, yoy, weeks = _c(delta_7d), _c(delta_yoy), _c(streak)
    by_yoy = F.when(yoy <= -0.15, 2).when(yoy <= -0.05, 1).otherwise(0)
    by_week = F.when(d7 <= -0.10, 2).when(d7 <= -0.04, 1).otherwise(0)
    by_streak = F.when(weeks >= 5, 2).when(weeks >= 3, 1).otherwise(0)
    return _severity(F.greatest(F.when(yoy.isNotNull(), by_yoy).otherwise(by_week), by_streak))


def trend_direction(slope: Column | str, mean: Column | str, band: float = 0.02) -> Column:
    relative = ratio(slope, mean)
    return F.when(relative > band, "up").when(relative < -band, "down").otherwise("flat")
