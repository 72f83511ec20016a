import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lonja.functions import periods as T
from lonja.functions import predicates as P
from lonja.functions.periods import Range

D = dt.date
AS_OF = D(2026, 5, 14)   # a Thursday


def test_presets():
    assert T.preset("today", AS_OF) == (AS_OF, AS_OF)
    assert T.preset("last_7_days", AS_OF) == (D(2026, 5, 8), AS_OF)
    assert T.preset("last_30_days", AS_OF) == (D(2026, 4, 15), AS_OF)
    assert T.preset("current_month", AS_OF) == (D(2026, 5, 1), AS_OF)
    assert T.preset("last_month", AS_OF) == (D(2026, 4, 1), D(2026, 4, 30))
    assert T.preset("year_to_date", AS_OF) == (D(2026, 1, 1), AS_OF)


@pytest.mark.parametrize("unit,lo,hi", [("day", D(2026, 5, 13), D(2026, 5, 13)), ("week", D(2026, 5, 4), D(2026, 5, 10)),
                                        ("month", D(2026, 4, 1), D(2026, 4, 30)), ("quarter", D(2026, 1, 1), D(2026, 3, 31)),
                                        ("year", D(2025, 1, 1), D(2025, 12, 31))])
def test_previous_period(unit, lo, hi):
    assert T.previous_period(unit, AS_OF) == (lo, hi)


def test_comparisons():
    r = Range(D(2026, 5, 1), D(2026, 5, 14))
    assert T.comparison(r, "previous_period") == (D(2026, 4, 17), D(2026, 4, 30))
    assert T.comparison(r, "previous_month") == (D(2026, 4, 1), D(2026, 4, 30))
    assert T.comparison(r, "previous_quarter") == (D(2026, 1, 1), D(2026, 3, 31))
    assert T.comparison(r, "previous_year") == (D(2025, 1, 1), D(2025, 12, 31))
    assert T.comparison(r, "yoy") == (D(2025, 5, 1), D(2025, 5, 14))
    assert T.comparison(r, "none") is None and T.comparison(r, "custom") is None
    assert T.comparison(Range(D(2024, 2, 29), D(2024, 2, 29)), "yoy").lo == D(2023, 2, 28)


def test_detect():
    assert T.detect(Range(AS_OF, AS_OF), AS_OF) == "day"
    assert T.detect(Range(D(2026, 5, 11), AS_OF), AS_OF) == "week"
    assert T.detect(Range(D(2026, 5, 4), D(2026, 5, 10)), AS_OF) == "week"
    assert T.detect(Range(D(2026, 5, 1), AS_OF), AS_OF) == "month"
    assert T.detect(Range(D(2026, 4, 1), D(2026, 4, 30)), AS_OF) == "month"
    assert T.detect(Range(D(2026, 4, 1), AS_OF), AS_OF) == "quarter"
    assert T.detect(Range(D(2026, 1, 1), D(2026, 3, 31)), AS_OF) == "quarter"
    assert T.detect(Range(D(2026, 1, 1), AS_OF), AS_OF) == "year"
    assert T.detect(Range(D(2025, 1, 1), D(2025, 12, 31)), AS_OF) == "year"
    assert T.detect(Range(D(2026, 5, 2), AS_OF), AS_OF) is None
    first = D(2026, 4, 10)   # in April the month and the quarter start on the same day
    assert T.detect(Range(D(2026, 4, 1), first), first) == "month"
    assert T.detect(Range(D(2026, 4, 1), first), first, prefer_quarter=True) == "quarter"


def test_navigate():
    assert T.navigate(Range(AS_OF, AS_OF), -1, AS_OF) == (D(2026, 5, 13), D(2026, 5, 13))
    assert T.navigate(Range(D(2026, 5, 4), D(2026, 5, 10)), 1, AS_OF) == (D(2026, 5, 11), AS_OF)
    assert T.navigate(Range(D(2026, 4, 1), D(2026, 4, 30)), 1, AS_OF) == (D(2026, 5, 1), AS_OF)
    assert T.navigate(Range(D(2026, 1, 1), D(2026, 3, 31)), -1, AS_OF) == (D(2025, 10, 1), D(2025, 12, 31))
    assert T.navigate(Range(D(2025, 1, 1), D(2025, 12, 31)), 1, AS_OF) == (D(2026, 1, 1), AS_OF)
    custom = Range(D(2026, 5, 2), D(2026, 5, 5))
    assert T.navigate(custom, 1, AS_OF) == custom
    monday = D(2026, 5, 11)
    assert T.navigate(Range(monday, monday), -1, monday, unit="week") == (D(2026, 5, 4), D(2026, 5, 10))


def test_month_keys():
    assert P.month_key(D(2025, 12, 31)) == 202512 and P.month_key(D(2026, 1, 1)) == 202601


@settings(max_examples=60, deadline=None)
@given(st.dates(D(1990, 1, 1), D(2060, 12, 31)), st.sampled_from(T.UNITS))
def test_period_bounds_hold(day, unit):
    assert T.start_of(day, unit) <= day <= T.end_of(day, unit)
    assert T.detect(Range(T.start_of(day, unit), T.end_of(day, unit)), D(2100, 1, 1)) == unit
    previous = T.previous_period(unit, day)
    assert previous.hi + T.DAY == T.start_of(day, unit)


def test_iso_week_last_year_matches_column_form(spark):
    mondays = [D(2016, 1, 4) + T.DAY * 7 * i for i in range(700)]
    df = spark.createDataFrame([(m,) for m in mondays], "m date")
    got = [r[0] for r in df.select(T.same_iso_week_last_year("m")).collect()]
    assert got == [T.iso_week_last_year(m) for m in mondays]
    assert T.iso_week_last_year(D(2020, 12, 28)) == D(2019, 12, 30)   # week 53 -> week 1 of the next year


def test_season_dates(spark):
    df = spark.createDataFrame([("PV26",), (" oi25 ",), ("XX26",), ("PV2026",), (None,)], "c string")
    got = [tuple(r) for r in df.select(T.season_start("c"), T.season_end("c")).collect()]
    assert got == [(D(2026, 2, 1), D(2026, 8, 31)), (D(2025, 9, 1), D(2026, 1, 31)), (None, None), (None, None), (None, None)]


def test_spines(spark):
    assert T.spine(spark, "d", D(2024, 2, 27), D(2024, 3, 1)).count() == 4
    assert [r[0] for r in T.spine(spark, "m", D(2023, 11, 1), D(2024, 2, 1), "month").collect()] == [
        D(2023, 11, 1), D(2023, 12, 1), D(2024, 1, 1), D(2024, 2, 1)]
    assert T.hours(spark).count() == 24
