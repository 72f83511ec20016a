"""Checks of feeds, and the Column forms of the period steps."""

import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from lonja.functions import periods as T
from lonja.functions.periods import Range
from lonja.model import SPECS
from lonja.operators import checks

AS_OF = dt.date(2024, 2, 29)


def test_key_report_counts_absent_and_repeated_keys(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), (" ", 1), (None, 1), (None, 1), ("b", None)], "k string, n int")
    empty = df.limit(0)
    assert rows(checks.key_report({"x": (df, ["k", "n"]), "y": (empty, ["k"])})) == [("x", 7, 4, 1), ("y", 0, 0, 0)]
    with pytest.raises(ValueError):
        checks.key_report({"x": (df, ["z"])})


def test_conversion_report(spark):
    df = spark.createDataFrame([("1.5", "x", True), ("word", None, False), (None, "y", None), ("99999999999999999999", "z", True)], "Amount string, shop string, other boolean")
    out = {r["target"]: tuple(r)[2:] for r in checks.conversion_report(
        df, {"amount": "net", "shop": "store", "gone": "hour", "other": "colour"}, SPECS["tickets"]).collect()}
    assert out == {"net": (True, True, 3, 2), "store": (True, True, 3, 0), "hour": (False, True, 0, 0), "colour": (True, False, 3, 0)}


def test_described_feeds(spark, rows):
    df = spark.createDataFrame([(1, None), (None, None)], "`a.b` int, t array<string>")
    out = checks.describe_feeds({"ps_x": df, "other": df}, "ps_").select("table", "position", "column", "type", "rows", "filled")
    assert rows(out) == [("ps_x", 0, "a.b", "int", 2, 1), ("ps_x", 1, "t", "array<string>", 2, 0)]
    with pytest.raises(LookupError):
        checks.describe_feeds({"x": df}, "ps_")


def test_period_columns_agree_with_the_driver_forms(spark):
    days = [AS_OF - T.DAY * n for n in (0, 1, 3, 28, 29, 31, 59, 60, 365, 366, 424)]
    spans = {Range(T.start_of(d, u), e) for d, u in itertools.product(days, T.UNITS) for e in (AS_OF, T.end_of(d, u), d, d + T.DAY * 400) if e >= T.start_of(d, u)}
    df = spark.createDataFrame([(r.lo, r.hi) for r in spans], "lo date, hi date")
    for quarter in (False, True):
        unit = T.period_of("lo", "hi", AS_OF, quarter)
        for direction in (-1, 1):
            for r in df.select("lo", "hi", unit.alias("unit"), T.step_range("lo", "hi", direction, AS_OF, unit).alias("to")).collect():
                span = Range(r["lo"], r["hi"])
                assert r["unit"] == T.detect(span, AS_OF, quarter), span
                assert tuple(r["to"]) == T.navigate(span, direction, AS_OF, prefer_quarter=quarter), span
    assert df.where(T.period_of("lo", "hi", AS_OF).isNull()).count() > 0
    one = df.select(T.step_range("lo", "hi", 1, AS_OF, F.lit("month")).alias("to")).collect()
    assert len(one) == len(spans)
