"""Snapshots kept as intervals: a row is stored when it changes, and any day can be read back.

An interval holds a key's values from ``valid_from`` up to, and without, ``valid_to``; NULL means that it still holds.
A new snapshot is compared with the open intervals only.  Keys that the snapshot does not name are closed.  Storage so
grows with changes, not with days times keys.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_intervals(snapshot: DataFrame, day: dt.date) -> DataFrame:
    """A history that begins with one snapshot."""
    return snapshot.withColumns({"valid_from": F.lit(day), "valid_to": F.lit(None).cast("date")})


def changed_intervals(open_rows: DataFrame, snapshot: DataFrame, day: dt.date, keys: Iterable[str]) -> DataFrame:
    """The intervals that end on ``day`` and, without ``valid_to``, those that are open after it, from one pass.

    Both sides meet in one grouping by key (NULL is a value like any other), which holds a key at most once on each side.
    Taking the same snapshot again changes nothing.
    """
    keys = list(keys)
    values = [c for c in snapshot.columns if c not in keys]
    was, now = F.struct(*values, "valid_from"), F.struct(*values)
    both = open_rows.select(*keys, was.alias("_was"), F.lit(None).cast(snapshot.select(now.alias("x")).schema["x"].dataType).alias("_now")).unionByName(
        snapshot.select(*keys, F.lit(None).cast(open_rows.select(was.alias("x")).schema["x"].dataType).alias("_was"), now.alias("_now")))
    met = both.groupBy(*keys).agg(F.max("_was").alias("_was"), F.max("_now").alias("_now"))
    same = F.col("_was").isNotNull() & F.col("_now").isNotNull()
    for c in values:
        same &= F.col(f"_was.{c}").eqNullSafe(F.col(f"_now.{c}"))
    since, today = F.col("_was.valid_from"), F.lit(day)
    # an interval that would be empty, since its snapshot is taken again on its day, never was
    ended = F.when(F.col("_was").isNotNull() & ~F.col("_same") & (since < today), F.struct(
        *[F.col(f"_was.{c}").alias(c) for c in values], since.alias("valid_from"), today.alias("valid_to")))
    lasting = F.when(F.col("_now").isNotNull(), F.struct(
        *[F.col(f"_now.{c}").alias(c) for c in values], F.when(F.col("_same"), since).otherwise(today).alias("valid_from"),
        F.lit(None).cast("date").alias("valid_to")))
    return met.withColumn("_same", same).select(*keys, F.inline(F.array_compact(F.array(ended, lasting)))).select(*open_rows.columns)


def next_intervals(open_rows: DataFrame, snapshot: DataFrame, day: dt.date, keys: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """The intervals that end on ``day`` and those that are open after it."""
    rows = changed_intervals(open_rows, snapshot, day, keys)
    return rows.where("valid_to IS NOT NULL"), rows.where("valid_to IS NULL")


def as_of(history: DataFrame, day: dt.date) -> DataFrame:
    """The snapshot of a day."""
    rows = history.where((F.col("valid_from") <= F.lit(day)) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(day))))
    return rows.drop("valid_from", "valid_to")
