"""Incremental table maintenance as DataFrame -> DataFrame operators; they only build plans (``publish`` writes)."""

from __future__ import annotations

import datetime as dt
import functools
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def delta_filter(df: DataFrame, ts_column: str, watermark: dt.datetime | None, lookback_days: int = 1,
                 include_nulls: bool = False) -> DataFrame:
    """Rows changed on or after the watermark's day minus a lookback.

    The bound is inclusive because change dates carry no time of day.  No watermark means a full read.
    """
    if watermark is None:
        return df
    since = watermark.date() - dt.timedelta(days=lookback_days)
    changed = F.col(ts_column) >= F.lit(since)
    return df.where(changed | F.col(ts_column).isNull() if include_nulls else changed)


def latest_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[str]) -> DataFrame:
    """One row per key, the one with the greatest order columns.

    An aggregate instead of a sorted window: repeats of a hot key are folded before the shuffle.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    # the remaining columns break ties, so that the choice does not depend on the order of arrival
    ties = [c for c in rest if c not in order and not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    newest = F.max_by(F.struct(*rest), F.struct(*order, *ties)) if order or ties else F.any_value(F.struct(*rest))
    if len(order) + len(ties) == len(rest):
        newest = F.max(F.struct(*order, *ties))
    picked = df.groupBy(*keys).agg(newest.alias("_row"))
    return picked.select([F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def join_keys(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str) -> DataFrame:
    """Join on keys among which NULL is a value like any other; the keys of the right side are named ``_key_...``."""
    keys = list(keys)
    named = right.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    # aliases make new columns, so that two frames from one source do not share theirs
    named = named.select(*[F.col(c).alias(c) for c in named.columns])
    same = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])
    return left.join(named, same, how)


def upsert(target: DataFrame, changes: DataFrame, keys: Iterable[str], order: Iterable[str] = ()) -> DataFrame:
    """Insert new keys, overwrite all other columns of known keys.

    Repeated keys within the change set are reduced to one row first, the newest if there is an ``order``.
    With an ``order`` a change that is older than the row of the target loses to it; an equal one wins.  NULL is
    a key value like any other, and the target holds a key once.  A table whose columns are all keys only gains
    the unseen rows.  A small change set is broadcast to the target, which then is not shuffled.
    """
    keys, order = list(keys), list(order)
    if not keys:
        raise ValueError("upsert needs key columns")
    if set(keys) == set(target.columns):
        return insert_ignore(target, changes, keys)
    fresh = latest_per_key(changes.select(*target.columns), keys, order)
    rest = [c for c in target.columns if c not in keys]
    both = join_keys(target, fresh.select(*keys, F.struct(*rest).alias("_new")), keys, "left")
    taken = F.col("_new").isNotNull()
    if order:
        taken &= ~F.coalesce(F.struct(*order) > F.struct(*(F.col(f"_new.{c}").alias(c) for c in order)), F.lit(False))
    updated = both.select([F.col(c) if c in keys else F.when(taken, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])
    return updated.unionByName(join_keys(fresh, target.select(*keys), keys, "left_anti"))


def insert_ignore(target: DataFrame, rows: DataFrame, keys: Iterable[str], order: Iterable[str] = ()) -> DataFrame:
    """Add rows with unseen keys, one for each; existing rows never change.  NULL is a key value like any other."""
    keys = list(keys)
    fresh = latest_per_key(rows.select(*target.columns), keys, list(order))
    return target.unionByName(join_keys(fresh, target.select(*keys), keys, "left_anti"))


def replace_children(lines: DataFrame, changed_parents: DataFrame, new_lines: DataFrame, parent_key: str) -> DataFrame:
    """Lines carry no change date: drop the lines of changed parents and take theirs from the re-read."""
    parents = changed_parents.select(parent_key).distinct()
    kept = lines.join(parents, parent_key, "left_anti")
    fresh = new_lines.join(parents, parent_key, "left_semi")
    return kept.select(*lines.columns).unionByName(fresh.select(*lines.columns))
