"""Statistical functions: anomaly flags, slopes, streaks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z_LIMIT = 2.0
MIN_HISTORY = 4


def anomaly_columns(current: Column, mean: Column, sigma: Column, n: Column,
                    z_limit: float = Z_LIMIT, min_history: int = MIN_HISTORY) -> list[Column]:
    """z-score flags from a current value and its history (population sigma).

    A short or constant history, or a missing current value, is never an anomaly.
    """
    usable = current.isNotNull() & (n >= min_history)
    z = F.when(usable, F.when(sigma > 0, (current - mean) / sigma).otherwise(0.0))
    direction = F.when(z > z_limit, "high").when(z < -z_limit, "low").when(z.isNotNull(), "normal")
    return [z.alias("z_score"), F.coalesce(F.abs(z) > z_limit, F.lit(False)).alias("is_anomaly"),
            direction.alias("direction")]


def anomaly(df: DataFrame, value: str, order: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Compare the newest value of each group with all its older values.

    Two aggregations and no sort: partial aggregation absorbs a hot group.
    """
    v = F.col(value).try_cast("double")   # what is no number is no history
    top = df.groupBy(*keys).agg(F.max(F.struct(F.col(order).alias("o"), v.alias("v"))).alias("_top"))
    latest = top.select(*keys, F.col("_top.o").alias("_newest"), F.col("_top.v").alias("current"))
    # null-safe conditions keep a NULL group, and leave both uses of the input equal down to the scan,
    # so that Spark computes it once
    is_older = F.coalesce(F.col(order) < F.col("_newest"), F.lit(False))
    if not keys:
        older = df.crossJoin(F.broadcast(latest)).where(is_older)
        return _flagged(latest.crossJoin(F.broadcast(_spread(older, v))), ())
    older = _null_safe(df, latest, keys, "inner").where(is_older)
    return _flagged(_null_safe(latest, _spread(older, v, *keys), keys, "left"), keys)


def _spread(history: DataFrame, v: Column, *keys: str) -> DataFrame:
    return history.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sigma"))


def _null_safe(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_{k}" for k in keys])


def _flagged(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    n = F.coalesce("n", F.lit(0))
    return df.select(*keys, "current", "mean", "sigma", n.alias("n"),
                     *anomaly_columns(F.col("current"), F.col("mean"), F.col("sigma"), n))


def leading_streak(position: Column, broken: Column) -> Column:
    """Length of the unbroken run from position 1: positions before the first break, or all of them.

    An aggregate, so no group is sorted or collected.
    """
    return F.coalesce(F.min(F.when(broken, position)) - 1, F.count(F.lit(1)))


def slope(y: Column | str, x: Column | str) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    x = F.col(x) if isinstance(x, str) else x
    return F.regr_slope(y.cast("double"), x.cast("double"))
