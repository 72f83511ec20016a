"""Top-k, paging, and ranks that stay distributed when one group holds most rows."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lonja.session import written


def top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """First k rows in an order.  Each task keeps k rows; nothing is sorted as a whole."""
    return df.orderBy(*order).limit(k)


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """A page by position; for deep pages use :func:`page_after`."""
    return df.orderBy(*order).offset(offset).limit(limit)


def page_after(df: DataFrame, limit: int, key: str, after) -> DataFrame:
    """Keyset page: rows after a key value, so earlier pages are never read again."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(F.col(key).asc()).limit(limit)


def clip(df: DataFrame, max_rows: int, max_columns: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """Clipped result (its first rows, where an order is given) and a one-row frame telling whether rows or columns were cut."""
    probe = df.limit(max_rows + 1)
    flags = probe.agg((F.count(F.lit(1)) > max_rows).alias("rows_truncated")).withColumn(
        "columns_truncated", F.lit(len(df.columns) > max_columns))
    rows = df.orderBy(*order) if order else df
    return rows.limit(max_rows).select(df.columns[:max_columns]), flags


def mixed_order(column: str, descending: bool = False) -> list[Column]:
    """Order for a text column of mixed content: blanks last either way, numbers by value, then text."""
    c = F.col(column).cast("string")
    blank = F.coalesce(F.trim(c) == "", F.lit(True))
    number, text = c.try_cast("double"), F.lower(c)
    way = (lambda e: e.desc_nulls_last()) if descending else (lambda e: e.asc_nulls_last())
    return [blank.asc(), way(number), way(text)]


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "n", partitions: int | None = None) -> DataFrame:
    """``row_number`` per group (over all rows without ``keys``), whatever share of the rows a group or a moment holds.

    Rows are dealt to ranges of (keys, order) and sorted there, so that a large group lies in many partitions.  Each
    partition counts its rows of a group; a row's number is its place in the partition, less that of the group's first
    row there, plus what earlier partitions count.  The sorted rows are written once: the two uses must see the
    same ranges.  The order should be total; rows that tie are numbered in any order.
    """
    keys = list(keys)
    spark = df.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    place = F.monotonically_increasing_id()
    rows = written(df.repartitionByRange(ranges, *wanted).sortWithinPartitions(*wanted).select(
        "*", F.shiftright(place, 33).alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")
    counts = rows.groupBy(*keys, "_part").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    same = F.col("r._part") == F.col("s._part")
    for k in keys:
        same &= F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}"))
    joined = rows.alias("r").join(shifts.alias("s"), same)
    return joined.select("r.*", (F.col("r._place") + F.col("s._shift")).alias(name)).drop("_part", "_place")


def page_with_total(df: DataFrame, limit: int, key: str, after=None) -> DataFrame:
    """A keyset page with the number of all rows beside it; the count is one partial aggregate, not a sort."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return page_after(df, limit, key, after).crossJoin(F.broadcast(total))


def packed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows (unique by ``keys``) behind one opaque column.

    A frame that is used twice is computed twice when each use keeps other columns of it.  Behind
    this barrier every use needs all columns, the exchanges below are equal, and Spark runs them once.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"))
            .select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]))


def share_of_total(df: DataFrame, keys: Sequence[str], value: str, name: str, digits: int = 1) -> DataFrame:
    """Percent of the column total, from a one-row total instead of a window over everything."""
    rows = packed(df, keys)
    whole = rows.agg(F.sum(F.col(value)).cast("double").alias("_whole"))
    share = F.round(F.col(value).cast("double") / F.when(F.col("_whole") != 0, F.col("_whole")) * 100, digits)
    return rows.crossJoin(F.broadcast(whole)).withColumn(name, share).drop("_whole")


def normalise_to_max(df: DataFrame, keys: Sequence[str], columns: Iterable[str]) -> DataFrame:
    """Each value over its column maximum (at least 0); text that is no number is ignored."""
    rows, columns = packed(df, keys), list(columns)

    def number(c: str) -> Column:
        return F.col(c).cast("string").try_cast("double")

    tops = rows.agg(*[F.greatest(F.coalesce(F.max(number(c)), F.lit(0.0)), F.lit(0.0)).alias(f"_max_{c}") for c in columns])
    scaled = {f"{c}_heat": F.when(F.col(f"_max_{c}") > 0, number(c) / F.col(f"_max_{c}")) for c in columns}
    return rows.crossJoin(F.broadcast(tops)).withColumns(scaled).drop(*[f"_max_{c}" for c in columns])


#: Classes of one step of the selection.
CLASSES = 1 << 16


def top_share(df: DataFrame, value: str, denominator: int = 10) -> DataFrame:
    """Exact share of the total held by the top 1/denominator of the rows (rounded up).

    The value at the boundary is selected by its digits, without ranking or sorting rows: the range of values is cut
    into classes, a histogram names the class that the boundary falls into, that class is cut again, until it is one
    value.  Two steps do for amounts that lie within 40 million, four for any; one histogram of at most
    ``CLASSES`` rows reaches the driver in each, where it picks the next class.  Rows of equal value are counted, never
    listed.  ``value`` is an amount with two decimals, up to 4 * 10^16.
    """
    code = F.round(F.col(value) * 100).cast("long")
    values = df.where(F.col(value).isNotNull()).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("decimal(38,2)").alias("s"))
    values = written(values, "values")
    whole = values.agg(F.min("code").alias("low"), F.max("code").alias("high"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"), F.sum("s").alias("total")).first()
    low, size, above, total_above = whole["low"], (whole["high"] or 0) - (whole["low"] or 0) + 1, 0, Decimal(0)
    k = -(-whole["members"] // denominator)
    while k and size > 1:
        width = -(-size // CLASSES)
        inside = values.where(F.col("code").between(low, low + size - 1))
        classes = inside.groupBy(F.expr(f"(code - ({low}L)) div {width}L").alias("c"))
        for c, n, s in sorted(classes.agg(F.sum("n"), F.sum("s")).collect(), reverse=True):
            if above + n >= k:
                low, size = low + c * width, width
                break
            above, total_above = above + n, total_above + s
    top_total = total_above + (k - above) * Decimal(low).scaleb(-2) if k else None
    return df.sparkSession.createDataFrame([(whole["members"], k, top_total, whole["total"])], "members long, top_members long, top_total decimal(38,2), total decimal(38,2)")
