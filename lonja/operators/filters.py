"""Global filters: optional selections compiled to Columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# filter id -> (column it binds to, single or multi, numeric or text)
DEFINITIONS: dict[str, tuple[str, str, str]] = {
    "store": ("store", "single", "text"),
    "stock_store": ("store", "single", "text"),
    "family": ("family", "multi", "text"),
    "catalog_family": ("family_trimmed", "multi", "text"),
    "season": ("season", "multi", "text"),
    "brand": ("brand", "multi", "text"),
    "sex": ("sex", "multi", "text"),
    "department": ("department", "multi", "text"),
    "supplier": ("supplier_id", "multi", "numeric"),
    "purchase_supplier": ("supplier_id", "multi", "numeric"),
    "wholesale_customer": ("customer_id", "multi", "numeric"),
}

# which filters each report family reacts to
SCOPES: dict[str, tuple[str, ...]] = {
    "retail": ("store", "family", "season", "brand", "sex", "department"),
    "stock": ("stock_store", "catalog_family", "season", "brand"),
    "coverage": ("stock_store", "catalog_family", "season", "brand", "supplier"),
    "purchasing": ("purchase_supplier",),
    "wholesale": ("wholesale_customer", "catalog_family", "season", "brand"),
}


def _number(value):
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return value if math.isfinite(value) else None
    try:
        number = float(value) if isinstance(value, str) and value.strip() else None
    except ValueError:
        return None
    return number if number is not None and math.isfinite(number) else None


def single(column: Column, value, kind: str = "text") -> Column | None:
    """Equality with one selected value; None (inactive) for blank or unusable input."""
    if kind == "numeric":
        value = _number(value)
    else:
        value = value.strip() if isinstance(value, str) and value.strip() else None
    return None if value is None else column == F.lit(value)


def multi(column: Column, values, kind: str = "text") -> Column | None:
    """Membership in the selected values; None (inactive) for an empty list or a wrong type."""
    if not isinstance(values, (list, tuple)) or not values:
        return None
    if kind == "numeric":
        usable = all(isinstance(v, (int, float)) and _number(v) is not None for v in values)
    else:
        usable = all(isinstance(v, str) and v.strip() for v in values)
    return column.isin(*values) if usable else None


@dataclass(frozen=True)
class Filters:
    values: Mapping[str, object] = field(default_factory=dict)

    def condition(self, filter_id: str) -> Column | None:
        name, mode, kind = DEFINITIONS[filter_id]
        column = F.trim("family") if name == "family_trimmed" else F.col(name)
        return (single if mode == "single" else multi)(column, self.values.get(filter_id), kind)

    def apply(self, df: DataFrame, *filter_ids: str, without: str | None = None) -> DataFrame:
        """Keep rows that pass every active filter; an inactive filter is no filter at all."""
        for filter_id in filter_ids:
            condition = None if filter_id == without else self.condition(filter_id)
            if condition is not None:
                df = df.where(condition)
        return df

    def options(self, df: DataFrame, filter_id: str, value: Column | str, label: Column | str,
                cascade: Sequence[str] = ()) -> DataFrame:
        """Distinct (value, label) pairs, narrowed by the other active filters but not by the filter itself."""
        value, label = (F.col(c) if isinstance(c, str) else c for c in (value, label))
        narrowed = self.apply(df, *cascade, without=filter_id)
        return (narrowed.select(value.alias("value"), label.alias("label"))
                .where((F.col("value").cast("string") != "") & (F.col("label").cast("string") != "")).distinct())


    def facets(self, df: DataFrame, lists: Mapping[str, tuple[Column | str, Column | str]], scope: Sequence[str]) -> DataFrame:
        """The option lists of a whole panel in one pass: filter, value, label and the number of rows behind each.

        Every row carries a mask with a bit for each active filter of the scope that it fails.  It counts for a list when no
        other filter's bit is set, so that a list is narrowed by all filters but its own.  The rows are folded by mask and
        list columns before they are spread over the lists.
        """
        active = [x for x in scope if self.condition(x) is not None]
        failed = F.lit(0).cast("long")
        for i, x in enumerate(active):
            failed += F.when(F.coalesce(self.condition(x), F.lit(False)), 0).otherwise(1 << i)
        pairs = {x: tuple((F.col(c) if isinstance(c, str) else c).cast("string") for c in both) for x, both in lists.items()}
        folded = df.select(failed.alias("_failed"), *[c.alias(f"_{k}{i}") for i, both in enumerate(pairs.values()) for k, c in zip("vl", both, strict=True)])
        folded = folded.groupBy(*folded.columns).agg(F.count(F.lit(1)).alias("_rows"))
        options = F.array(*[F.struct(
            F.lit(x).alias("filter"), F.col(f"_v{i}").alias("value"), F.col(f"_l{i}").alias("label"),
            F.lit(1 << active.index(x) if x in active else 0).cast("long").alias("own")) for i, x in enumerate(pairs)])
        shown = F.filter(options, lambda o: (F.col("_failed").bitwiseAND(F.bitwise_not(o["own"])) == 0) & (o["value"] != "") & (o["label"] != ""))
        return folded.select("_rows", F.inline(shown)).groupBy("filter", "value", "label").agg(F.sum("_rows").alias("rows"))


NONE = Filters()
