"""Checks of feeds against their declaration, each in one pass over the rows of its table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.model import TableSpec
from lonja.operators.ingest import check_row_shape, key_present, project_rename


def _all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def key_report(tables: Mapping[str, tuple[DataFrame, Iterable[str]]]) -> DataFrame:
    """Per table its rows, those with an absent or blank key part, and those beyond the first of their key.

    A table that lacks a key column is an error.  Rows of one key are counted before they move, so that a key that
    half of the rows share costs no more than any other.
    """
    def report(name: str, df: DataFrame, keys: list[str]) -> DataFrame:
        check_row_shape(df, keys)
        present = df.select(*keys, key_present(keys).alias("_present"))
        per_key = present.groupBy(*keys, "_present").agg(F.count(F.lit(1)).alias("_rows"))
        n, absent = F.col("_rows"), ~F.col("_present")

        def total(value: Column) -> Column:
            return F.coalesce(F.sum(value), F.lit(0))
        return per_key.agg(total(n).alias("rows"), total(F.when(absent, n)).alias("absent"), total(F.when(~absent, n - 1)).alias("repeated")).select(
            F.lit(name).alias("table"), "*")

    return _all(report(name, df, list(keys)) for name, (df, keys) in tables.items())


def conversion_report(df: DataFrame, mapping: Mapping[str, str], spec: TableSpec) -> DataFrame:
    """Per mapped column whether the source has it, whether the table declares it, its values and those that do not fit.

    A value is lost when it is there in the source and NULL after the conversion of :func:`project_rename`.
    """
    present = {c.lower(): c for c in df.columns}
    have = {s: t for s, t in mapping.items() if s.lower() in present}
    declared = {s: t for s, t in have.items() if t in spec.columns}
    # raw values and converted ones side by side, from the same conversion that the feed uses
    raw = {s: f"_raw{i}" for i, s in enumerate(have)}
    both = project_rename(df.select("*", *[F.col(present[s.lower()]).alias(n) for s, n in raw.items()]),
                          {**declared, **{n: n for n in raw.values()}}, spec)
    zero = F.lit(0).cast("long")

    def cell(source: str, target: str):
        values = F.count(raw[source]) if source in have else zero
        lost = F.count_if(F.col(raw[source]).isNotNull() & F.col(target).isNull()) if source in declared else zero
        return F.struct(F.lit(source).alias("source"), F.lit(target).alias("target"), F.lit(source in have).alias("in_source"),
                        F.lit(target in spec.columns).alias("in_table"), values.alias("values"), lost.alias("lost"))

    return both.agg(F.array(*[cell(s, t) for s, t in mapping.items()]).alias("cells")).select(F.inline("cells"))


def describe_feeds(frames: Mapping[str, DataFrame], prefix: str = "") -> DataFrame:
    """Every column of the tables with a prefix: position, type, rows of the table and how many of them hold a value."""
    def described(name: str, df: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                          F.count(F.col(f"`{f.name}`")).alias("filled")) for i, f in enumerate(df.schema.fields)]
        counted = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*cells).alias("cells"))
        return counted.select(F.lit(name).alias("table"), "rows", F.inline("cells"))

    chosen = {n: df for n, df in frames.items() if n.startswith(prefix)}
    if not chosen:
        raise LookupError(f"no table starts with {prefix!r}")
    return _all(described(n, df) for n, df in chosen.items())
