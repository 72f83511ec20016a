"""Turning source snapshots into clean, typed tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.model import TableSpec


def project_rename(df: DataFrame, mapping: Mapping[str, str], spec: TableSpec | None = None) -> DataFrame:
    """Keep mapped columns only, under their new names and declared types; an absent source column is NULL.

    Float record ids reach a decimal key through text, so no digit is lost.  A value that does not
    fit its type becomes NULL instead of failing the feed; :func:`quarantine` then sets the row aside
    if the column is required.
    """
    present = {c.lower(): c for c in df.columns}
    types = {f.name: f.dataType for f in spec.schema} if spec else {}

    def column(source: str, target: str) -> Column:
        dtype = types.get(target)
        name = present.get(source.lower())
        if name is None:
            return F.lit(None).cast(dtype or "string").alias(target)
        out = F.col(name)
        if isinstance(dtype, T.DecimalType) and isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            out = out.cast("string")
        return (out.try_cast(dtype) if dtype else out).alias(target)

    return df.select([column(s, t) for s, t in mapping.items()])


def clean_text(df: DataFrame) -> DataFrame:
    """Lower-case column names, decode bytes as UTF-8 (bad bytes replaced), strip NUL characters."""

    def column(f: T.StructField) -> Column:
        out = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BinaryType):
            out = F.make_valid_utf8(out.cast("string"))
        if isinstance(f.dataType, (T.BinaryType, T.StringType)):
            out = F.translate(out, "\u0000", "")
        return out.alias(f.name.lower())

    return df.select([column(f) for f in df.schema.fields])


def quantize_key(column: Column | str, scale: int = 3) -> Column:
    """float -> text -> decimal(20, scale), half up; NULL and non-numeric text become NULL."""
    c = F.col(column) if isinstance(column, str) else column
    return c.cast("string").try_cast(T.DecimalType(20, scale))


def decode_int16(column: Column | str) -> Column:
    """Signed 16-bit value that was delivered unsigned: 65535 -> -1; anything else is untouched."""
    c = F.col(column) if isinstance(column, str) else column
    whole = c.between(32768, 65535) & (c == F.floor(c))
    return F.when(whole, c - 65536).otherwise(c)


def decode_declared(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Apply :func:`decode_int16` to the columns the spec declares, leaving text columns alone."""
    numeric = [c for c in spec.int16_columns if isinstance(df.schema[c].dataType, T.NumericType)]
    return df.withColumns({c: decode_int16(c).cast(df.schema[c].dataType) for c in numeric})


def _carrier(df: DataFrame, name: str) -> Column:
    """A slot value as signed integer; NULL and non-numeric text count 0."""
    raw = F.col(name)
    if not isinstance(df.schema[name].dataType, T.NumericType):
        raw = raw.try_cast(T.DecimalType(20, 3))
    return F.coalesce(decode_int16(raw).try_cast("int"), F.lit(0))


def unpivot_slots(df: DataFrame, ids: Iterable[str], label_prefix: str, value_prefix: str, n: int = 34,
                  label: str = "size", value: str = "qty") -> DataFrame:
    """One wide row with ``n`` (label, value) slots -> one row per used slot.

    Slots with a blank label are dropped, labels trimmed, a missing value is 0, and
    carrier values are decoded.  Rows stay where they are: no shuffle.
    """
    slots = F.array(*[
        F.struct(F.trim(F.col(f"{label_prefix}{i}")).alias("l"),
                 _carrier(df, f"{value_prefix}{i}").alias("v"))
        for i in range(1, n + 1)])
    used = F.filter(slots, lambda s: s["l"] != "")
    return (df.select(*ids, F.explode(used).alias("slot"))
            .select(*ids, F.col("slot.l").alias(label), F.col("slot.v").alias(value)))


def unpivot_measures(df: DataFrame, ids: Iterable[str], label_prefix: str, value_prefixes: Mapping[str, str],
                     n: int = 34, label: str = "size") -> DataFrame:
    """Slots with several measures (ordered, delivered, pending, ...) -> one row per used slot."""
    slots = F.array(*[
        F.struct(F.trim(F.col(f"{label_prefix}{i}")).alias("l"),
                 *[F.coalesce(F.col(f"{p}{i}"), F.lit(0)).alias(name) for name, p in value_prefixes.items()])
        for i in range(1, n + 1)])
    return (df.select(*ids, F.explode(F.filter(slots, lambda s: s["l"] != "")).alias("slot"))
            .select(*ids, F.col("slot.l").alias(label), *[F.col(f"slot.{name}").alias(name) for name in value_prefixes]))


def sum_slots(df: DataFrame, key: str, prefix: str, n: int = 34, value: str = "qty") -> DataFrame:
    """Row-wise sum of decoded slots (NULL counts 0); rows with a NULL or 0 key are skipped."""
    parts = [_carrier(df, f"{prefix}{i}") for i in range(1, n + 1)]
    others = [c for c in df.columns if c != key and not c.startswith(prefix)]
    return df.where(F.col(key) != 0).select(key, *others, reduce(add, parts).cast("int").alias(value))


def key_present(required: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(F.trim(F.col(k).cast("string")) != "", F.lit(False)) for k in required])


def quarantine(df: DataFrame, required: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Split into rows with all required keys and rows to set aside; a bad row never fails the feed."""
    ok = key_present(required)
    return df.where(ok), df.where(~ok)


def quarantine_counted(df: DataFrame, required: Iterable[str], counts: Observation) -> DataFrame:
    """The good rows; the numbers of good and bad rows arrive in the observation when the rows are written.

    Counting rides on the pass that writes the rows, so the source is not read twice.
    """
    ok = key_present(required)
    return df.observe(counts, F.count_if(ok).alias("good"), F.count_if(~ok).alias("bad")).where(ok)


def null_if_zero(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Optional foreign keys use 0 for "unassigned"; make that NULL."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit(0)) for c in columns})


def exclude_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    c = F.col(column)
    return df.where(c.isNull() | ~c.startswith(prefix))


def cascade_exclude(facts: DataFrame, excluded: DataFrame, on: str = "item_id") -> DataFrame:
    """Remove fact rows of excluded items; rows without an item stay."""
    return facts.join(excluded.select(on).distinct(), on, "left_anti")


def pick_columns(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """The wanted columns that exist; an empty choice is an error."""
    have = set(df.columns)
    chosen = [c for c in wanted if c in have]
    if not chosen:
        raise ValueError("none of the wanted columns exists")
    return df.select(*chosen)


def check_row_shape(df: DataFrame, keys: Iterable[str], columns: Iterable[str] | None = None) -> None:
    """Columns present, at least one, and all keys among them."""
    names = list(columns) if columns is not None else df.columns
    if not names:
        raise ValueError("no columns")
    missing = [c for c in names if c not in df.columns]
    absent = [k for k in keys if k not in names]
    if missing or absent:
        raise ValueError(f"missing columns {missing}, keys not among columns {absent}")


def unmapped_targets(mapping: Mapping[str, str], spec: TableSpec) -> list[str]:
    """Mapping targets that the declared table does not have."""
    return [t for t in mapping.values() if t not in spec.columns]
