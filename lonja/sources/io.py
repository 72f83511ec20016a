"""Readers and writers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.model import TableSpec


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A declared schema skips footer inference over the files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_jdbc(spark: SparkSession, url: str, query: str, *, partition_column: str | None = None,
              bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """Source snapshot over JDBC, split by a numeric column so that no single task reads it all."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if partition_column and bounds:
        return (reader.option("dbtable", f"({query}) AS src").option("partitionColumn", partition_column)
                .option("lowerBound", bounds[0]).option("upperBound", bounds[1])
                .option("numPartitions", partitions).load())
    return reader.option("query", query).load()


def write_mirror(df: DataFrame, path: str, spec: TableSpec, mode: str = "overwrite") -> None:
    """Write a mirror table in the layout of its spec.

    The rebalance hint gathers each partition value into few files, and lets adaptive execution
    split a value that holds most of the rows over many tasks.
    """
    rows = df.select(*spec.columns)
    if spec.partition_by:
        rows = rows.hint("rebalance", *[F.col(c) for c in spec.partition_by])
        rows.write.mode(mode).partitionBy(*spec.partition_by).parquet(path)
    else:
        rows.write.mode(mode).parquet(path)


def save_bucketed(df: DataFrame, table: str, keys: Iterable[str], buckets: int) -> None:
    """Bucket a table by its join key, so header/line joins on that key need no shuffle."""
    keys = list(keys)
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def append(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> None:
    writer = df.write.mode("append")
    columns = list(partition_by)
    (writer.partitionBy(*columns) if columns else writer).parquet(path)


def list_columns(spark: SparkSession, prefix: str = "") -> DataFrame:
    """Name, position and type of every column of the catalog tables with a prefix.

    Metadata only: the row count is the number of declared columns.
    """
    rows = [
        (t.name, i, c.name, c.dataType)
        for t in spark.catalog.listTables() if t.name.startswith(prefix)
        for i, c in enumerate(spark.catalog.listColumns(t.name))
    ]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def describe_frames(spark: SparkSession, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The same listing for a set of DataFrames."""
    rows = [(name, i, f.name, f.dataType.simpleString())
            for name, df in frames.items() for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def row_totals(frames: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    counts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
              for name, df in frames.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out
