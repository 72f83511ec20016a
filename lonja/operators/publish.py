"""Publishing: merging a change set into a stored table by rewriting the partitions that it touches.

A stored table is a folder of parquet files, partitioned by a calendar column or, where rows have no date, by a
hash bucket of their keys.  What a merge yields is first written aside; only a complete result replaces
partitions, with Spark's dynamic partition overwrite, which itself moves files into place when all tasks are done.
A failed job so leaves the table as it was, and a merge that runs again gives the same table.  One job writes a
table at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lonja.operators.merge import join_keys, latest_per_key, replace_children, upsert
from lonja.session import written

BUCKET = "_bucket"
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def bucket_of(keys: Iterable[str], buckets: int) -> Column:
    """Hash bucket of a row's keys; NULL is a value like any other."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def one_of(column: Column, values: Iterable) -> Column:
    """Membership where NULL is a value like any other; on a partition column it prunes folders."""
    values = set(values)
    known = [v for v in values if v is not None]
    inside = column.isin(*known) if known else F.lit(False)
    return inside | column.isNull() if None in values else inside


def overwrite_partitions(rows: DataFrame, path: str, *columns: str) -> None:
    """Replace exactly the partitions that occur in ``rows``."""
    # a value that holds most of the rows is split over many tasks
    rows.hint("rebalance", *[F.col(c) for c in columns]).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy(*columns).parquet(path)


@dataclass(frozen=True)
class StoredTable:
    """``partition`` is a calendar column of the schema (a date, YYYYMM); without it rows are dealt to ``buckets`` by their keys.

    The number of partitions is bounded by the calendar or by ``buckets``; the driver sees their values, never rows.
    An empty text as partition value reads back as NULL.
    """

    spark: SparkSession
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    partition: str | None = None
    buckets: int = 32

    @property
    def folder(self) -> str:
        return self.partition or BUCKET

    def _placed(self, rows: DataFrame) -> DataFrame:
        rows = rows.select(*self.schema.names)
        return rows if self.partition else rows.withColumn(BUCKET, bucket_of(self.keys, self.buckets))

    def _stored(self) -> DataFrame:
        """With the bucket column, if there is one; the declared types hold, whatever the folder names look like."""
        schema = self.schema if self.partition else T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        try:
            return self.spark.read.schema(schema).parquet(self.path).select(*schema.names)
        except AnalysisException:  # nothing was stored yet
            return self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._stored().select(*self.schema.names)

    def read_for(self, rows: DataFrame) -> DataFrame:
        """The stored rows of the partitions that ``rows`` fall into; no other is read."""
        return self._stored().where(one_of(F.col(self.folder), self._values(self._placed(rows)))).select(*self.schema.names)

    def _values(self, rows: DataFrame) -> set:
        return {v for (v,) in rows.select(self.folder).distinct().collect()}

    def put(self, rows: DataFrame, values: Iterable) -> None:
        """Let ``rows`` take the place of the partitions ``values``; those that get no row go."""
        rows = written(self._placed(rows), "publish")
        present = self._values(rows)
        overwrite_partitions(rows, self.path, self.folder)
        for value in set(values) - present:
            self._drop(value)

    def _drop(self, value) -> None:
        # its rows are in ``rows`` under other values: a job that stops before this leaves them twice until it runs again
        jvm = self.spark.sparkContext._jvm
        escape = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        name = NO_VALUE if value in (None, "") else escape(self.spark.range(1).select(F.lit(value).cast("string")).first()[0])
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{escape(self.folder)}={name}")
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)

    def replace(self, rows: DataFrame) -> None:
        """Replace the whole content; an empty frame empties the table."""
        self.put(rows, self._values(self._stored()))

    def merge(self, changes: DataFrame, order: Iterable[str] = (), how: Callable[..., DataFrame] = upsert, rows_may_move: bool = True) -> None:
        """Apply a change set to the partitions it touches: those of its rows, and those under which its keys are held now.

        It is reduced to one row per key and written once, so that its size is known and a small one is broadcast.
        With hash buckets a key never moves.  With a calendar column held keys are found by reading the key columns, which
        a caller whose rows never change their date saves with ``rows_may_move=False``.
        """
        fresh = written(latest_per_key(changes.select(*self.schema.names), self.keys, order), "changes")
        values = self._values(self._placed(fresh))
        if not values:
            return
        stored = self._stored()
        if self.partition and rows_may_move:
            held = stored.select(*dict.fromkeys([*self.keys, self.partition]))
            values |= self._values(join_keys(held, fresh.select(*self.keys), self.keys, "left_semi"))
        touched = stored.where(one_of(F.col(self.folder), values)).select(*self.schema.names)
        self.put(how(touched, fresh, self.keys, order), values)

    def replace_children(self, parents: DataFrame, new_lines: DataFrame, parent_key: str) -> None:
        """Lines of changed parents are dropped and taken anew; ``parents`` names each with the partition its lines lie in.

        Only those partitions are read and rewritten.  A parent that moved is named with its old and its new partition.
        """
        named = written(parents.select(parent_key, self.folder).distinct(), "parents")
        values = self._values(named)
        touched = self._stored().where(one_of(F.col(self.folder), values)).select(*self.schema.names)
        fresh = new_lines.where(one_of(F.col(self.folder), values)).select(*self.schema.names)
        self.put(replace_children(touched, named, fresh, parent_key), values)


def stored_table(spark: SparkSession, path: str, schema: T.StructType | str, keys: Iterable[str], **options) -> StoredTable:
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return StoredTable(spark, path.rstrip("/"), schema, tuple(keys), **options)
