"""What several operators share: reading documents, bounded bit sets, joins against very large groups."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import lonja
from lonja.session import tune

#: Python workers get texts in batches of so many rows and bytes at most.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Groups so large are joined by a broadcast of at most so many rows.
HOT_ROWS, HOT_GROUPS = 1000, 512
#: Sizes of bit sets.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 16, 1 << 22, 1 << 27


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for a Spark context; they need not have it installed."""
    context, home = spark.sparkContext, os.path.dirname(lonja.__file__)
    if getattr(context, "_lonja_shipped", False) or not os.path.isdir(home):
        return
    folder = tempfile.mkdtemp(prefix="lonja-")  # the driver serves the archive from here as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(os.path.join(folder, "lonja"), "zip", os.path.dirname(home), os.path.basename(home)))
    context._lonja_shipped = True


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the text operators: small Arrow batches, since one text may have megabytes."""
    tune(spark)
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def release() -> None:
    """Give memory that this process has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for ``mapInArrow`` after which its worker keeps only what it needs: workers wait for further tasks beside those at work."""
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def hash128(value: Column) -> Column:
    """128 bits as two longs; as good as equality for grouping at any size in reach."""
    return F.struct(F.xxhash64(F.lit(17), value).alias("a"), F.xxhash64(F.lit(71), value).alias("b"))


def bits_for(keys: int) -> int:
    """A power of two with ``BITS_A_KEY`` bits for each key, within ``LEAST_BITS`` and ``MOST_BITS``."""
    return min(max(1 << (keys * BITS_A_KEY - 1).bit_length(), LEAST_BITS), MOST_BITS) if keys else LEAST_BITS


def bit_set(keys: DataFrame, key: Column, bits: int | None = None) -> DataFrame:
    """One row ``words``: an array of ``bits / 64`` longs with a bit for each key's hash.

    It only keeps rows out of a join that decides; a bit never lacks.  Its size follows the number of keys up to
    ``MOST_BITS`` (16 MB, sent to every task).  Up to eight million keys one other row in 16 passes; at forty
    million a quarter does, and at a thousand million all do, so that then the join alone sorts them out.
    """
    bits = bits or bits_for(keys.count())
    slot = F.pmod(key, F.lit(bits))
    words = (keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("value")))
    every = keys.sparkSession.range(bits // 64).withColumnRenamed("id", "word")
    filled = every.join(words, "word", "left").select("word", F.coalesce("value", F.lit(0)).alias("value"))
    return filled.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "value"))), lambda x: x["value"]).alias("words"))


def in_bit_set(words: Column, key: Column) -> Column:
    slot = F.pmod(key, F.size(words).cast("long") * 64)
    word = F.get(words, F.shiftright(slot, 6).cast("int"))
    return F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Left join of rows with one row per group, where a few groups may hold most rows.

    The largest groups, at most ``HOT_GROUPS`` of at least ``HOT_ROWS`` rows, are broadcast; the rows they
    do not match meet the other groups in a shuffled join.
    """
    hot = groups.filter(F.col(size) >= HOT_ROWS).orderBy(F.desc(size), *keys).limit(HOT_GROUPS)
    values = [c for c in groups.columns if c not in keys]
    first = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    near = first.filter("_hot").drop("_hot")
    far = first.filter("_hot is null").drop("_hot", *values).join(groups, keys, "left")
    return near.unionByName(far)
