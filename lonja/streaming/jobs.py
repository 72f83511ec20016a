"""Structured Streaming jobs for incremental loads and live aggregates.

All of them read any streaming DataFrame and write files; a run with ``availableNow`` processes what
has arrived and stops, so the same job serves an hourly schedule and a continuous one.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lonja.operators.merge import join_keys, latest_per_key
from lonja.operators.publish import BUCKET, StoredTable, bucket_of, one_of, overwrite_partitions
from lonja.session import written


def file_stream(spark: SparkSession, folder: str, schema: str, glob: str | None = None, files_per_batch: int | None = None,
                fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def run_available(query_writer) -> StreamingQuery:
    """Process everything that is there, then stop."""
    query = query_writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def upsert_stream(changes: DataFrame, table: StoredTable, order: Iterable[str], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Merge every micro-batch into a table.  Applying a batch twice gives the same table."""
    order = list(order)

    def apply(batch: DataFrame, _batch_id: int) -> None:
        table.merge(batch, order)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    query = writer.trigger(**(trigger or {"availableNow": True})).start()
    query.awaitTermination()
    return query


def append_once(rows: DataFrame, keys: Iterable[str], path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Append one row of each key over all history, however late it comes.

    Rows are stored by a hash bucket of their keys, and a micro-batch meets only the buckets that its own keys fall
    into: what it reads is bounded by those, not by all that was ever written.  No state is kept and no
    row is late.  A batch that runs again adds nothing.
    """
    keys = list(keys)

    def apply(batch: DataFrame, _batch_id: int) -> None:
        fresh = written(latest_per_key(batch, keys, []).withColumn(BUCKET, bucket_of(keys, buckets)), "append-once")
        held = stored_keys(fresh, keys, path)
        if held is not None:
            fresh = join_keys(fresh, held, keys, "left_anti")
        fresh.write.mode("append").partitionBy(BUCKET).parquet(path)

    return run_available(rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint))


def stored_keys(rows: DataFrame, keys: list[str], path: str) -> DataFrame | None:
    """The keys stored in the buckets of some rows; None before anything was stored."""
    touched = [v for (v,) in rows.select(BUCKET).distinct().collect()]  # at most as many as there are buckets
    try:
        stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    except AnalysisException:
        return None
    return stored.where(one_of(F.col(BUCKET), touched)).select(*keys)


def windowed_totals(rows: DataFrame, ts: str, value: Column, keys: Iterable[str] = (), every: str = "1 hour",
                    lateness: str = "1 day") -> DataFrame:
    """Totals per time window; rows up to the lateness behind still count."""
    return rows.withWatermark(ts, lateness).groupBy(F.window(ts, every), *keys).agg(
        F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows")).select(
        F.col("window.start").alias("window_start"), *keys, "total", "rows")


def publish_totals(totals: DataFrame, table: StoredTable, checkpoint: str) -> StreamingQuery:
    """Keep the newest total of each window in a small table.  Only changed windows are sent."""
    def apply(batch: DataFrame, _batch_id: int) -> None:
        table.merge(batch)

    return run_available(totals.writeStream.outputMode("update").foreachBatch(apply).option("checkpointLocation", checkpoint))


def recomputed_days(rows: DataFrame, ts: str, value: Column, by: Iterable[str], base: str, totals: StoredTable, log: str, checkpoint: str,
                    lateness_days: int = 1) -> StreamingQuery:
    """Totals per day that are right however late a row comes.

    Each micro-batch stores its rows under their day, then the days it touched, and no others, are summed again from
    the stored rows and replaced.  There is no watermark behind which rows are dropped; instead ``log`` gets, for each
    batch and day, the number of rows and whether they came more than ``lateness_days`` behind the newest day of the
    batches before.  A batch that runs again replaces what it stored.
    """
    by = list(by)

    def apply(batch: DataFrame, batch_id: int) -> None:
        stamped = batch.withColumn("day", F.to_date(ts)).withColumn("batch", F.lit(batch_id))
        overwrite_partitions(stamped, base, "day", "batch")
        stored = batch.sparkSession.read.schema(stamped.schema).parquet(base)
        own = stored.where(F.col("batch") == batch_id)
        days = [d for (d,) in own.select("day").distinct().collect()]  # days of the calendar
        newest = stored.where(F.col("batch") < batch_id).agg(F.max("day")).first()[0]
        limit = newest - dt.timedelta(days=lateness_days) if newest else None
        late = F.coalesce(F.col("day") < F.lit(limit).cast("date"), F.lit(False))
        overwrite_partitions(own.groupBy("day").agg(F.count(F.lit(1)).alias("rows")).select(
            "day", "rows", late.alias("late"), F.lit(batch_id).alias("batch")), log, "batch")
        again = stored.where(one_of(F.col("day"), days)).groupBy("day", *by).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("rows"))
        totals.put(again, days)

    return run_available(rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint))


def running_day(totals: DataFrame) -> DataFrame:
    """Running total per day from hourly totals: each day has at most 24 of them."""
    from pyspark.sql import Window as W

    day = F.to_date("window_start")
    so_far = W.partitionBy(day).orderBy("window_start").rowsBetween(W.unboundedPreceding, 0)
    return totals.select(day.alias("day"), F.hour("window_start").alias("hour"), "total", F.sum("total").over(so_far).alias("running"))


# --- trace sampling -------------------------------------------------------------------------------


def sessions(spans: DataFrame, gap: str = "10 seconds", lateness: str = "10 seconds") -> DataFrame:
    """Per trace the facts its sampling needs; a trace closes when no span came for the gap.  JVM only."""
    micros = F.unix_micros(F.col("ts"))
    return spans.withWatermark("ts", lateness).groupBy("trace_id", F.session_window("ts", gap)).agg(
        F.bool_or("is_error").alias("has_error"), F.count(F.lit(1)).alias("spans"),
        ((F.max(micros + F.col("duration_ms") * 1000) - F.min(micros)) / 1000).alias("elapsed_ms")).select(
        "trace_id", F.col("session_window.start").alias("first_ts"), "has_error", "spans", "elapsed_ms")


TRACE_STATE = "trace_id array<string>, armed array<bigint>, decided array<boolean>, start array<bigint>, end array<bigint>, error array<bigint>, n array<bigint>"
TRACE_OUTPUT = "trace_id string, first_ts timestamp, has_error boolean, spans long, elapsed_ms double"
#: Ends and errors that are not known.
NO_END, NO_ERROR = -(1 << 63), -1


def decide_after_first(spans: DataFrame, wait_seconds: int = 10, remember_seconds: int = 3600,
                       lateness: str = "10 seconds", buckets: int = 1024) -> DataFrame:
    """The decision falls a fixed time after the FIRST span of a trace; later spans do not count.

    The state of a trace has one entry for each distinct start inside the wait, folded over the spans that
    share it.  A span that comes late but is the first moves the wait, and entries that then lie beyond it go; what
    lay beyond an earlier wait can never come back inside.  After its decision a trace is remembered for a
    while, so that late spans do not decide it again, and then it leaves.

    Traces are kept together by a hash bucket of their id, since a call for each costs far more than its few spans.  Each
    has its own timeout ``armed`` (in milliseconds), and a bucket wakes up at the first of them.
    """
    wait_us, remember_us = wait_seconds * 1_000_000, remember_seconds * 1_000_000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        traces: dict[str | None, tuple[int, bool, dict]] = {}  # armed, decided, end, error and count by start
        for trace, armed, decided, *entry in zip(*state.get, strict=True) if state.exists else ():
            traces.setdefault(trace, (armed, decided, {}))[2][entry[0]] = tuple(entry[1:])
        for pdf in () if state.hasTimedOut else batches:
            met = pdf["trace_id"].astype("object").where(pdf["trace_id"].notna(), None).tolist()
            for trace, start, end, error in zip(met, *(pdf[c].tolist() for c in ("start", "end", "error")), strict=True):
                _, decided, entries = traces.setdefault(trace, (0, False, {}))
                if not decided:
                    old = entries.get(start, (NO_END, NO_ERROR, 0))
                    entries[start] = (max(old[0], end), max(old[1], error), old[2] + 1)
            for trace in set(met):
                _, decided, entries = traces[trace]
                first = min(entries)
                armed = max((first + (remember_us if decided else wait_us)) // 1000, mark + 1)
                traces[trace] = armed, decided, {s: x for s, x in entries.items() if s <= first + wait_us}
        out = []
        for trace in [t for t, (armed, *_) in traces.items() if armed < mark]:
            _, decided, entries = traces.pop(trace)
            if not decided:
                first, ends, errors, counts = min(entries), *zip(*entries.values(), strict=True)
                traces[trace] = max((first + remember_us) // 1000, mark + 1), True, {first: (NO_END, NO_ERROR, 0)}
                out.append((trace, pd.Timestamp(first, unit="us", tz="UTC"), None if max(errors) == NO_ERROR else max(errors) > 0, sum(counts),
                            None if max(ends) == NO_END else (max(ends) - first) / 1000.0))
        if traces:
            rows = [(t, armed, decided, s, *x) for t, (armed, decided, entries) in traces.items() for s, x in entries.items()]
            state.update(tuple(map(list, zip(*rows, strict=True))))
            state.setTimeoutTimestamp(max(min(armed for armed, *_ in traces.values()), mark + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["trace_id", "first_ts", "has_error", "spans", "elapsed_ms"])

    start = F.unix_micros("ts")
    rows = spans.withWatermark("ts", lateness).where("ts IS NOT NULL").select(
        F.pmod(F.hash("trace_id"), F.lit(buckets)).alias("bucket"), "trace_id", "ts", start.alias("start"),
        F.coalesce(start + F.col("duration_ms") * 1000, F.lit(NO_END)).alias("end"),
        F.coalesce(F.col("is_error").cast("long"), F.lit(NO_ERROR).cast("long")).alias("error"))
    return rows.groupBy("bucket").applyInPandasWithState(step, TRACE_OUTPUT, TRACE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


# --- freshness ------------------------------------------------------------------------------------


def stale_feeds(newest: DataFrame, as_of: dt.datetime, hours: float = 36.0) -> DataFrame:
    """Feeds whose newest row is strictly older than the limit; ``newest`` is (feed, last_ts)."""
    age = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1e6 / 3600
    return newest.select("feed", "last_ts", F.round(age, 4).alias("age_hours"), (age > hours).alias("is_stale"))
