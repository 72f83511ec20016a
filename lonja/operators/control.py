"""Watermarks, run ledger and feed order."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.model import SPECS
from lonja.operators.merge import upsert


# --- watermarks: one row per feed -----------------------------------------------------------------


def get_watermark(watermarks: DataFrame, feed: str) -> dt.datetime | None:
    """The instant a feed was last read, in UTC.  At most one row comes back to the driver."""
    row = watermarks.where(F.col("feed") == feed).agg(F.max(F.unix_micros("last_sync_at"))).first()
    return dt.datetime.fromtimestamp(row[0] / 1e6, dt.timezone.utc) if row[0] is not None else None


def set_watermark(watermarks: DataFrame, feed: str, at: dt.datetime, rows: int, ok: bool,
                  error: str | None = None) -> DataFrame:
    """Record a sync.  Only a success moves the instant; a failure keeps it and stores the error."""
    if at.tzinfo is None:
        raise ValueError("watermarks are timezone-aware")
    spark = watermarks.sparkSession
    at = at.astimezone(dt.timezone.utc)
    row = spark.createDataFrame([(feed, at, rows, "ok" if ok else "error", error, at)], SPECS["watermarks"].schema)
    if ok:
        return upsert(watermarks, row, ["feed"])
    known = watermarks.where(F.col("feed") == feed).select("feed", F.col("last_sync_at").alias("_kept"))
    failed = row.join(known, "feed", "left").withColumn("last_sync_at", F.col("_kept")).drop("_kept")
    return upsert(watermarks, failed.select(*watermarks.columns), ["feed"])


def reset_watermarks(watermarks: DataFrame, feeds: Sequence[str]) -> DataFrame:
    """Forget some feeds, so that their next run reads everything.  An empty list changes nothing."""
    return watermarks.where(~F.col("feed").isin(*feeds)) if feeds else watermarks


# --- run ledger -----------------------------------------------------------------------------------


def verdict(ok: Column, failed: Column) -> Column:
    return F.when(failed == 0, "success").when(ok == 0, "failed").otherwise("partial")


def summarise_runs(run_tables: DataFrame) -> DataFrame:
    """One row per run from its per-table ledger: span, counts, rows and verdict."""
    finished = F.col("started_at") + F.make_interval(secs=F.col("duration_ms") / 1000)
    ok = F.col("status") == "ok"
    counted = run_tables.groupBy("run_id").agg(
        F.min("started_at").alias("started_at"), F.max(finished).alias("finished_at"),
        F.count_if(ok).alias("tables_ok"), F.count_if(~ok).alias("tables_failed"),
        F.count(F.lit(1)).alias("total_tables"), F.sum("rows_synced").alias("total_rows"))
    return counted.select("*", _span_ms("started_at", F.col("finished_at")).alias("duration_ms"),
                          verdict(F.col("tables_ok"), F.col("tables_failed")).alias("status"))


def start_run(spark: SparkSession, run_id: int, trigger: str, kind: str, at: dt.datetime) -> DataFrame:
    """The ledger row of a run in progress; ``kind`` is delta or full."""
    if kind not in ("delta", "full"):
        raise ValueError(f"unknown run kind {kind!r}")
    row = (run_id, trigger, kind, at, None, None, "running", None, None, None, None)
    return spark.createDataFrame([row], SPECS["runs"].schema)


def finish_runs(runs: DataFrame, run_tables: DataFrame, at: dt.datetime) -> DataFrame:
    """Close running runs from their per-table rows; a run that recorded nothing gets one failed table."""
    counts = run_tables.groupBy("run_id").agg(
        F.count_if(F.col("status") == "ok").alias("_ok"), F.count_if(F.col("status") != "ok").alias("_bad"),
        F.sum("rows_synced").alias("_rows"))
    joined = runs.join(counts, "run_id", "left")
    running = F.col("status") == "running"
    ok, rows = F.coalesce("_ok", F.lit(0)), F.coalesce("_rows", F.lit(0))
    bad = F.when(ok + F.coalesce("_bad", F.lit(0)) == 0, 1).otherwise(F.coalesce("_bad", F.lit(0)))
    end = F.lit(at).cast("timestamp")

    def closed(value: Column, name: str) -> Column:
        dtype = runs.schema[name].dataType
        return F.when(running, value).otherwise(F.col(name)).cast(dtype)

    return joined.withColumns({
        "finished_at": closed(end, "finished_at"),
        "duration_ms": closed((F.unix_micros(end) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000, "duration_ms"),
        "tables_ok": closed(ok, "tables_ok"), "tables_failed": closed(bad, "tables_failed"),
        "total_tables": closed(ok + bad, "total_tables"), "total_rows": closed(rows, "total_rows"),
        "status": closed(verdict(ok, bad), "status"),
    }).select(*runs.columns)


def repair_orphans(runs: DataFrame, at: Column) -> DataFrame:
    """Runs left "running" by a dead worker become failed, with at least one failed table."""
    running = F.col("status") == "running"
    zero = F.lit(0)
    ok, bad = F.coalesce("tables_ok", zero), F.greatest(F.coalesce("tables_failed", zero), F.lit(1))
    elapsed = _span_ms("started_at", at)
    return runs.withColumns({
        "finished_at": F.when(running, at).otherwise(F.col("finished_at")),
        "duration_ms": F.when(running, F.coalesce("duration_ms", elapsed)).otherwise(F.col("duration_ms")),
        "total_tables": F.when(running, F.coalesce("total_tables", ok + bad)).otherwise(F.col("total_tables")),
        "tables_ok": F.when(running, ok).otherwise(F.col("tables_ok")),
        "tables_failed": F.when(running, bad).otherwise(F.col("tables_failed")),
        "status": F.when(running, "failed").otherwise(F.col("status")),
    })


def _span_ms(start: str, end: Column) -> Column:
    return F.floor((F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1000)


# --- feeds ----------------------------------------------------------------------------------------

# Groups run in this order, so that facts find their dimensions.
FEED_ORDER = ("dimensions", "masters", "sales", "wholesale", "purchasing", "stock", "cascade")


@dataclass(frozen=True)
class Feed:
    """One table load.  ``load(since)`` writes the table and returns the number of rows it read."""

    name: str
    group: str
    load: Callable[[dt.datetime | None], int]
    watermarked: bool = False


@dataclass(frozen=True)
class FeedResult:
    feed: str
    started_at: dt.datetime
    finished_at: dt.datetime
    ok: bool
    rows: int
    method: str
    since: dt.datetime | None
    error: str | None


def plan_feeds(feeds: Iterable[Feed], kind: str) -> list[Feed]:
    """All feeds in group order; a delta run keeps only those with a watermark."""
    chosen = [f for f in feeds if kind == "full" or f.watermarked]
    return sorted(chosen, key=lambda f: FEED_ORDER.index(f.group))


def run_feeds(feeds: Iterable[Feed], kind: str, watermark_of: Callable[[str], dt.datetime | None],
              now: Callable[[], dt.datetime], lookback_days: int = 1) -> list[FeedResult]:
    """Run feeds one after another.  A failing feed is recorded and the rest continue.

    The recorded method is the one really used: ``upsert`` after a watermark, ``full_upsert`` for a
    full read of a watermarked feed, ``full_refresh`` for a replaced table.
    """
    results = []
    for feed in plan_feeds(feeds, kind):
        start, since = now(), None
        if feed.watermarked and kind == "delta":
            mark = watermark_of(feed.name)
            since = mark - dt.timedelta(days=lookback_days) if mark else None
        method = "upsert" if since else "full_upsert" if feed.watermarked else "full_refresh"
        try:
            rows, error = feed.load(since), None
        except Exception as exc:  # noqa: BLE001 - one feed must not stop the others
            rows, error = 0, str(exc)
        results.append(FeedResult(feed.name, start, now(), error is None, rows, method, since, error))
    return results


def ledger_rows(spark: SparkSession, run_id: int, results: Sequence[FeedResult]) -> DataFrame:
    """Per-table ledger rows of a run: one per feed."""
    rows = [(run_id, r.feed, r.started_at, r.finished_at,
             int((r.finished_at - r.started_at).total_seconds() * 1000), "ok" if r.ok else "failed", r.rows,
             r.method, r.since, r.started_at if r.ok else None, r.error) for r in results]
    return spark.createDataFrame(rows, SPECS["run_tables"].schema)


