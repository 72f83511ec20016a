import datetime as dt

import pytest
from pyspark.sql import functions as F

from lonja.model import SPECS
from lonja.operators import control

T0 = dt.datetime(2024, 5, 1, 2, 0, tzinfo=dt.timezone.utc)


def empty(spark, name):
    return spark.createDataFrame([], SPECS[name].schema)


def test_watermark_advances_only_on_success(spark):
    marks = control.set_watermark(empty(spark, "watermarks"), "sales", T0, 10, ok=True)
    assert control.get_watermark(marks, "sales") == T0
    later = T0 + dt.timedelta(hours=1)
    marks = control.set_watermark(marks, "sales", later, 0, ok=False, error="boom")
    assert control.get_watermark(marks, "sales") == T0
    assert marks.first()["status"] == "error"
    marks = control.set_watermark(marks, "sales", later, 5, ok=True)
    assert control.get_watermark(marks, "sales") == later and marks.count() == 1
    assert control.get_watermark(marks, "nothing") is None


def test_watermark_rejects_naive_time(spark):
    with pytest.raises(ValueError):
        control.set_watermark(empty(spark, "watermarks"), "x", dt.datetime(2024, 1, 1), 0, ok=True)


def test_first_failure_has_no_watermark(spark):
    marks = control.set_watermark(empty(spark, "watermarks"), "sales", T0, 0, ok=False, error="e")
    assert control.get_watermark(marks, "sales") is None and marks.count() == 1


def test_reset(spark):
    marks = control.set_watermark(empty(spark, "watermarks"), "a", T0, 1, ok=True)
    marks = control.set_watermark(marks, "b", T0, 1, ok=True)
    assert control.reset_watermarks(marks, []).count() == 2
    assert [r["feed"] for r in control.reset_watermarks(marks, ["a"]).collect()] == ["b"]


def test_feed_order_and_failure(spark):
    seen = []

    def load(name, fail=False):
        def run(since):
            seen.append((name, since))
            if fail:
                raise RuntimeError("no source")
            return 3
        return run

    feeds = [control.Feed("stock", "stock", load("stock"), True), control.Feed("stores", "dimensions", load("stores")),
             control.Feed("sales", "sales", load("sales", fail=True), True)]
    clock = iter(T0 + dt.timedelta(seconds=i) for i in range(100))
    results = control.run_feeds(feeds, "full", lambda f: T0, lambda: next(clock))
    assert [r.feed for r in results] == ["stores", "sales", "stock"]
    assert [r.ok for r in results] == [True, False, True]
    assert [r.method for r in results] == ["full_refresh", "full_upsert", "full_upsert"]
    seen.clear()
    results = control.run_feeds(feeds, "delta", lambda f: T0, lambda: next(clock), lookback_days=1)
    assert [s[0] for s in seen] == ["sales", "stock"] and all(s[1] == T0 - dt.timedelta(days=1) for s in seen)
    ledger = control.ledger_rows(spark, 5, results)
    assert {r["feed"]: r["status"] for r in ledger.collect()} == {"sales": "failed", "stock": "ok"}


def test_run_verdicts(spark):
    tables = spark.createDataFrame([(1, "a", "ok", 5), (1, "b", "ok", 5), (2, "a", "ok", 1), (2, "b", "failed", 0), (3, "a", "failed", 0)],
                                   "run_id long, feed string, status string, rows_synced long").withColumns(
        {"started_at": F.lit(T0).cast("timestamp"), "duration_ms": F.lit(1500)})
    got = {r["run_id"]: (r["status"], r["total_rows"], r["duration_ms"]) for r in control.summarise_runs(tables).collect()}
    assert got == {1: ("success", 10, 1500), 2: ("partial", 1, 1500), 3: ("failed", 0, 1500)}


def test_finish_and_aborted_run(spark):
    runs = control.start_run(spark, 1, "cron", "delta", T0).unionByName(control.start_run(spark, 2, "cron", "full", T0))
    with pytest.raises(ValueError):
        control.start_run(spark, 3, "cron", "weekly", T0)
    tables = spark.createDataFrame([(1, "a", "ok", 4)], "run_id long, feed string, status string, rows_synced long")
    done = {r["run_id"]: r for r in control.finish_runs(runs, tables, T0 + dt.timedelta(seconds=9)).collect()}
    assert (done[1]["status"], done[1]["duration_ms"], done[1]["total_rows"]) == ("success", 9000, 4)
    assert (done[2]["status"], done[2]["tables_failed"], done[2]["total_tables"]) == ("failed", 1, 1)


def test_repair_orphans(spark):
    runs = control.start_run(spark, 1, "cron", "full", T0)
    fixed = control.repair_orphans(runs, F.lit(T0 + dt.timedelta(minutes=1)).cast("timestamp")).first()
    assert (fixed["status"], fixed["tables_ok"], fixed["tables_failed"], fixed["total_tables"], fixed["duration_ms"]) == ("failed", 0, 1, 1, 60000)
