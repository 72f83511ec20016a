import datetime as dt

from pyspark.sql import functions as F

from lonja.operators.publish import stored_table
from lonja.plans import monitor
from lonja.streaming import jobs

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def put(spark, folder, data, schema):
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(folder))


def test_upsert_stream_resumes_and_replays(spark, rows, tmp_path):
    schema = "k int, v string, at int"
    table = stored_table(spark, str(tmp_path / "t"), schema, ["k"], buckets=3)

    def run(checkpoint):
        changes = jobs.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        jobs.upsert_stream(changes, table, ["at"], str(tmp_path / checkpoint))

    put(spark, tmp_path / "in", [(1, "a", 1), (2, "b", 1)], schema)
    run("cp")
    put(spark, tmp_path / "in", [(2, "B", 2), (3, "c", 2)], schema)
    run("cp")
    want = [(1, "a", 1), (2, "B", 2), (3, "c", 2)]
    assert rows(table.read()) == want
    run("cp")                                  # nothing new
    assert rows(table.read()) == want


def test_append_once(spark, rows, tmp_path):
    schema = "k int, ts timestamp"
    put(spark, tmp_path / "in", [(1, T0), (2, T0), (1, T0 + dt.timedelta(hours=1))], schema)
    put(spark, tmp_path / "in", [(1, T0 + dt.timedelta(hours=2)), (3, T0)], schema)
    stream = jobs.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
    jobs.append_once(stream, ["k"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("k")) == [(1,), (2,), (3,)]
    # a key that comes back after months, and a row that is months late
    put(spark, tmp_path / "in", [(1, T0 + dt.timedelta(days=200)), (4, T0 - dt.timedelta(days=200)), (None, T0)], schema)
    jobs.append_once(jobs.file_stream(spark, str(tmp_path / "in"), schema), ["k"], str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("k")) == [(1,), (2,), (3,), (4,), (None,)]


def test_append_once_reads_only_the_buckets_of_its_keys(spark, rows, tmp_path):
    schema, out = "k int, v string", str(tmp_path / "out")
    put(spark, tmp_path / "in", [(k, "a") for k in range(300)], schema)
    jobs.append_once(jobs.file_stream(spark, str(tmp_path / "in"), schema), ["k"], out, str(tmp_path / "cp"), buckets=16)
    batch = spark.createDataFrame([(5, "x"), (700, "y"), (None, "z")], schema).withColumn("_bucket", jobs.bucket_of(["k"], 16))
    held = jobs.stored_keys(batch, ["k"], out)
    folders = {f.split("_bucket=")[1].split("/")[0] for f in held.select("k", F.input_file_name().alias("f")).select("f").distinct().rdd.map(lambda r: r.f).collect()}
    assert folders == {str(b) for (b,) in batch.select("_bucket").collect()} and len(folders) <= 3
    assert "PartitionFilters: [_bucket" in held._jdf.queryExecution().executedPlan().toString() or len(folders) == 1
    before = spark.read.parquet(out).count()
    jobs.append_once(jobs.file_stream(spark, str(tmp_path / "in"), schema), ["k"], out, str(tmp_path / "replay"), buckets=16)
    assert spark.read.parquet(out).count() == before == 300


def test_rows_come_weeks_late(spark, rows, tmp_path):
    schema = "ts timestamp, store string, v int"
    day = lambda n, v, store="a": (T0 + dt.timedelta(days=n), store, v)
    table = stored_table(spark, str(tmp_path / "t"), "day date, store string, total long, rows long", ["day", "store"], partition="day")

    def run(checkpoint):
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        jobs.recomputed_days(stream, "ts", F.col("v"), ["store"], str(tmp_path / "base"), table, str(tmp_path / "log"), str(tmp_path / checkpoint), lateness_days=7)

    for batch in ([day(0, 1), day(40, 2), day(40, 3, "b")], [day(0, 10), day(39, 4)], [day(80, 5), day(0, 100, "b"), day(0, 1000)]):
        put(spark, tmp_path / "in", batch, schema)
        run("cp")
    d = lambda n: (T0 + dt.timedelta(days=n)).date()
    want = [(d(0), "a", 1011, 3), (d(0), "b", 100, 1), (d(39), "a", 4, 1), (d(40), "a", 2, 1), (d(40), "b", 3, 1), (d(80), "a", 5, 1)]
    assert rows(table.read()) == sorted(want, key=repr)
    log = spark.read.schema("day date, rows long, late boolean, batch int").parquet(str(tmp_path / "log"))
    assert rows(log.where("late").select("batch", "day", "rows")) == [(1, d(0), 1), (2, d(0), 2)]
    assert log.agg(F.sum("rows")).first()[0] == 8
    run("again")                               # every batch once more, from the start
    assert rows(table.read()) == sorted(want, key=repr)


def test_upserts_out_of_order_keep_the_newest(spark, rows, tmp_path):
    schema = "k int, v string, at int"
    table = stored_table(spark, str(tmp_path / "t"), schema, ["k"], buckets=3)
    for batch in ([(1, "new", 9), (2, "b", 1)], [(1, "old", 3), (2, "B", 5)], [(2, "late", 2), (3, "c", 1)]):
        put(spark, tmp_path / "in", batch, schema)
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        jobs.upsert_stream(stream, table, ["at"], str(tmp_path / "cp"))
    assert rows(table.read()) == [(1, "new", 9), (2, "B", 5), (3, "c", 1)]


def test_late_rows_still_count(spark, rows, tmp_path):
    schema = "ts timestamp, v int"
    put(spark, tmp_path / "in", [(T0, 1), (T0 + dt.timedelta(hours=5), 2)], schema)
    table = stored_table(spark, str(tmp_path / "t"), "window_start timestamp, total long, rows long", ["window_start"], buckets=2)

    def run():
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema)
        totals = jobs.windowed_totals(stream, "ts", F.col("v"))
        jobs.publish_totals(totals, table, str(tmp_path / "cp"))

    run()
    put(spark, tmp_path / "in", [(T0 + dt.timedelta(minutes=30), 10)], schema)    # 4.5 hours late
    run()
    day = jobs.running_day(table.read())
    assert rows(day.select("hour", "total", "running")) == [(10, 11, 11), (15, 2, 13)]


def test_trace_decisions(spark, tmp_path):
    schema = "trace_id string, ts timestamp, duration_ms long, is_error boolean"
    sec = lambda n: T0 + dt.timedelta(seconds=n)
    spans = [("err", sec(0), 5, False), ("err", sec(9), 5, True), ("late", sec(0), 5, False), ("late", sec(12), 5, True),
             ("slow", sec(0), 5001, False), ("fast", sec(1), 10, False)]
    put(spark, tmp_path / "in", spans, schema)
    put(spark, tmp_path / "in", [("end", sec(100_000), 1, False)], schema)
    stream = jobs.file_stream(spark, str(tmp_path / "in"), schema)
    jobs.run_available(jobs.decide_after_first(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                       .option("checkpointLocation", str(tmp_path / "cp")))
    got = {r["trace_id"]: (r["has_error"], r["spans"], r["elapsed_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"err": (True, 2, 9005.0), "late": (False, 1, 5.0), "slow": (False, 1, 5001.0), "fast": (False, 1, 10.0)}
    batch = monitor.sample_traces(spark.createDataFrame(spans, schema)).where("has_error OR elapsed_ms > 5000")
    assert {r["trace_id"] for r in batch.where("keep").collect()} == {"err", "slow"}


def test_a_first_span_that_comes_late_moves_the_wait(spark, tmp_path):
    schema = "trace_id string, ts timestamp, duration_ms long, is_error boolean"
    sec = lambda n: T0 + dt.timedelta(seconds=n)
    for batch in ([("x", sec(8), 5, False), ("x", sec(17), 5, True)], [("x", sec(0), 5, False)], [("end", sec(90_000), 1, False)]):
        put(spark, tmp_path / "in", batch, schema)
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        jobs.run_available(jobs.decide_after_first(stream, lateness="1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out"))
                           .option("checkpointLocation", str(tmp_path / "cp")))
    got = [(r["spans"], r["has_error"], r["elapsed_ms"]) for r in spark.read.parquet(str(tmp_path / "out")).where("trace_id = 'x'").collect()]
    assert got == [(2, False, 8005.0)]


def test_late_spans_do_not_decide_again(spark, tmp_path):
    schema = "trace_id string, ts timestamp, duration_ms long, is_error boolean"
    sec = lambda n: T0 + dt.timedelta(seconds=n)

    def run():
        stream = jobs.file_stream(spark, str(tmp_path / "in"), schema, files_per_batch=1)
        jobs.run_available(jobs.decide_after_first(stream).writeStream.format("parquet").option("path", str(tmp_path / "out"))
                           .option("checkpointLocation", str(tmp_path / "cp")))

    for batch in ([("x", sec(0), 5, False)], [("tick", sec(100), 1, False)], [("x", sec(95), 5, True)], [("tock", sec(50_000), 1, False)],
                  [("x", sec(49_995), 7, False)], [("end", sec(90_000), 1, False)]):
        put(spark, tmp_path / "in", batch, schema)
        run()
    got = [(r["spans"], r["has_error"]) for r in spark.read.parquet(str(tmp_path / "out")).where("trace_id = 'x'").orderBy("first_ts").collect()]
    assert got == [(1, False), (1, False)]      # the span at 95 s is ignored; hours later the id is a new trace


def test_many_traces_share_a_state_row(spark, rows, tmp_path):
    schema = "trace_id string, ts timestamp, duration_ms long, is_error boolean"
    sec = lambda n: T0 + dt.timedelta(seconds=n)
    spans = [(f"t{i}", sec(i % 7 + j), i, (i + j) % 3 == 0) for i in range(2000) for j in (0, 2, 11)]
    put(spark, tmp_path / "in", [*spans, (None, sec(0), 7, None), (None, sec(1), None, None), ("none", sec(0), None, True), ("never", None, 1, False)], schema)
    put(spark, tmp_path / "in", [("end", sec(90_000), 1, False)], schema)
    plan = jobs.decide_after_first(jobs.file_stream(spark, str(tmp_path / "in"), schema), buckets=16)
    query = jobs.run_available(plan.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")))
    assert 0 < max(x["stateOperators"][0]["numRowsTotal"] for x in query.recentProgress) <= 16
    got = rows(spark.read.parquet(str(tmp_path / "out")).select("trace_id", "has_error", "spans", "elapsed_ms"))
    want = [(f"t{i}", i % 3 == 0 or (i + 2) % 3 == 0, 2, 2000.0 + i) for i in range(2000)]
    assert got == sorted([*want, (None, None, 2, 7.0), ("none", True, 1, None)], key=repr)


def test_share_of_normal_traces(spark):
    keep = monitor.keep_trace(F.lit(False), F.lit(1), F.col("id"))
    kept = spark.range(20000).where(keep).count()
    assert 1800 < kept < 2200


def test_stale_feeds(spark, rows):
    newest = spark.createDataFrame([("a", T0), ("b", T0 - dt.timedelta(seconds=1))], "feed string, last_ts timestamp")
    out = jobs.stale_feeds(newest, T0 + dt.timedelta(hours=36))
    assert rows(out.select("feed", "is_stale")) == [("a", False), ("b", True)]
