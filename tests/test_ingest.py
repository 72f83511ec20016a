import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from lonja.model import SPECS, TableSpec, _spec
from lonja.operators import ingest
from lonja.sources import io


def test_decode_int16(spark, rows):
    df = spark.createDataFrame([(65535.0,), (65534.0,), (32768.0,), (32767.0,), (40000.5,), (70000.0,), (None,)], "v double")
    got = [r[0] for r in df.select(ingest.decode_int16("v")).collect()]
    assert got == [-1, -2, -32768, 32767, 40000.5, 70000, None]


def test_decode_declared_leaves_text_alone(spark):
    spec = TableSpec("t", SPECS["stock"].schema, int16_columns=("a", "b"))
    df = spark.createDataFrame([(65535, "abc", 65535)], "a int, b string, c int")
    assert tuple(ingest.decode_declared(df, spec).first()) == (-1, "abc", 65535)


def test_quantize_keeps_neighbours_apart(spark):
    df = spark.createDataFrame([("4.152",), ("4.153",), ("4.1525",), ("x",), (None,)], "v string")
    got = [r[0] for r in df.select(ingest.quantize_key("v")).collect()]
    assert got == [Decimal("4.152"), Decimal("4.153"), Decimal("4.153"), None, None]
    big = spark.createDataFrame([(10028816.641,)], "v double")
    assert big.select(ingest.quantize_key("v")).first()[0] == Decimal("10028816.641")


def test_unpivot_slots(spark, rows):
    df = spark.createDataFrame([("A", " M ", 5, "  ", 9, None, 9, "L", None), ("B", "S", 65535, "XL", 3, None, None, "", 1)],
                               "item string, t1 string, s1 int, t2 string, s2 int, t3 string, s3 int, t4 string, s4 int")
    assert rows(ingest.unpivot_slots(df, ["item"], "t", "s", 4)) == [("A", "L", 0), ("A", "M", 5), ("B", "S", -1), ("B", "XL", 3)]


def test_unpivot_34_slots_needs_no_shuffle(spark):
    columns = ", ".join(f"t{i} string, s{i} int" for i in range(1, 35))
    df = spark.createDataFrame([["A"] + [x for i in range(1, 35) for x in (str(i), i)]], "item string, " + columns)
    long = ingest.unpivot_slots(df, ["item"], "t", "s")
    assert long.count() == 34
    assert "Exchange" not in long._jdf.queryExecution().executedPlan().toString()


def test_sum_slots_skips_zero_key(spark, rows):
    df = spark.createDataFrame([(1, 2, 65535, None), (0, 5, 5, 5), (None, 1, 1, 1)], "k int, s1 int, s2 int, s3 int")
    assert rows(ingest.sum_slots(df, "k", "s", 3)) == [(1, 1)]


def test_quarantine(spark, rows):
    df = spark.createDataFrame([("a", "x"), (None, "x"), (" ", "x"), ("b", None), ("c", "y")], "k string, j string")
    good, bad = ingest.quarantine(df, ["k", "j"])
    assert rows(good) == [("a", "x"), ("c", "y")]
    assert bad.count() == 3


def test_null_if_zero_and_prefix(spark, rows):
    df = spark.createDataFrame([("MA1", Decimal("0.000")), ("X", Decimal("3.000")), (None, None)], "ref string, fk decimal(20,3)")
    assert rows(ingest.null_if_zero(df, ["fk"]).select("fk")) == [(Decimal("3.000"),), (None,), (None,)]
    assert rows(ingest.exclude_prefix(df, "ref", "MA").select("ref")) == [("X",), (None,)]


def test_cascade_exclude_keeps_rows_without_item(spark, rows):
    facts = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "item_id string, n int")
    gone = spark.createDataFrame([("a",), (None,), ("a",)], "item_id string")
    assert rows(ingest.cascade_exclude(facts, gone)) == [("b", 2), (None, 3)]


def test_project_rename(spark):
    df = spark.createDataFrame([(4.152, "7", dt.date(2024, 2, 29), 5)], "RegVentas double, Tienda string, Fecha date, extra int")
    spec = _spec("t", "ticket_id decimal(20,3), store string, sale_date date, hour int")
    out = ingest.project_rename(df, {"regventas": "ticket_id", "tienda": "store", "fecha": "sale_date", "hora": "hour"}, spec)
    assert tuple(out.first()) == (Decimal("4.152"), "7", dt.date(2024, 2, 29), None)
    assert out.schema["hour"].dataType.simpleString() == "int"


def test_clean_text(spark):
    df = spark.createDataFrame([(bytearray(b"caf\xc3\xa9\x00 \xff"), "x\u0000y")], "RAW binary, Txt string")
    out = ingest.clean_text(df)
    assert out.columns == ["raw", "txt"]
    assert tuple(out.first()) == ("café �", "xy")


def test_shape_checks(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    ingest.check_row_shape(df, ["a"])
    with pytest.raises(ValueError):
        ingest.check_row_shape(df, ["c"])
    with pytest.raises(ValueError):
        ingest.check_row_shape(df, ["a"], ["a", "z"])
    assert ingest.pick_columns(df, ["b", "zz"]).columns == ["b"]
    with pytest.raises(ValueError):
        ingest.pick_columns(df, ["zz"])
    assert ingest.unmapped_targets({"x": "store", "y": "nope"}, SPECS["tickets"]) == ["nope"]


def test_every_binding_target_is_declared():
    from lonja.sources.mirror import BINDINGS

    for role, (_, pairs) in BINDINGS.items():
        targets = {p: p.split("=")[0] for p in pairs.split()}
        assert ingest.unmapped_targets(targets, SPECS[role]) == [], role


def test_listing_and_totals(spark, rows):
    frames = {"a": spark.range(3), "b": spark.range(5)}
    assert rows(io.row_totals(frames)) == [("a", 3), ("b", 5)]
    assert rows(io.describe_frames(spark, frames)) == [("a", 0, "id", "bigint"), ("b", 0, "id", "bigint")]
    spark.range(1).createOrReplaceTempView("lj_probe")
    assert rows(io.list_columns(spark, "lj_")) == [("lj_probe", 0, "id", "bigint")]


def test_bucketed_tables_join_without_shuffle(spark):
    spark.sql("DROP TABLE IF EXISTS lj_heads")
    spark.sql("DROP TABLE IF EXISTS lj_lines")
    io.save_bucketed(spark.range(1000).withColumnRenamed("id", "ticket_id"), "lj_heads", ["ticket_id"], 4)
    io.save_bucketed(spark.range(3000).select((F.col("id") % 1000).alias("ticket_id"), "id"), "lj_lines", ["ticket_id"], 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("lj_lines").join(spark.table("lj_heads"), "ticket_id")
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE lj_heads")
        spark.sql("DROP TABLE lj_lines")


def test_days_and_months_prune_folders(spark, tmp_path):
    spec = _spec("t", "id int, sale_date date, month int", "id", "month sale_date")
    days = [dt.date(2024, 1, 15) + dt.timedelta(days=i) for i in range(60)]
    df = spark.createDataFrame([(i, d, d.year * 100 + d.month) for i, d in enumerate(days)], "id int, sale_date date, month int")
    io.write_mirror(df, str(tmp_path / "t"), spec)
    read = spark.read.parquet(str(tmp_path / "t"))
    by_day = read.where("sale_date BETWEEN DATE '2024-02-01' AND DATE '2024-02-10' OR sale_date = DATE '2024-03-01'")
    assert by_day.count() == 11 and read.where("month = 202402").count() == 29
    assert "PartitionFilters: [((" in by_day._jdf.queryExecution().executedPlan().toString()


def test_counts_ride_on_the_write(spark, tmp_path):
    counts = Observation("feed")
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    ingest.quarantine_counted(df, ["k"], counts).write.parquet(str(tmp_path / "out"))
    assert counts.get == {"good": 2, "bad": 1}


def test_bad_values_do_not_fail_the_feed(spark, rows):
    spec = _spec("t", "k decimal(20,3), d date")
    df = spark.createDataFrame([("1.5", "2024-01-01"), ("oops", "2024-01-01"), ("2", "not a day")], "k string, d string")
    good, bad = ingest.quarantine(ingest.project_rename(df, {"k": "k", "d": "d"}, spec), ["k"])
    assert rows(good) == [(Decimal("1.500"), dt.date(2024, 1, 1)), (Decimal("2.000"), None)]
    assert bad.count() == 1


def test_fractional_and_text_carriers(spark, rows):
    df = spark.createDataFrame([("A", "M", "65535", "L", "x")], "i string, t1 string, s1 string, t2 string, s2 string")
    assert rows(ingest.unpivot_slots(df, ["i"], "t", "s", 2)) == [("A", "L", 0), ("A", "M", -1)]
    df = spark.createDataFrame([("A", "M", 40000.5)], "i string, t1 string, s1 double")
    assert rows(ingest.unpivot_slots(df, ["i"], "t", "s", 1)) == [("A", "M", 40000)]
