"""Stored tables: which partitions a merge touches, what a failed job leaves, values of every kind."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from lonja.operators import publish

KV = "k int, v string, at int"
MONTHLY = "k int, v string, month int"


def kv(spark, tmp_path, **options):
    return publish.stored_table(spark, str(tmp_path / "t"), KV, ["k"], **options)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_merge_and_replace(spark, rows, tmp_path):
    table = kv(spark, tmp_path)
    assert rows(table.read()) == []
    table.merge(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "n", 1)], KV), ["at"])
    table.merge(spark.createDataFrame([(2, "c", 1), (None, "N", 2), (1, "old", 0)], KV), ["at"])
    assert rows(table.read()) == [(1, "b", 2), (2, "c", 1), (None, "N", 2)]
    table.replace(spark.createDataFrame([(9, "z", 1)], KV))
    assert rows(table.read()) == [(9, "z", 1)]
    table.replace(spark.createDataFrame([], KV))
    assert rows(table.read()) == [] and table.read().columns == ["k", "v", "at"]


def test_one_changed_row_rewrites_one_bucket(spark, rows, tmp_path):
    table = kv(spark, tmp_path, buckets=8)
    table.replace(spark.createDataFrame([(k, "a", 1) for k in range(200)], KV))
    before = files(table.path)
    assert len({os.path.dirname(f) for f in before}) == 8
    table.merge(spark.createDataFrame([(7, "B", 2)], KV), ["at"])
    after = files(table.path)
    changed = {os.path.dirname(f) for f in before.items() ^ after.items() for f in f[:1]}
    assert len(changed) == 1 and table.read().where("v = 'B'").count() == 1 and table.read().count() == 200
    table.merge(spark.createDataFrame([], KV), ["at"])
    assert files(table.path) == after
    plan = table.read_for(spark.createDataFrame([(7, "x", 1)], KV))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan or "PartitionFilters: [isnotnull(_bucket" in plan


def test_a_failed_job_leaves_the_table(spark, rows, tmp_path):
    table = kv(spark, tmp_path)
    table.replace(spark.createDataFrame([(k, "a", 1) for k in range(20)], KV))
    before = files(table.path)
    bad = spark.range(20).select(F.col("id").cast("int").alias("k"), F.when(F.col("id") < 19, F.lit("b")).otherwise(F.raise_error(F.lit("lost"))).alias("v"), F.lit(2).alias("at"))
    with pytest.raises(Exception, match="lost"):
        table.merge(bad, ["at"])
    with pytest.raises(Exception, match="lost"):
        table.replace(bad)
    assert files(table.path) == before and table.read().where("v = 'a'").count() == 20


def test_only_touched_months_are_rewritten(spark, rows, tmp_path):
    table = publish.stored_table(spark, str(tmp_path / "m"), MONTHLY, ["k"], partition="month")
    table.replace(spark.createDataFrame([(1, "a", 202401), (2, "b", 202402), (3, "c", 202403)], MONTHLY))
    before = files(table.path)
    table.merge(spark.createDataFrame([(2, "B", 202402), (4, "d", 202404)], MONTHLY))
    assert rows(table.read()) == [(1, "a", 202401), (2, "B", 202402), (3, "c", 202403), (4, "d", 202404)]
    same = before.keys() & files(table.path).keys()
    assert {f.split("month=")[1][:6] for f in same} == {"202401", "202403"}


def test_rows_that_move_leave_one_copy(spark, rows, tmp_path):
    table = publish.stored_table(spark, str(tmp_path / "m"), MONTHLY, ["k"], partition="month")
    table.replace(spark.createDataFrame([(1, "a", 202401), (2, "b", None), (3, "c", 202402), (4, "d", 202402)], MONTHLY))
    moved = spark.createDataFrame([(1, "A", None), (2, "B", 202403), (3, "C", 202401)], MONTHLY)
    want = [(1, "A", None), (2, "B", 202403), (3, "C", 202401), (4, "d", 202402)]
    for _ in range(2):
        table.merge(moved)
        assert rows(table.read()) == want
    table.merge(spark.createDataFrame([(1, "A", 202401)], MONTHLY))
    assert rows(table.read()) == [(1, "A", 202401), *want[1:]]


@pytest.mark.parametrize("values", [(202101, None, 202102), (dt.date(2021, 1, 1), None, dt.date(2021, 2, 1)), ("x:y", None, "a b/c=d%"), ("01", "", "1")])
def test_partition_values_of_every_kind_keep_their_rows(spark, rows, tmp_path, values):
    kind = {int: "int", dt.date: "date", str: "string"}[type(values[0])]
    schema = f"k int, v string, part {kind}"
    a, b, c = values
    table = publish.stored_table(spark, str(tmp_path / "p"), schema, ["k"], partition="part")
    table.replace(spark.createDataFrame([(1, "a", a), (2, "b", b), (3, "c", b), (4, "d", c)], schema))
    table.merge(spark.createDataFrame([(2, "B", b), (4, "D", c), (5, "e", a)], schema))
    none = b or None
    assert rows(table.read()) == sorted([(1, "a", a), (2, "B", none), (3, "c", none), (4, "D", c), (5, "e", a)], key=repr)
    assert table.read().schema["part"].dataType.simpleString() == kind
    table.replace(spark.createDataFrame([(6, "f", c)], schema))
    assert rows(table.read()) == [(6, "f", c)]


def test_lines_of_changed_parents_by_month(spark, rows, tmp_path):
    schema = "k int, n int, v string, month int"
    table = publish.stored_table(spark, str(tmp_path / "l"), schema, ["k", "n"], partition="month")
    table.replace(spark.createDataFrame([(1, 1, "a", 202401), (1, 2, "b", 202401), (2, 1, "c", 202401), (3, 1, "d", 202402), (4, 1, "e", None), (5, 1, "f", 202403)], schema))
    before = files(table.path)
    parents = spark.createDataFrame([(1, 202401), (4, None), (4, 202404), (4, None)], "k int, month int")
    table.replace_children(parents, spark.createDataFrame([(1, 1, "A", 202401), (4, 1, "E", 202404), (2, 9, "never", 202401), (5, 9, "never", 202403)], schema), "k")
    assert rows(table.read()) == [(1, 1, "A", 202401), (2, 1, "c", 202401), (3, 1, "d", 202402), (4, 1, "E", 202404), (5, 1, "f", 202403)]
    assert {f.split("month=")[1][:6] for f in before.keys() & files(table.path).keys()} == {"202402", "202403"}


def test_a_table_by_day_prunes(spark, rows, tmp_path):
    day = lambda n: dt.date(2024, 1, n)
    schema = "k int, v string, sale_date date"
    table = publish.stored_table(spark, str(tmp_path / "d"), schema, ["k"], partition="sale_date")
    table.replace(spark.createDataFrame([(n, "a", day(n)) for n in range(1, 11)], schema))
    out = table.read().where(F.col("sale_date") <= F.lit(day(3)))
    assert rows(out.select("k")) == [(1,), (2,), (3,)]
    assert "PartitionFilters: [isnotnull(sale_date" in out._jdf.queryExecution().executedPlan().toString()
