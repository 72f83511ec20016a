import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lonja.operators import merge


def frame(spark, data, schema="k int, v string, at int"):
    return spark.createDataFrame(data, schema)


def test_upsert_last_change_wins(spark, rows):
    target = frame(spark, [(1, "a", 1), (2, "b", 1)])
    changes = frame(spark, [(2, "old", 2), (2, "new", 3), (3, "c", 2)])
    merged = merge.upsert(target, changes, ["k"], ["at"])
    assert rows(merged) == [(1, "a", 1), (2, "new", 3), (3, "c", 2)]
    again = merge.upsert(merged, changes, ["k"], ["at"])
    assert rows(again) == rows(merged)


def test_upsert_overwrites_with_null(spark, rows):
    target = frame(spark, [(1, "a", 1)])
    assert rows(merge.upsert(target, frame(spark, [(1, None, 2)]), ["k"], ["at"])) == [(1, None, 2)]


def test_upsert_needs_keys_and_handles_all_key_tables(spark, rows):
    target = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        merge.upsert(target, target, [])
    changed = merge.upsert(target, spark.createDataFrame([(1, 2), (3, 4), (3, 4)], "a int, b int"), ["a", "b"])
    assert rows(changed) == [(1, 2), (3, 4)]


def test_insert_ignore_never_modifies(spark, rows):
    target = frame(spark, [(1, "a", 1)])
    out = merge.insert_ignore(target, frame(spark, [(1, "zzz", 9), (2, "b", 2), (2, "b", 2)]), ["k"])
    assert rows(out) == [(1, "a", 1), (2, "b", 2)]


def test_hot_key_is_folded_before_the_shuffle(spark):
    changes = spark.range(20000).select(F.lit(7).alias("k"), F.col("id").cast("string").alias("v"), F.col("id").cast("int").alias("at"))
    newest = merge.latest_per_key(changes, ["k"], ["at"])
    assert [tuple(r) for r in newest.collect()] == [(7, "19999", 19999)]
    plan = newest._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan


def test_rows_with_maps(spark):
    df = spark.createDataFrame([(1, {"a": "x"}, 1), (1, {"b": "y"}, 2)], "k int, m map<string,string>, at int")
    assert [tuple(r) for r in merge.latest_per_key(df, ["k"], ["at"]).collect()] == [(1, {"b": "y"}, 2)]


def test_replace_children(spark, rows):
    lines = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "p int, l string")
    fresh = spark.createDataFrame([(1, "x"), (2, "never"), (3, "y")], "p int, l string")
    parents = spark.createDataFrame([(1,), (1,), (3,)], "p int")
    assert rows(merge.replace_children(lines, parents, fresh, "p")) == [(1, "x"), (2, "c"), (3, "y"), (None, "d")]


def test_delta_filter_is_inclusive(spark, rows):
    df = spark.createDataFrame([(1, dt.date(2024, 5, 1)), (2, dt.date(2024, 5, 2)), (3, None)], "i int, d date")
    mark = dt.datetime(2024, 5, 3, 9, tzinfo=dt.timezone.utc)
    assert rows(merge.delta_filter(df, "d", mark).select("i")) == [(2,)]
    assert rows(merge.delta_filter(df, "d", mark, 2, include_nulls=True).select("i")) == [(1,), (2,), (3,)]
    assert merge.delta_filter(df, "d", None).count() == 3


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 50)), max_size=12, unique_by=lambda r: r[0]),
       st.lists(st.tuples(st.integers(0, 9), st.integers(0, 50)), max_size=25, unique_by=lambda r: r[1]))
def test_merges_agree_with_a_dictionary(spark, target, changes):
    """Change rows carry their own order (the value), repeats included."""
    t = spark.createDataFrame([(k, v, 0) for k, v in target], "k int, v int, at int")
    c = spark.createDataFrame([(k, v, v + 1) for k, v in changes], "k int, v int, at int")
    want = dict(target)
    for k, v in sorted(changes, key=lambda r: r[1]):
        want[k] = v
    assert {r["k"]: r["v"] for r in merge.upsert(t, c, ["k"], ["at"]).collect()} == want
    kept = {r["k"]: r["v"] for r in merge.insert_ignore(t, c, ["k"]).collect()}
    assert set(kept) == set(want) and all(kept[k] == v for k, v in target)


def test_an_older_change_loses_to_the_target(spark, rows):
    target = frame(spark, [(1, "new", 9), (2, "b", 1), (None, "n", 1)])
    changes = frame(spark, [(1, "old", 3), (2, "B", 1), (None, "N", 2), (None, "x", 1)])
    assert rows(merge.upsert(target, changes, ["k"], ["at"])) == [(1, "new", 9), (2, "B", 1), (None, "N", 2)]


def test_repeats_and_null_keys_without_an_order(spark, rows):
    target = frame(spark, [(1, "a", 1)])
    changes = frame(spark, [(1, "b", 2), (1, "c", 1), (None, "n", 1), (2, "d", 5), (2, "e", 4)])
    once = merge.upsert(target, changes, ["k"])
    assert len(rows(once)) == 3 and rows(merge.upsert(once, changes, ["k"])) == rows(once)
    kept = merge.insert_ignore(target, changes, ["k"])
    assert len(rows(kept)) == 3 and rows(merge.insert_ignore(kept, changes, ["k"])) == rows(kept)


def test_rows_of_one_source_do_not_meet_themselves(spark, rows):
    source = frame(spark, [(1, "a", 1), (2, "b", 2), (3, "c", 3)])
    out = merge.upsert(source.where("k < 3"), source.where("k > 1").withColumn("v", F.upper("v")), ["k"], ["at"])
    assert rows(out) == [(1, "a", 1), (2, "B", 2), (3, "C", 3)]
