"""Every registered query against its SQL, exactly, on the smallest tables."""

import re

import pytest

import __spark_entry__ as contract
from lonja.catalog import CATALOG
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, SQL = CATALOG.queries, CATALOG.sql


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name not in SQL:
        assert QUERIES[name](spark, SF).count() >= 0
        return
    problem, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
    assert problem is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "family" in df.columns


def test_the_contract_names_every_query():
    assert QUERIES.keys() <= contract.queries().keys() and SQL.keys() <= contract.oracle_sql().keys()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cartesian_products_and_no_python(spark):
    lazy = [n for n in QUERIES if not n.startswith(("j", "a12", "a14", "a15", "a16_replace_children_by", "c18", "k15", "f5", "g4", "e11_10")) and not n.endswith("from_changes") and "history" not in n]
    plans = {n: plan_of(QUERIES[n](spark, SF)) for n in lazy}
    assert [n for n, p in plans.items() if "CartesianProduct" in p or "EvalPython" in p or "InPandas" in p] == []


@pytest.mark.parametrize("name,scans", [
    ("e1_1_4_7_retail_kpis", {"orders": 1}), ("e1_11_top_families", {"lineitem": 1, "orders": 1}), ("e2_8_sales_by_store", {"orders": 1}),
    ("e7_2_4_period_sales", {"orders": 1}), ("e8_3_period_cards", {"orders": 1}), ("e8_4_filled_series", {"orders": 1}),
    ("e8_8_store_scorecard", {"orders": 1}), ("e8_12_margin_series", {"lineitem": 1, "orders": 1}), ("f4_weekly_anomaly", {"orders": 1}),
    ("e10_5_year_comparison", {"orders": 1}), ("e8_6_store_streaks", {"orders": 1}), ("c17_comparison_overlay", {"orders": 1}),
    ("b16_panel_options", {"lineitem": 1, "orders": 1}), ("e11_1_shrinkage", {"lineitem": 6}), ("e11_1_net_movement", {"lineitem": 5})])
def test_big_tables_are_read_once(spark, name, scans):
    df = QUERIES[name](spark, SF)
    df.collect()
    final = plan_of(df).split("== Initial Plan")[0]
    found = re.findall(r"FileScan parquet.*?/(\w+)\.parquet", final)
    assert {t: found.count(t) for t in scans} == scans


def test_dates_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        plan = plan_of(QUERIES["e2_8_sales_by_store"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,2001-05-17" in plan and "o_orderpriority" not in plan
