"""Every registered query of the package on the smallest tables, and what each stage of the pipeline must leave."""

import re

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from lonja.llm.catalog import QUERIES, SQL
from lonja.llm.common import documents
from lonja.llm.personal_data import base_spans
from oracle import compare, connect
from test_dedup import brute_near

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        problem, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF)
        assert problem is None
    else:
        assert QUERIES[name](spark, SF).count() >= con.sql("SELECT count(*) FROM documents").fetchall()[0][0]


@pytest.mark.parametrize("name", ["op3_quality_rules", "op8_line_dedup", "op11_chat_format"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_the_contract_has_them():
    assert {*QUERIES, "pipeline"} <= contract.queries().keys() and SQL.keys() <= contract.oracle_sql().keys()
    assert sorted(int(re.match(r"op(\d+)_", x)[1]) for x in QUERIES) == list(range(1, 14))


def test_stages(spark, tmp_path):
    docs = documents(spark, SF)
    columns, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name.replace(" ", "-"))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    texts = {r.doc_id: r.text for r in documents(spark, SF).collect()}
    order = [[r.doc_id for r in left[name]] for name, _ in corpus_pipeline.STAGES]
    for before, after in zip(order, order[1:]):
        assert set(after) <= set(before)
    plain = [re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in left["exact dedup"]]
    assert len(plain) == len(set(plain)) and {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in left["toxicity"]} == set(plain)
    near = brute_near([(r.doc_id, r.text) for r in left["exact dedup"]], 5, 80)
    assert {i for i, _, _, kept in near if kept} == {r.doc_id for r in left["near dedup"]}
    for r in left["personal data"]:
        assert base_spans(r.text) == [] and (r.text == texts[r.doc_id] or re.search("<(email|ip|card|phone)>", r.text))
        assert r.n_chars == len(r.text)
    assert set(order[3]) == set(order[4]) and max(r.offset + r.length for r in left["packing"]) <= 1024
