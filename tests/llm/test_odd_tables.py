"""The pipeline's stages in a chain on odd tables, and what sizes and thresholds follow the data."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lonja.llm import toxicity
from lonja.llm.common import LEAST_BITS, MOST_BITS, bit_set, bits_for, in_bit_set, prepare

SF = "/root/testdata/sf0.001"
CLASHING = ("ids", "label", "spans", "found", "open", "doc", "component_id", "sequence_id", "offset")


def save(spark, folder, rows, labels):
    """A folder with both tables, ``documents`` with more columns than it should have."""
    prepare(spark)
    kinds = {f.name: f.dataType for f in spark.read.parquet(f"{SF}/documents.parquet").schema}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select(*[F.col(n).cast(t) if n in docs.columns else F.length("text").cast(t).alias(n) if n == "n_chars" else F.lit(None).cast(t).alias(n)
                         for n, t in kinds.items()], *[F.lit("?").alias(x) for x in CLASHING])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs.columns


def chain(spark, folder, columns):
    """The rows that each stage leaves."""
    docs, left = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/{name.replace(' ', '-')}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        left[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    return left


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60_000))
    near = " ".join(f"n{i}" for i in range(200))
    rows = [(1, None), (2, ""), (3, "  "), (4, "you idiot moron scum trash loser"), (5, long), (6, long + "\n"), (7, near), (8, near + " end"),
            (9, "mail a@b.de now"), (9, "mail a@b.de now"), (None, "a row without an id"), (10, "x" * 300_000), (11, "a fine day")]
    toxic = [(i, f"you idiot moron scum trash loser t{i}") for i in range(100, 140)]
    clean = [(i, f"a fine c{i} day of d{i} sort") for i in range(200, 280)]
    rows += toxic + clean
    labels = [(i, 1) for i, _ in toxic] + [(i, 0) for i, _ in clean]
    columns = save(spark, str(tmp_path), rows, labels)
    left = chain(spark, str(tmp_path), columns)
    others = Counter(i for i, _ in clean)
    ids = {name: Counter(r.doc_id for r in some) for name, some in left.items()}
    assert ids["toxicity"] == Counter(x for x, t in rows if x != 4 and (x, t) not in toxic)
    # of equal texts the longest stays, then the smallest id; two rows with one id and text stay together
    assert ids["exact dedup"] == Counter([3, 6, 7, 8, 9, 9, None, 10, 11]) + others
    assert ids["near dedup"] == ids["personal data"] == Counter([3, 6, 7, 9, 9, None, 10, 11]) + others
    assert Counter(r.text for r in left["personal data"] if r.doc_id == 9) == {"mail <email> now": 2}
    pieces = left["packing"]
    assert {r.doc_id for r in pieces} == set(ids["near dedup"])
    assert all(0 < r.length and r.offset + r.length <= 1024 for r in pieces)
    for doc_id in (3, 6, 7, 10, 11):
        own = sorted((r.start, r.length) for r in pieces if r.doc_id == doc_id)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == next(r.doc_tokens for r in pieces if r.doc_id == doc_id)
    places = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    for (s, a, n), (t, b, _) in zip(places, places[1:], strict=False):
        assert b == (a + n if s == t else 0)


def test_empty_tables(spark, tmp_path):
    columns = save(spark, str(tmp_path), [], [])
    assert all(some == [] for some in chain(spark, str(tmp_path), columns).values())


def test_only_null_and_empty_texts(spark, tmp_path):
    columns = save(spark, str(tmp_path), [(1, None), (2, None), (3, "")], [(1, 0), (2, 0)])
    left = chain(spark, str(tmp_path), columns)
    assert [len(x) for x in left.values()] == [3, 1, 1, 1, 1]
    assert [(r.doc_id, r.length, r.doc_tokens) for r in left["packing"]] == [(1, 1, 1)]


def test_bit_sets_follow_their_keys(spark):
    assert bits_for(0) == bits_for(1) == bits_for(LEAST_BITS // 16) == LEAST_BITS
    assert bits_for(LEAST_BITS // 16 + 1) == 2 * LEAST_BITS and bits_for(1 << 40) == MOST_BITS
    keys = spark.range(400_000).select(F.xxhash64("id").alias("k"))
    words = bit_set(keys, F.col("k"))
    assert words.select(F.size("words")).first()[0] * 64 == 2 * LEAST_BITS
    got = spark.range(800_000).filter(in_bit_set(words.scalar(), F.xxhash64("id")))
    assert got.filter("id < 400000").count() == 400_000
    assert got.filter("id >= 400000").count() < 400_000 / 16


@pytest.mark.parametrize("rows,cut", [
    ([(1, 3.0)] * 9 + [(1, 0.0)] + [(0, -3.0)] * 10, 0.0),             # one more toxic row at no loss
    ([(1, 3.0)] * 9 + [(1, -3.0)] + [(0, -3.0)] * 10, math.log(7 / 3)),  # all clean rows lie there too
    ([(1, 3.0)] * 10 + [(0, -3.0)] * 10, math.log(7 / 3)),             # never above the threshold
    ([(1, 3.0)], math.log(7 / 3)), ([], math.log(7 / 3))])
def test_base_is_raised_where_it_finds_more(spark, rows, cut):
    got = toxicity.raise_of_base(spark.createDataFrame(rows, "label int, z double"))
    assert abs(got - (math.log(7 / 3) - cut)) <= toxicity.STEP
    assert all(z + got >= math.log(7 / 3) for label, z in rows if label and z >= cut)
