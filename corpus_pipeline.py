"""Cleaning and packing a corpus: each stage works on all documents that the one before kept.

Every stage but the last returns the columns of ``documents``, further ones included, whatever their names.  Null and
empty texts count as equal: one of them stays.  Equal rows with one ``doc_id`` share their fate; a null id is an id
like any other, but never the smallest.  Texts of any length are read whole.  An empty table passes every stage as
one.  Near duplicates take shingles of five words and a similarity of 0.8.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from lonja.llm.common import documents, prepare
from lonja.llm.exact_dedup import drop_exact
from lonja.llm.minhash import drop_near
from lonja.llm.packing import pack
from lonja.llm.personal_data import redact
from lonja.llm.toxicity import drop_toxic
from lonja.session import written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    prepare(spark)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    prepare(spark)
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    prepare(spark)
    return drop_near(docs, size=5, percent=80)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes its kind in angle brackets."""
    prepare(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    prepare(spark)
    return pack(docs)


STAGES = [("toxicity", toxicity), ("exact dedup", exact), ("near dedup", near), ("personal data", personal), ("packing", packing)]
#: Learned and tokenised stages cannot be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    def step(docs: DataFrame, stage) -> DataFrame:
        name, apply = stage
        return written(apply(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return functools.reduce(step, STAGES, documents(spark, sf_dir))
