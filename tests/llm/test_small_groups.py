"""Marks of a small group of toxic rows vote when they are significant."""

from lonja.llm import toxicity
from lonja.llm.common import prepare


def test_few_rows_are_enough_when_they_are_significant(spark):
    toxic = [(i, "some grubzel here") for i in range(300)] + [(i, "una bomentera aqui") for i in range(300, 305)]
    clean = [(i, f"some words una aqui here n{i}") for i in range(305, 1205)]
    docs = prepare(spark).createDataFrame(toxic + clean, "doc_id long, text string")
    sample = spark.createDataFrame([(i, int(i < 305)) for i in range(1205)], "doc_id long, toxic int")
    names, voters = toxicity.vocabulary(docs, sample)
    assert {"grubzel", "bomentera"} <= {names[i] for i in voters}
    assert not {"some", "una", "aqui", "here"} & {names[i] for i in voters}
