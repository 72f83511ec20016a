"""Identifiers in blocks, short ones and long ones are candidates, and contexts discover them."""

from lonja.llm import personal_data
from lonja.llm.common import prepare


def candidates(text):
    return {text[x[0] : x[1]] for x in personal_data.entities(text) if x[2] is None}


def test_candidates_of_any_length_and_in_blocks():
    assert "017 555 7713" in candidates("ring 017 555 7713 today")
    assert "(017) 555-7713" in candidates("ring (017) 555-7713, today")
    assert "0171 22" in candidates("a@b.de 0171 22 4x +1 (017) 555-7713")
    assert candidates("pin 42 and " + "7" * 300) == {"42", "7" * 300}
    for long in ("1 " * 30_000, "1" + " " * 50_000, "(" * 50_000, "1 x" * 20_000, "+1" * 30_000, "1." * 30_000 + "x"):
        personal_data.entities(long)


def test_contexts_discover_a_national_number(spark):
    rows = [(i, f"some words then ring +1 (017) 555-{1000 + i} today and more words") for i in range(40)]
    docs = prepare(spark).createDataFrame([*rows, (100, "please ring 017 555 7713 today thanks"), (101, "ring me")], "doc_id long, text string")
    found = {r.doc_id: [tuple(x) for x in r.added] for r in personal_data.find(docs).collect()}
    assert found.pop(100) == [(12, 24, "phone")] and not any(found.values())
