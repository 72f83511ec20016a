"""Collocations against counting by definition, with and without ranks for all words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lonja.llm import collocations as c
from lonja.llm.common import prepare

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, shown):
    total, f = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\v\f\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            total[lang or "und"] += len(words)
            for m in range(1, 6):
                f.update((lang or "und", tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    f = {k: a for k, a in f.items() if a >= least}
    inside = {(lang, g[i:j]): a for (lang, g), a in sorted(f.items(), key=lambda x: x[1]) for i in range(len(g)) for j in range(i + 2, len(g) + 1) if j - i < len(g)}
    out = []
    for (lang, g), a in f.items():
        if len(g) > 1 and inside.get((lang, g), 0) < a:
            n = total[lang]
            score, k = min((1000 * a * n // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
            out.append((lang, " ".join(g), a, f[lang, g[:k]], f[lang, g[k:]], n, score))
    ranked = []
    for lang in sorted({x[0] for x in out}):
        some = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:shown]
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(some, 1)]
    return ranked


def texts(n=400, seed=2):
    rnd = random.Random(seed)
    words = ["the", "The", "of", "ÉLAN", "élan", "x\x1cy", "日本", "a b", "New", "york", "<|x|>", "\x00", *(f"w{i}" for i in range(60))]
    phrases = ["new york city hall the", "w1 w2 w3 w4 w5 w6 w7", "of of of of of of of"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice([rnd.choice(words), rnd.choice(words[:8]), rnd.choice(phrases)]) + rnd.choice([" ", " ", " ", "\t ", ". ", ",", "\n", "\r\n"])
                       for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice(["en", "en", "en", "de", None, "und"]), text))
    return [*rows, ("en", None), ("en", ""), ("en", " \n"), *rows[:5], ("fr", "a b " * 30_000)]


def found(spark, rows, **options):
    docs = prepare(spark).createDataFrame([(i, t, lang, "?", 1) for i, (lang, t) in enumerate(rows)],
                                          "doc_id long, text string, lang string, n string, w1 int").repartition(3)
    out = c.collocations(docs, **options)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("ranks, fan_in", [(1 << 18, 64), (1 << 18, 2), (32, 64), (2, 64)])
def test_phrases_equal_those_by_definition(spark, monkeypatch, ranks, fan_in):
    monkeypatch.setattr(c, "FAN_IN", fan_in)
    rows = texts()
    want = brute(rows, 5, 60)
    assert found(spark, rows, least=5, shown=60, ranks=ranks) == want and len(want) > 100


def test_slices_and_parts_cut_no_phrase(spark, monkeypatch):
    rows = texts(80, 7)
    known = c.number_words(c.word_counts(prepare(spark).createDataFrame(rows, "lang string, text string")
                                         .selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text")), 3, 1 << 18)[1]
    assert set(known[0]) == {"en", "de", "und", "fr"}
    # places of a slice are counted by it alone, however the text is cut
    words = np.array([0, 1, 0, 1, 2, 0, 1, -1, 0, 1] * 20)
    at, rank = c.extended(words, [])
    whole = Counter(zip(rank.tolist(), words[at + 1].tolist()))
    parts = Counter()
    for i in range(0, len(words), 7):
        some = words[i : i + 7 + c.LONGEST - 1]
        at, rank = c.extended(some, [])
        parts.update((a, b) for k, a, b in zip(at.tolist(), rank.tolist(), some[at + 1].tolist()) if k < 7)
    assert parts == whole


def test_tiles_equal_a_plain_count():
    rnd = np.random.default_rng(4)
    for bits in (1, 5, 10, 12, 18):
        first, second = np.minimum(rnd.geometric(0.002, (2, 30_000)), (1 << bits) - 1)
        codes, cell_bits = c.tiled(first, second, bits)
        assert len(set(codes.tolist())) == len(set(zip(first.tolist(), second.tolist())))
        for dense in (1, 500, 1 << 30):
            got, sums = {}, {}
            for tile, cells, counts in c.tally(codes, cell_bits, dense):
                assert (np.diff(cells) > 0).all()
                again = c.unpacked(c.packed(cells, counts))
                assert (again[0] == cells).all() and (again[1] == counts).all()
                got.update(zip((tile << cell_bits | cells).tolist(), counts.tolist()))
                total = c.TileSum(cell_bits, dense)
                total.add(cells, counts)
                total.add(cells[:3], counts[:3])
                total.add(cells[1:], counts[1:])
                sums.update(zip((tile << cell_bits | total.total()[0]).tolist(), total.total()[1].tolist()))
            assert got == Counter(codes.tolist()) and sums.keys() == got.keys()
            assert sum(sums.values()) > sum(got.values())
    assert list(c.tally(np.zeros(0, np.int64), 16)) == []
    rows = rnd.integers(0, 3, (500, 3))
    got = c.row_tally(rows)
    assert {tuple(r): n for r, n in zip(got[0].tolist(), got[1].tolist())} == Counter(map(tuple, rows.tolist()))


def test_no_documents_and_no_phrases(spark):
    assert found(spark, []) == [] and found(spark, [("en", "a b c"), (None, None)]) == []


def test_scores_beyond_64_bits(spark):
    rows = [("en", "p q. " * 20_000 + "x " * 3)]
    assert found(spark, rows, least=100) == brute(rows, 100, 2000)
    text = "(cast(1000 as decimal(38, 0)) * cast(90000000000000 as decimal(19, 0)) * cast(4000000000000000 as decimal(19, 0))) div (cast(3 as decimal(19, 0)) * cast(70000000000000001 as decimal(19, 0)))"
    assert spark.sql(f"select {text}").first()[0] == 1000 * 90000000000000 * 4000000000000000 // (3 * 70000000000000001)
