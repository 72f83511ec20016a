"""Periodic runs against a search by definition."""

import hashlib
import random
import zlib

import numpy as np

from lonja.llm import catalog
from lonja.llm.common import documents, prepare
from lonja.llm.periodic_runs import PRIME, WORD, collapsed, find_runs, mismatches, runs_of

SF = "/root/testdata/sf0.001"


def brute(words):
    """Start, end and smallest period of each maximal run, period by period."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q) and not any(s <= i and j + q <= e for s, e, p in found):
                found.append((i, j + q, q))
            i = max(j, i + 1)
    return sorted(found)


def test_sums_of_squared_differences():
    rnd = np.random.default_rng(1)
    for width in (1, 2, 8, 32):
        blocks, windows = rnd.integers(0, 1 << 30, (5, width)), rnd.integers(0, 1 << 30, (5, 2 * width))
        windows[3, :width] = blocks[3]
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(blocks[i], windows[i, s:])) % PRIME for s in range(width)] for i in range(5)]
        got = mismatches(blocks, windows)
        assert got.tolist() == want and got[3, 0] == 0


def test_runs_equal_those_by_definition():
    rnd = random.Random(3)
    for _ in range(1500):
        n, kinds = rnd.randint(0, 130), rnd.randint(1, 6)
        words = [rnd.randrange(kinds) for _ in range(n)]
        for _ in range(rnd.randint(0, 3) if n > 8 else 0):
            period, start = rnd.randint(1, max(1, n // 4)), rnd.randrange(n)
            for i in range(start + period, rnd.randint(start, n)):
                words[i] = words[i - period]
        assert sorted(runs_of(np.array(words, np.int64))) == brute(words), words


def test_long_texts():
    for words, want in (([0] * 50_000, [(0, 50_000, 1)]), ([*range(3000)] * 40, [(0, 120_000, 3000)]),
                        (([0] * 50 + [1]) * 30, [(51 * i, 51 * i + 50, 1) for i in range(30)] + [(0, 1530, 51)])):
        assert sorted(runs_of(np.array(words, np.int64))) == sorted(want)


def test_documents(spark):
    texts = [(1, None), (2, ""), (3, " \n"), (4, "a a a a a a"), (4, "a a a a a a"), (None, "x y " * 5), (5, "a a a a a"), (6, "ü\x1c é " * 6 + "end"), (7, "b " * 30_000)]
    docs = prepare(spark).createDataFrame([(i, t, "?", 1) for i, t in texts], "doc_id long, text string, runs string, start int")
    rows = find_runs(docs.repartition(2)).collect()
    got = sorted((r.doc_id or 0, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in rows)
    assert got == [(0, 10, ((0, 10, 2),), "x y"), (1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 6, ((0, 6, 1),), "a"), (4, 6, ((0, 6, 1),), "a"),
                   (5, 5, (), "a a a a a"), (6, 13, ((0, 12, 2),), "ü\x1c é end"), (7, 30_000, ((0, 30_000, 1),), "b")]
    assert find_runs(docs.limit(0)).collect() == []


def test_query(spark):
    rows = {r.doc_id: r for r in catalog.op12_periodic_runs(spark, SF).collect()}
    docs = documents(spark, SF).collect()
    assert len(rows) == len(docs) and any(r.n_runs for r in rows.values())
    for d in docs:
        words = WORD.findall(d.text or "")
        code = zlib.crc32(str(d.doc_id).encode())
        if code % 10 == 0 and words:
            a = code // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + code // 10 % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = [(s, e - s, q) for s, e, q in brute(words)]
        runs.sort(key=lambda r: (r[0], r[2]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
        kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                                         hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())
        assert kept == collapsed(words, runs)
