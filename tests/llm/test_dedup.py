"""Exact, line, passage and near duplicates against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lonja.llm import front_coding, suffix_dedup
from lonja.llm.common import bit_set, in_bit_set, join_groups, prepare
from lonja.llm.components import components
from lonja.llm.exact_dedup import drop_exact, exact_groups
from lonja.llm.line_dedup import drop_shared_lines
from lonja.llm.minhash import _circle, drop_near, near_groups, overlaps
from lonja.llm.suffix_dedup import kept_text, remove_repeats

#: names that the operators use inside
CLASHING = ("own", "id", "doc", "text_hash", "size", "n", "key", "row", "bands", "spans", "kept", "group_size", "_hot")
SCHEMA = "doc_id long, text string, " + ", ".join(f"{x} string" for x in CLASHING)


def frame(spark, texts, parts=3):
    """Rows (doc_id, text) with extra columns of clashing names."""
    rows = [(i, t, *[f"{x}{i}" for x in CLASHING]) for i, t in texts]
    return prepare(spark).createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.fixture
def empty(spark):
    return frame(spark, [])


def test_exact(spark, empty):
    texts = [(5, "a b"), (3, "ab"), (9, " a b "), (4, "c"), (7, "c"), (1, None), (2, ""), (8, "\t\n"), (6, "d"), (6, "d"), (None, "c"), (10, "x" * 100_000),
             (11, "x" * 99_999 + " x")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_groups(frame(spark, texts)).collect()}
    assert got == {(5, 9, 3, False), (3, 9, 3, False), (9, 9, 3, True), (4, 4, 3, True), (7, 4, 3, False), (None, 4, 3, False),
                   (1, 8, 3, False), (2, 8, 3, False), (8, 8, 3, True), (6, 6, 2, True), (10, 11, 2, False), (11, 11, 2, True)}
    hashes = {r.doc_id: r.text_hash for r in exact_groups(frame(spark, texts), hash_all=True).collect()}
    assert bytes(hashes[9]) == hashlib.sha256(b"ab").digest()
    assert exact_groups(empty).collect() == []


def test_exact_drop_keeps_columns(spark, empty):
    docs = frame(spark, [(1, "a"), (2, "a "), (3, None), (4, "b"), (4, "a")])
    out = drop_exact(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} == {(2, "a "), (3, None), (4, "b")}
    assert drop_exact(empty).collect() == []


def test_exact_only_open_groups_are_hashed(spark):
    got = {r.doc_id: r.text_hash for r in exact_groups(frame(spark, [(1, "one"), (2, "three"), (3, "four"), (4, "four")])).collect()}
    assert got[1] is None and got[2] is None and got[3] == got[4] is not None


def brute_lines(texts, least_chars=20, least_docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    docs, largest = Counter(), {}
    for i, t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            docs[k] += 1
            largest[k] = max(largest.get(k, -1), i)
    out = []
    for i, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= least_chars and docs[key(x)] >= least_docs and largest[key(x)] != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


@pytest.mark.parametrize("batches", [1, 4, 7])
def test_lines(spark, batches):
    rnd = random.Random(batches)
    lines = ["The same long line of text " + x for x in "abcdef"] + ["short", "", "  Padded line that is long enough\t", "ÄÖ long line with letters ÄÖÜ"]
    texts = [(i, "\n".join(rnd.choice([str.upper, str, lambda x: x + " "])(rnd.choice(lines)) for _ in range(rnd.randint(0, 6)))) for i in range(40)]
    texts += [(40, None), (41, ""), (42, "\n\n"), (43, lines[0] + "\n" + lines[0]), (44, "z" * 50_000)]
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in drop_shared_lines(frame(spark, texts), batches=batches).collect())
    assert got == brute_lines(texts)


def test_lines_null_ids_and_empty(spark, empty):
    line = "a line that is long enough"
    got = {(r.doc_id, r.text) for r in drop_shared_lines(frame(spark, [(None, line), (1, line), (2, line), (2, line)])).collect()}
    assert got == {(None, ""), (1, ""), (2, line)}
    assert drop_shared_lines(empty).collect() == []


def brute_passages(texts, length):
    places = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if places[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1]))
        out.append((len(t), sum(gone), runs, bytes(c for c, x in zip(t, gone, strict=True) if not x)))
    return out


@pytest.mark.parametrize("heavy", [1 << 18, 2, 0])
def test_passages(spark, heavy):
    rnd = random.Random(heavy)
    base = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 900))) for _ in range(12)]
    texts = [*base, "a" * 1500, "ab" * 700, "", "x" * 199, "y" * 200, "y" * 200, base[0], base[0]]
    for _ in range(25):
        a, b = rnd.choice(base), rnd.choice(base)
        i, j = sorted((rnd.randint(0, len(a)), rnd.randint(0, len(a))))
        texts.append(b[:100] + a[i:j] + b[100:])
    rows = [*enumerate(texts), (None, None), (3, None)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(frame(spark, rows), heavy=heavy).collect())
    want = brute_passages([t.encode() for t in texts], 200)
    assert got == sorted([(i, *x) for i, x in enumerate(want)] + [(-1, 0, 0, 0, b""), (3, 0, 0, 0, b"")])


def test_passages_of_repeated_rows_and_empty(spark, empty):
    long = "".join(chr(97 + (i * i) % 23) + str(i) for i in range(200))
    got = [(r.doc_id, r.n_removed) for r in remove_repeats(frame(spark, [(1, long), (1, long), (2, "q" + long[:150])])).collect()]
    assert sorted(got) == [(1, len(long)), (1, len(long)), (2, 0)]
    assert remove_repeats(empty).collect() == []


def test_slabs_see_each_window_once(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLAB", 500)
    text = random.Random(1).randbytes(2345)
    starts = []
    for base, slab in suffix_dedup.slabs(text, 200):
        places, _, firsts, lasts = suffix_dedup.anchors(slab, 200, 64)
        for place, first, last in zip(places, firsts, lasts, strict=True):
            assert first <= place <= first + 136 and place <= last + 136 and last <= place
            starts += range(base + first, base + last + 1)
    assert starts == list(range(2345 - 200 + 1))


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(2)
    shared = rnd.randbytes(300)
    found = []
    for head in (rnd.randbytes(77), rnd.randbytes(301)):
        slab = head + shared + rnd.randbytes(50)
        places, hashes, firsts, lasts = suffix_dedup.anchors(slab, 200, 64)
        window = {}
        for place, value, first, last in zip(places, hashes, firsts, lasts, strict=True):
            window.update({s: (place - len(head), value) for s in range(first, last + 1)})
        found.append([window[len(head) + i] for i in range(101)])
    assert found[0] == found[1]


def test_runs_and_loser_tree():
    rnd = random.Random(3)
    for _ in range(200):
        runs = [sorted(front_coding.Suffix(bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 9))), b"xy", 0, 1, False, r, i, i)
                       for i in range(rnd.randint(0, 12))) for r in range(rnd.randint(1, 9))]
        packed = [front_coding.pack_run(x) for x in runs]
        assert [[s for _, s in front_coding.unpack_run(p)] for p in packed] == runs
        before, seen = b"", []
        for shares, suffix in front_coding.merge([front_coding.unpack_run(p) for p in packed]):
            assert shares == front_coding.common(before, suffix.right) and before <= suffix.right
            before = suffix.right
            seen.append(suffix.right)
        assert seen == sorted(x.right for run in runs for x in run)
    assert list(front_coding.merge([])) == []


def test_loser_tree_skips_known_prefixes(monkeypatch):
    looked = []
    real = front_coding.common
    monkeypatch.setattr(front_coding, "common", lambda a, b, known=0: looked.append(known) or real(a, b, known))
    runs = [[front_coding.Suffix(b"p" * 150 + bytes([x]), b"", 0, 0, False, 0, 0, 0) for x in range(r, 250, 5)] for r in range(5)]
    packed = [front_coding.pack_run(x) for x in runs]
    looked.clear()
    assert len(list(front_coding.merge([front_coding.unpack_run(x) for x in packed]))) == 250
    assert sum(1 for x in looked if x < 150) <= 8  # the first round only


def test_kept_text():
    assert kept_text(b"abcdefghij", [{"low": 1, "high": 2}, {"low": 7, "high": 7}], 2) == (b"aefgj", 5, 2)
    assert kept_text(b"abc", [], 2) == (b"abc", 0, 0)


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))} if words else set()


def brute_near(texts, size, percent):
    sets = [shingles(t, size) for _, t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (doc_id, _) in enumerate(texts):
        least[root(i)] = min(least[root(i)], doc_id)
    return sorted((doc_id, len(sets[i]), least[root(i)], doc_id == least[root(i)]) for i, (doc_id, _) in enumerate(texts))


@pytest.mark.parametrize("size", [2, 5])
def test_near(spark, size):
    rnd = random.Random(size)
    words = [f"w{i}" for i in range(300)]
    texts = []
    for length in (1, 2, 5, 6, 12, 40, 40, 120, 400):
        base = [rnd.choice(words) for _ in range(length)]
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, length // 8))):
                copy[rnd.randrange(length)] = rnd.choice(words)
            texts.append((rnd.choice([str.upper, str])(" ".join(copy))))
    rnd.shuffle(texts)
    texts += ["", None, "  \n", "one", "ONE", "É é", "é É"]
    rows = list(enumerate(texts))
    got = sorted(tuple(r)[:4] for r in near_groups(frame(spark, rows), size=size).collect())
    assert got == brute_near(rows, size, 80)


def test_near_chain_beyond_the_center(spark):
    """A chain in which each text links with the next only: star comparisons alone would cut it."""
    words = [f"x{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 60])) for i in range(40)]
    got = sorted(tuple(r)[:4] for r in near_groups(frame(spark, rows), size=2).collect())
    assert got == brute_near(rows, 2, 80) and {r[2] for r in got} == {0}


def test_near_null_ids_repeats_and_empty(spark, empty):
    text = "a b c d e f g h"
    docs = frame(spark, [(None, text), (4, text), (4, text), (2, text + " i"), (7, None), (9, "z y x w v")])
    assert {tuple(r)[:4] for r in near_groups(docs, size=2).collect()} == {
        (None, 7, 2, False), (4, 7, 2, False), (2, 8, 2, True), (7, 0, 7, True), (9, 4, 9, True)}
    out = drop_near(docs, size=2)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [2, 7, 9]
    assert near_groups(empty).collect() == [] and drop_near(empty).collect() == []


def test_circle_is_one_shifted_permutation():
    circle = _circle(364)
    assert (circle[5][1:] == circle[6][:-1]).all() and len(set(circle[:, 0].tolist())) == len(circle) - 1


def test_overlaps_agree():
    import numpy as np
    rnd = random.Random(4)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randint(1, 30))), np.uint64) for _ in range(12)]
    want = [[len(set(a) & set(b)) for b in sets[6:]] for a in sets[:6]]
    assert overlaps(sets[:6], sets[6:]).tolist() == want
    assert overlaps(sets[:2], sets[6:]).tolist() == want[:2]


def test_components(spark, rows):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99), (7, 7)], "a long, b long")
    assert rows(components(links)) == rows(spark.createDataFrame([(i, 0) for i in range(51)] + [(99, 99), (100, 99)], "node long, label long"))
    assert components(links.limit(0)).collect() == []


def test_bit_set_has_no_false_negatives(spark):
    keys = spark.range(0, 3000).withColumn("k", F.xxhash64("id"))
    words = bit_set(keys, F.col("k"), 1 << 12)
    got = spark.range(0, 6000).filter(in_bit_set(words.scalar(), F.xxhash64("id")))
    assert got.filter("id < 3000").count() == 3000


def test_join_groups_with_a_hot_group(spark):
    data = spark.range(5000).withColumn("key", F.when(F.col("id") < 2500, 0).otherwise(F.col("id")))
    groups = data.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1 or key % 7 = 0")
    got = join_groups(data, groups, ["key"], "size")
    assert got.count() == 5000 and got.filter("key = 0 and size = 2500").count() == 2500
    assert got.filter("size is null").count() == got.filter("key % 7 <> 0").count()
