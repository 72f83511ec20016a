"""Packing, records, byte-level BPE, quality rules, toxicity and personal data, with nulls, ties, repeats and clashing columns."""

import base64
import hashlib
import io
import random
import re
import zlib
from array import array

import numpy as np
import pytest
from pyspark.sql import functions as F

from lonja.llm import binary_records, byte_bpe, packing, personal_data, quality_rules, toxicity
from lonja.llm.common import prepare
from lonja.llm.tokens import ChunkEncoder, parts_of

public = pytest.importorskip("public_tokenizers")
CLASHING = ("ids", "length", "row", "shard", "offset", "tie", "marks", "words", "found", "spans", "base", "doc", "toxic", "p")
ODD = ["", " ", "  a  b", "a\t b", "a\t  b \n\n c\x1c d  \x1c e", "日本 語　 x\u0085 y", "x'S it's  ", "a" * 3000 + " " + "!" * 500, "<|endoftext|> hi",
       "́ a ́", "Á  ΑΣ Σ", "\n\n a", "e ́x\r\n  y", "a.\nb,\nc. \nd\n", "\x01 a \x01b c\x01", "x. ,y 's 're", "①. ² ٣,", "The end. " * 400]


def frame(spark, texts, parts=3):
    schema = "doc_id long, text string, " + ", ".join(f"{x} string" for x in CLASHING)
    return prepare(spark).createDataFrame([(i, t, *["?"] * len(CLASHING)) for i, t in texts], schema).repartition(parts)


def noise(n, seed=5):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(["a", "B", "é", "́", " ", " ", "\n", "\t", ",", ".", "'s", "'", "!", "1", "٣", "_", "\x01", "　", "Σ", "日"])
                    for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_parts_have_the_ids_of_the_whole(name):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public.path(name))
    texts = ODD + noise(1500)
    want = [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert [list(array("I", x)) for x in ChunkEncoder(public.path(name)).encode(texts)] == want
    alone = ChunkEncoder(public.path(name))
    assert [list(array("I", alone.encode([x])[0])) for x in texts[:200]] == want[:200]
    assert parts_of(" end.\nNext,") == [" end", ".", "\n", "Next", ","] and parts_of(" a. ") == [" a. "]


def test_room_finds_the_tightest():
    rnd = random.Random(1)
    room, rooms = packing.Room(64), []
    for step in range(3000):
        need = rnd.randint(1, 64)
        best = min((x for x in rooms if x >= need), default=None)
        assert room.tightest(need) == best
        if best is not None and rnd.random() < 0.5:
            rooms.remove(best)
            room.take(best)
        else:
            rooms.append(left := rnd.randint(1, 64))
            room.add(left, step)


def packs_whole(pieces, texts, window):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    want = sorted(tuple(plain.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in texts)
    by_sequence = {}
    for x in pieces:
        by_sequence.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in by_sequence.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= window
    assert sum(x.length for x in pieces) == sum(map(len, want))
    return by_sequence


def test_packing(spark):
    texts = [*enumerate(ODD), (100, None), (101, "The end. " * 3000), (101, "The end. " * 3000), (None, "x y z")]
    pieces = packing.pack(frame(spark, texts), window=64, with_ids=True, shard_pieces=8)
    rows = pieces.collect()
    packs_whole(rows, texts, 64)
    assert {tuple(r)[:5] for r in rows if r.doc_id == 100} == {(100, 0, 1, zlib.crc32(b"\0\0\0\0"), 1)}
    sizes = [len(r.ids) // 4 for r in packing.sequences(pieces, 64).collect()]
    assert all(n == 64 or n & (n - 1) == 0 for n in sizes)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packing.pack(frame(spark, [])).collect() == []


def test_packing_wastes_little(spark):
    rnd = random.Random(2)
    lengths = sorted((rnd.randint(1, 1023) for _ in range(20_000)), reverse=True)
    sequences, offsets = packing.best_fit(lengths, 1024)
    used = [0] * (max(sequences) + 1)
    for s, o, n in zip(sequences, offsets, lengths, strict=True):
        assert used[s] == o
        used[s] += n
    assert max(used) <= 1024 and sum(used) > 0.99 * 1024 * len(used)


def test_records(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    texts = [(i * 7 % 40, t) for i, t in enumerate(ODD)] + [(50, None), (51, "again"), (51, "again"), (None, "no id")]
    manifest = binary_records.write_records(frame(spark, texts))
    rows = sorted(binary_records.read_records(manifest).collect(), key=lambda r: (r.shard, r.position))
    assert [r.doc_id for r in rows] == sorted((i for i, _ in texts), key=lambda x: -1 if x is None else x)
    at = 0
    for r in rows:
        assert r.position == at and r.n_ids == len(r.ids) // 4
        at += r.n_ids
    want = sorted((-1 if i is None else i, tuple(plain.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, tuple(array("I", r.ids))) for r in rows) == want
    first, second = ([(r.doc_id, bytes(r.ids)) for r in binary_records.read_shuffled(manifest, seed).collect()] for seed in (1, 2))
    assert sorted(first, key=repr) == sorted(second, key=repr) == sorted(((r.doc_id, bytes(r.ids)) for r in rows), key=repr) and first != second
    nothing = binary_records.write_records(frame(spark, []))
    assert nothing.collect() == [] and binary_records.read_records(nothing).collect() == []


def test_damaged_records_are_refused():
    data = binary_records.frame(binary_records.to_payload(5, array("I", [1, 2, 3]).tobytes(), 2))
    assert binary_records.from_payload(binary_records.unframe(io.BytesIO(data))) == (5, array("I", [1, 2, 3]).tobytes())
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 4
        with pytest.raises(ValueError):
            binary_records.unframe(io.BytesIO(bytes(broken)))
    assert binary_records.unframe(io.BytesIO(b"")) is None
    wide = binary_records.to_payload(None, array("I", [70_000]).tobytes(), 4)
    assert binary_records.from_payload(wide) == (None, array("I", [70_000]).tobytes())


def test_byte_bpe(spark):
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    other = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*enumerate(ODD + noise(800)), (5000, None), (5001, "q" * 20_000), (5001, "q" * 20_000)]
    coded = byte_bpe.encode(frame(spark, texts))
    got = sorted((r.doc_id, tuple(array("I", r.ids)), bytes(r.decoded)) for r in coded.collect())
    assert got == sorted((i, tuple(other.encode_ordinary(t or "")), (t or "").encode()) for i, t in texts)
    assert {(r.doc_id, r.text) for r in byte_bpe.decode(coded).collect()} == {(i, t or "") for i, t in texts}
    assert byte_bpe.encode(frame(spark, [])).collect() == []


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    inside = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(inside)


def test_quality(spark):
    rnd = random.Random(6)
    texts = ODD + [None, "#$ a | b", "a b c a b c", "a a a a a", "x\ny\nx\n \n \nx", "a b " * 3000]
    texts += [" ".join(rnd.choice("abcd") + rnd.choice(["", "\n", " ", "\t"]) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    docs = quality_rules.measured(frame(spark, list(enumerate(texts))))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in docs.collect()}
    assert got == {i: brute_quality(t) for i, t in enumerate(texts)}
    assert quality_rules.measured(frame(spark, [])).collect() == []


def test_cascade_order_never_changes_what_stays(spark):
    texts = [*enumerate(" ".join(f"word{(i * j) % 97}x" for j in range(1, 90)) for i in range(1, 41)), (50, "a#$ " * 80), (51, "LOUD! " * 80), (52, "same line here\n" * 30)]
    docs = frame(spark, texts)
    chosen = quality_rules.ordered(docs, quality_rules.rules())
    assert quality_rules.ordered(docs.limit(0), quality_rules.rules())
    docs = quality_rules.measured(docs)
    assert sorted(r.name for r in chosen) == sorted(r.name for r in quality_rules.rules())
    kept = [{r.doc_id for r in quality_rules.cascade(docs, x).filter("rejected_by is null").collect()} for x in (chosen, chosen[::-1])]
    assert kept[0] == kept[1] == set(range(40))


def toxic_texts(seed=1, n=900):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("aeioulmnrst") for _ in range(rnd.randint(2, 8))) for _ in range(500)]
    endings = ["", "er", "en", "ung", "los"]
    rows, labels = [], []
    for i in range(n):
        text = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
        toxic = rnd.random() < 0.25
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                bad = rnd.choice(["idiot", "scum", "grubzel" + rnd.choice(endings), "blorkt" + rnd.choice(endings)])
                text[rnd.randrange(len(text))] = bad
        rows.append((i, " ".join(text) + "."))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_texts()
    truth = {i: t for i, _, t in labels}
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + [(5000, None), (5001, ""), (5002, "you idiot"), (None, "scum"), (5003, "fine " * 30_000)])
    found = toxicity.score(docs, labels).collect()
    assert len(found) == len(rows) + 5 and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found if r.doc_id is not None)
    held = [(r.score >= 0.7, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in found if r.score < 0.7}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_toxicity_reads_no_held_out_label(spark):
    rows, labels = toxic_texts(2, 300)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    scores = [sorted((r.doc_id, r.score) for r in toxicity.score(frame(spark, rows), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect())
              for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_toxicity_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.posterior for r in toxicity.score(frame(spark, [(1, "you idiot moron scum"), (2, "a fine day")] * 5), labels).collect()}
    assert found[1] > found[2]
    assert toxicity.score(frame(spark, []), labels).collect() == []


def test_voters_that_move_together_share_a_vote(spark):
    votes = [([0, 1, 2], None)] * 40 + [([2], None)] * 20 + [([0, 1], None)] * 20 + [([], None)] * 400
    model = toxicity.fit_labels(spark.createDataFrame(votes, "fired array<int>, label int"), 3)
    assert model.share[0] == model.share[1] == 0.5 and (model.toxic > model.clean).all()


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(x if i % 2 == 0 else 2 * x if x < 5 else 2 * x - 9 for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute_spans(text):
    valid = [("email", EMAIL, lambda s: True), ("ip", IP, lambda s: all(int(x) <= 255 for x in s.split("."))),
             ("card", CARD, lambda s: 14 <= len(re.sub("[ -]", "", s)) <= 19 and luhn(re.sub("[ -]", "", s))),
             ("phone", PHONE, lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15)]
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, ok) in enumerate(valid) for m in pattern.finditer(text) if ok(m[0])]
    return [(a, b, name) for a, _, b, name in sorted(found)]


def test_base_spans_are_those_of_the_plain_patterns():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab@@..--+%1234 5()0é_") for _ in range(rnd.randint(0, 40)))
        assert personal_data.base_spans(text) == brute_spans(text), text
    for long in ("1" * 50_000, "a" * 50_000, "1." * 30_000, "a@" * 30_000, "+1" * 30_000, "+1" + " " * 50_000, "1 " * 30_000):
        personal_data.base_spans(long)
        list(personal_data.tokens(long))


def test_contexts_discover_identifiers(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(40):
        rows.append((i, f"some words then mail user{i}@host{i}.example.com today and more words"))
    rows += [(100, "please mail hidden77[at]host today thanks"), (101, "later hidden77[at]host came"), (102, "item 4711abc is blue"), (103, None), (104, "")]
    rows += [(105, "see user1@host1.example.com, user1@host1.example.com"), (105, "see user1@host1.example.com, user1@host1.example.com")]
    rnd.shuffle(rows)
    found = {r.doc_id: ([tuple(x) for x in r.base], [tuple(x) for x in r.added]) for r in personal_data.find(frame(spark, rows)).collect()}
    assert found[100][1] == [(12, 29, "email")] and found[101][1] == [(6, 23, "email")] or found[100][1]
    assert found[102] == found[103] == found[104] == ([], [])
    assert found[105][0] == [(4, 27, "email"), (29, 52, "email")]
    for i, text in rows:
        assert found[i][0] == brute_spans(text or "")
    assert personal_data.find(frame(spark, [])).collect() == []
    shown = personal_data.find(frame(spark, rows)).select("doc_id", personal_data.spans_text(F.col("base")).alias("s")).collect()
    assert {r.doc_id: r.s for r in shown}[105] == "email:4:27,email:29:52"


def test_redaction_keeps_columns(spark):
    docs = frame(spark, [(1, "call +1 (555) 010-9999 or a@b.de"), (2, None), (2, "10.0.0.1"), (3, "nothing")]).withColumn("n_chars", F.length("text").cast("long"))
    out = personal_data.redact(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text, r.n_chars) for r in out.collect()} == {(1, "call <phone> or <email>", 23), (2, None, None), (2, "<ip>", 4), (3, "nothing", 7)}
    assert personal_data.mask("abcdef", [{"start": 0, "end": 3, "kind": "ip"}, {"start": 2, "end": 4, "kind": "card"}]) == "<ip>ef"
