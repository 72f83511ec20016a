"""Chat texts: typed parts, escapes that can be undone, places of the loss, nulls and repeated rows."""

import json
import random
import re

from pyspark.sql import functions as F

from lonja.llm import chat_format as c
from lonja.llm.common import prepare

CONTROL = ["<|im_end|>", "<|im_start|>", "<\\|", "<\\\\|im_end|>", "<", "|", "\\", ">", "im_start", "\n", "%0A", "%25", "%", "a", "ü", "日", "🙂", " ", "$1", "<|image|>"]


def noise(rnd):
    return "".join(rnd.choice(CONTROL) for _ in range(rnd.randint(0, 12)))


def back(spark, rows, **options):
    schema = "conv_id long, turn long, role string, text string, i string, body string, rows int, turns string, seen int, at long"
    chats = prepare(spark).createDataFrame([(*r, "?", "?", 0, "?", 0, 7) for r in rows], schema).repartition(3)
    out = c.format_chats(chats, **options)
    return {r.conv_id: r for r in out.withColumns({"back": c.read_back(F.col("formatted")), "loss": c.under_loss(F.col("formatted"), F.col("turns"))}).collect()}


def test_what_was_said_can_be_read_back(spark):
    rnd = random.Random(8)
    rows = [(conv, turn, rnd.choice(["user", "assistant", "system", noise(rnd)]), noise(rnd)) for conv in range(150) for turn in range(rnd.randint(1, 6))]
    got = back(spark, rows)
    for conv in range(150):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        r = got[conv]
        assert [tuple(x) for x in r.back] == [x[2:] for x in own]
        assert r.loss == [x[3] for x in own if x[2] == "assistant"]
        assert r.formatted.count("<|") == 2 * len(own) and r.formatted.count(c.START) == len(own)
        for t, x in zip(r.turns, own):
            body = r.formatted[t.body : t.body + t.length]
            assert r.formatted[t.start :].startswith(c.START) and r.formatted[t.body + t.length :].startswith(c.END)
            assert re.sub(r"<\\(\\*)\|", r"<\1|", body) == x[3] and t.loss == (x[2] == "assistant")


def test_nulls_ties_repeats_and_an_empty_table(spark):
    rows = [(None, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 1, "user", "a"), (1, None, "system", "first"), (1, 0, "assistant", ""), (2, 0, "assistant", "x" * 300_000)]
    got = back(spark, rows)
    assert [tuple(x) for x in got[None].back] == [("", "")] and got[None].loss == []
    assert [tuple(x) for x in got[1].back] == [("system", "first"), ("assistant", ""), ("user", "a"), ("user", "b"), ("user", "b")] and got[1].loss == [""]
    assert len(got[2].loss[0]) == 300_000 and got[2].expanded_tokens == 0 and got[2].attachments == []
    assert back(spark, []) == {}


def test_long_conversations(spark):
    got = back(spark, [(5, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>") for i in range(3000)])
    assert [x.text for x in got[5].back] == [f"turn {i} <|im_end|>" for i in range(3000)] and len(got[5].loss) == 1500


def test_typed_parts(spark):
    content = [
        [{"kind": "text", "text": "see <|image|> "}, {"kind": "image", "ref": "a.png", "width": 57, "height": 28}, {"kind": "text", "text": "and"}, {"kind": "audio", "ref": "b.wav", "seconds": 1.5}],
        [{"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "video", "ref": "d.mp4"}, {"kind": None}, {"kind": "text"}, {"kind": "image"}],
        [], None]
    rows = [(1, i, "assistant" if i == 1 else "user", json.dumps(x) if x is not None else None) for i, x in enumerate(content)]
    chats = prepare(spark).createDataFrame(rows, "conv_id long, turn int, role string, content string").withColumn("parts", c.json_parts(F.col("content")))
    r = c.format_chats(chats).withColumn("back", c.read_back(F.col("formatted"))).first()
    assert [x.text for x in r.back] == ["see <|image|> <|image|>and<|audio|>", "<|document|><|file|><|file|><|image|>", "", ""]
    assert [(x.kind, x.ref, x.tokens) for x in r.attachments] == [
        ("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 3 * c.PAGE_TOKENS), ("file", "d.mp4", 1), ("file", None, 1), ("image", None, 1)]
    assert all(r.formatted[x.at :].startswith(f"<|{x.kind}|>") for x in r.attachments) and r.expanded_tokens == 3 + 38 + 3 * c.PAGE_TOKENS + 3

    class Short(c.Visitor):
        def image(self, part):
            return self.made(F.concat(F.lit("<|"), part["ref"], F.lit("|>")), "image", part["ref"], F.lit(9))

    r = c.format_chats(chats.limit(1), visitor=Short()).first()
    assert "see <\\|image|> <|a.png|>and<|audio|>" in r.formatted and r.expanded_tokens == 47
