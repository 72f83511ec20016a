"""Personal data: fixed patterns, then bootstrapped contextual extraction.

The first pass finds e-mail addresses, IP addresses, card and phone numbers (the base spans) and, besides them,
everything that could be an identifier: a token without white space, of any length after its edges are stripped,
with a digit or an at sign; and a run of digits in blocks with spaces, brackets, dots or hyphens between, as long as
it goes between two base spans.  Each has lexical patterns: the word before it, the word after it, both together, and
its shape.

Base entities are seeds.  In each round Spark scores the graph of patterns and distinct instances: a pattern's
confidence for a kind is the mean score of its instances, damped for few of them; an instance's score is
one less the chance that all its confident patterns err.  Instances that reach the threshold are discovered, and all
their occurrences become spans of that kind.  Seeds keep a score of one, and base spans always stay.

Null and empty texts have no spans.  All scans are linear in the length of a text.  Repeated rows get their
own equal results; an empty table gives none.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import frugal, text_of
from lonja.session import written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
PATTERN_CONFIDENCE, INSTANCE_SCORE, DAMPING = 0.8, 0.9, 2.0

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive repeats and a start at a digit run only: the same matches as the plain patterns, in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
BLANK = re.compile(r"\s")
EDGES = ".,;:!?()[]{}\"'|#*$%&<>="
SHORT = 6
# a block that goes on as a word ends the run before it
BLOCKS = re.compile(r"(?<!\w)[+(]?(?<!\w)[0-9]++(?!\w)(?:[ ().-]++[0-9]++(?!\w))++")

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.string()),
                  ("before", pa.string()), ("after", pa.string()), ("shape", pa.string())])
SPAN_SQL = "struct<start:bigint,end:bigint,kind:string,instance:string,before:string,after:string,shape:string>"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def is_ip(found: str) -> bool:
    parts = (x.lstrip("0") for x in found.split("."))
    return all(len(x) <= 3 and int(x or 0) <= 255 for x in parts)


def is_card(found: str) -> bool:
    digits = [int(x) for x in found if x not in " -"] if len(found) <= 37 else []
    if not 14 <= len(digits) <= 19:
        return False
    doubled = [x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def is_phone(found: str) -> bool:
    return 10 <= sum(map(found.count, "0123456789")) <= 15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Valid matches, leftmost and not overlapping within a kind, by start and kind."""
    found = [(a, b, "email") for a, b in emails(text)]
    if HINT.search(text):
        for kind, pattern, valid in (("ip", IP, is_ip), ("card", CARD, is_card), ("phone", PHONE, is_phone)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if valid(m[0])]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def shape_of(token: str) -> str:
    """Digit runs with their lengths, letter runs without."""
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"9{{{len(m[0])}}}", token))


def word_before(text: str, at: int) -> str:
    end = at
    while end and text[end - 1].isspace():
        end -= 1
    start = end
    while start and end - start < 64 and not text[start - 1].isspace():
        start -= 1
    return text[start:end].strip(EDGES[:-1]).lower()


def word_after(text: str, at: int) -> str:
    start = at
    while start < len(text) and (text[start].isspace() or text[start] in EDGES):
        start += 1
    match = BLANK.search(text, start, start + 64)
    return text[start : match.start() if match else min(len(text), start + 64)].strip(EDGES).lower()


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """Tokens with a digit or an at sign, without their edges."""
    found = HINT.search(text)
    while found:
        start, stop = found.start(), BLANK.search(text, found.start())
        end = stop.start() if stop else len(text)
        while start and not text[start - 1].isspace():
            start -= 1
        raw = text[start:end]
        left = len(raw) - len(raw.lstrip(EDGES))
        right = len(raw.rstrip(EDGES))
        yield start + left, start + right
        found = HINT.search(text, end)


def blocks(text: str, edges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of digit blocks with a space in them, between the sorted base spans."""
    at = 0
    for start, end in [*edges, (len(text), len(text))]:
        for match in BLOCKS.finditer(text, at, start) if at < start else ():
            if " " in match[0]:
                yield match.span()
        at = max(at, end)


def entities(text: str) -> list[tuple]:
    """The base spans, and the possible identifiers that overlap none of them, whose kind is null."""
    base = base_spans(text)
    edges = sorted((a, b) for a, b, _ in base)
    free, i, reach = [], 0, 0
    for a, b in tokens(text):
        while i < len(edges) and edges[i][0] < b:
            reach = max(reach, edges[i][1])
            i += 1
        if reach <= a:
            free.append((a, b, None))
    runs = list(blocks(text, edges))
    starts = [a for a, _ in runs]
    out = []
    for a, b, kind in [*base, *free, *((a, b, None) for a, b in runs)]:
        # the words around a run tell of the run, not of a short block in it
        run = bisect_right(starts, a) - 1
        inner = kind is None and b - a < SHORT and run >= 0 and b <= runs[run][1] and (a, b) != runs[run]
        around = ("", "") if inner else (word_before(text, a), word_after(text, b))
        out.append((a, b, kind, text[a:b].lower(), *around, shape_of(text[a:b])))
    return out


def extract(docs: DataFrame) -> DataFrame:
    """row, doc_id, text_hash and the entities of each document."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(SPAN.names, x, strict=True)) for x in entities(t)] for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], batch["text_hash"], pa.array(found, pa.list_(SPAN))], ["row", "doc_id", "text_hash", "found"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"),
                       F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"))
    return rows.mapInArrow(frugal(look), f"row long, doc_id long, text_hash long, found array<{SPAN_SQL}>")


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance, kind, score of the discovered identifiers, from occurrences with their patterns."""
    patterns = F.filter(F.array(
        F.when(F.col("before") != "", F.struct(F.lit("before").alias("slot"), F.col("before").alias("value"))),
        F.when(F.col("after") != "", F.struct(F.lit("after").alias("slot"), F.col("after").alias("value"))),
        F.when((F.col("before") != "") & (F.col("after") != ""),
               F.struct(F.lit("both").alias("slot"), F.concat_ws("\t", "before", "after").alias("value"))),
        F.struct(F.lit("shape").alias("slot"), F.col("shape").alias("value"))), lambda x: x.isNotNull())
    edges = written(occurrences.select("instance", F.explode(patterns).alias("pattern")).distinct(), "pii-edges")
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    seeds = written(occurrences.filter("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("score")), "pii-seeds")
    open_edges = edges.join(seeds.select("instance").distinct(), "instance", "left_anti")
    scored = seeds
    for turn in range(rounds):
        sums = edges.join(scored, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        confident = sums.join(sizes, "pattern").withColumn("confidence", F.col("score") / (F.col("instances") + DAMPING)).filter(
            F.col("confidence") >= PATTERN_CONFIDENCE)
        found = open_edges.join(confident, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.999)))))).alias("score")).filter(F.col("score") >= INSTANCE_SCORE)
        scored = seeds.unionByName(written(found, f"pii-round-{turn}"))
    best = scored.join(seeds.select("instance").distinct(), "instance", "left_anti").groupBy("instance").agg(
        F.max_by(F.struct("kind", "score"), F.struct("score", "kind")).alias("best"))
    return best.select("instance", "best.kind", "best.score")


def find(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, text_hash, and arrays ``base`` and ``added`` of spans (start, end, kind)."""
    rows = written(extract(docs), "pii-rows")
    plain = rows.withColumn("base", F.transform(F.filter("found", lambda x: x["kind"].isNotNull()),
                                                lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    occurrences = rows.select("row", F.explode("found").alias("x")).select("row", "x.*")
    known = bootstrap(occurrences, rounds)
    added = occurrences.filter("kind is null").drop("kind").join(known, "instance").groupBy("row").agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("added"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    return plain.join(added, "row", "left").select("doc_id", "text_hash", "base", F.coalesce("added", none).alias("added"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda x: F.struct(x["start"], order[x["kind"]], x["end"], x["kind"].alias("kind")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; ``n_chars``, where there is one, follows."""
    spans = find(docs, rounds).withColumn("spans", F.sort_array(F.concat("base", "added"))).filter(F.size("spans") > 0)
    spans = spans.select(F.col("doc_id").alias("id"), "text_hash", "spans").dropDuplicates(["id", "text_hash"])
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("own"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("text_hash"))
    joined = rows.join(spans, same, "left").select("doc", "spans")
    names = docs.columns

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch["doc"].flatten(), strict=True))
            text = columns["text"]
            texts = [mask(t, s) if s else t for t, s in zip(text.to_pylist(), batch["spans"].to_pylist(), strict=True)]
            columns["text"] = pa.array(texts, text.type)
            if "n_chars" in columns:
                kind = columns["n_chars"].type
                columns["n_chars"] = pa.array([len(t) if s else n for t, s, n in zip(
                    texts, batch["spans"].to_pylist(), columns["n_chars"].to_pylist(), strict=True)], kind)
            yield pa.RecordBatch.from_pydict(columns)

    return joined.mapInArrow(frugal(replace), docs.schema)


def mask(text: str, spans: list[dict]) -> str:
    """Overlapping spans become one, of the kind of the first."""
    out, done = [], 0
    for span in spans:
        if span["start"] >= done:
            out += [text[done : span["start"]], f"<{span['kind']}>"]
        done = max(done, span["end"])
    return "".join(out) + text[done:]
