"""Removing repeated passages: sorted suffixes, exchanged front-coded and merged with known prefixes.

A byte goes when a ``length``-byte string that covers it starts anywhere else in the corpus too.

1. Every window of ``length`` bytes has an anchor: the least of the hashes of its ``GRAM``-byte strings.  Equal
   windows have equal anchors at the same offset, and neighbouring windows mostly share theirs, so there is an
   anchor for about every 70 bytes.  Only windows whose anchor's string occurs twice can be repeated.
2. The suffixes at those anchors, with the few bytes before them that their windows reach, are sorted in runs.
   Equal ones of a run are settled there and kept once.
3. Runs are cut at splitters and sent front-coded; each task merges its pieces with a loser tree that never
   compares a known prefix again.  Suffixes that share less than an anchor's string end a group.  In a group, the
   shared lengths of neighbours bound which windows can have a partner; those are matched as bytes.

An anchor's string that occurs more than ``HEAVY`` times has its windows sorted one by one instead: then equal ones
collapse in their run, and no group has more than one row for each run.

Texts are UTF-8 bytes, and null ones are empty.  Matches never cross texts; those shorter than ``length`` lose nothing.
Long texts are cut into slabs that overlap, so that no window is missed or seen twice.  Rows that repeat are places of
their own and lose what they share.  An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import bit_set, in_bit_set, join_groups, text_of
from lonja.llm.front_coding import Suffix, common, merge, pack_run, unpack_run
from lonja.session import written

LENGTH, GRAM = 200, 64
SLAB = 1 << 20
HEAVY = 1 << 18
RUN_BYTES = 48 << 20
TARGET_GRAMS = 60_000  # anchors that a merging task gets, about
NO_ID = -(1 << 63)
LOW = np.uint64((1 << 24) - 1)
BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    def powers(x: int) -> np.ndarray:
        steps = np.full(size + 1, x, np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)
    return powers(BASE), powers(pow(BASE, -1, 1 << 64))


def slabs(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """Pieces of a text that together have each window once."""
    for start in range(0, max(len(text) - length + 1, 0), SLAB - length + 1):
        yield start, text[start : start + SLAB]


def anchors(slab: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a slab: places of the anchors, their hashes, the first and the last window that each one has."""
    power, inverse = _powers(SLAB)
    data = np.frombuffer(slab, np.uint8).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * power[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    hashes = (sums[gram:] - sums[:n]) * inverse[:n]
    order = (hashes & ~LOW) | np.arange(n, dtype=np.uint64)
    width = length - gram + 1
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = order
    rows = padded.reshape(-1, width)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = len(data) - length + 1
    least = np.minimum(down[:windows], up[width - 1 : width - 1 + windows]) & LOW
    firsts = np.flatnonzero(np.diff(least, prepend=np.uint64(1 << 60)))
    places = least[firsts].astype(np.int64)
    lasts = np.append(firsts[1:], windows) - 1
    return places, hashes[places].view(np.int64), firsts, lasts


def _doc_keys(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.xxhash64(text_of()).alias("text_hash"), text_of().cast("binary").alias("text"))


def all_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """doc_id, text_hash, the hashes of all anchors in their order, and the first bytes of one of them."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, probes = [], []
            for text in batch["text"].to_pylist():
                hashes, probe = [np.zeros(0, np.int64)], None
                for _, slab in slabs(text, length):
                    places, own, _, _ = anchors(slab, length, gram)
                    hashes.append(own)
                    probe = slab[places[own.argmin()] :][:7]
                found.append(np.concatenate(hashes))
                probes.append(probe)
            offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["text_hash"], lists, pa.array([x and int.from_bytes(x.ljust(7, b"\0"), "big") for x in probes], pa.int64())],
                ["doc_id", "text_hash", "hashes", "probe"])

    long = _doc_keys(docs.filter(F.octet_length("text") >= length))
    return long.mapInArrow(look, "doc_id long, text_hash long, hashes array<long>, probe long")


def open_anchors(found: DataFrame, heavy: int) -> tuple[DataFrame, int]:
    """doc_id, text_hash and the numbers of the anchors whose string occurs twice: twice the place in their order,
    one more where the string is heavy.  And how many such strings there are."""
    each = found.select("doc_id", "text_hash", F.posexplode("hashes").alias("number", "hash"))
    counts = written(each.groupBy("hash").agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), "suffix-grams")
    total = counts.agg(F.sum("times")).first()[0] or 0
    number = F.col("number") * 2 + (F.col("times") > heavy).cast("int")
    hits = join_groups(each, counts, ["hash"], "times").filter("times is not null")
    return written(hits.groupBy("doc_id", "text_hash").agg(F.collect_set(number).alias("open")), "suffix-open"), total


def suffixes_of(doc_id: int, text_hash: int, text: bytes, numbers: list[int], length: int, gram: int) -> Iterator[Suffix]:
    """The suffixes at the open anchors of a text."""
    heavy = {x >> 1: x & 1 for x in numbers}
    seen = 0
    for base, slab in slabs(text, length):
        places, _, firsts, lasts = anchors(slab, length, gram)
        for i, (place, first, last) in enumerate(zip(places.tolist(), firsts.tolist(), lasts.tolist(), strict=True), seen):
            kind = heavy.get(i)
            if kind == 0:
                yield Suffix(slab[place : last + length], slab[first:place][::-1], place - last, place - first, False, doc_id, text_hash, base + place)
            elif kind:
                for start in range(first, last + 1):
                    yield Suffix(slab[start : start + length], b"", 0, 0, False, doc_id, text_hash, base + start)
        seen += len(places)


class Run:
    """Suffixes of one run; equal ones are settled at once."""

    def __init__(self):
        self.first: dict[tuple, Suffix] = {}
        self.twice: dict[tuple, bool] = {}
        self.bytes = 0

    def add(self, x: Suffix) -> list[tuple[int, int, int, int]]:
        """The places that are repeated by now, as doc_id, text_hash, first and last window."""
        key = x[:4]
        other = self.first.setdefault(key, x)
        if other is x:
            self.bytes += len(x.right) + len(x.left) + 200
            return []
        out = [window_range(x, x.low, x.high)]
        if key not in self.twice:
            self.twice[key] = True
            out.append(window_range(other, other.low, other.high))
        return out

    def pieces(self, splitters: list[int]) -> Iterator[tuple[int, bytes]]:
        """The sorted run, cut at the splitters."""
        cut: dict[int, list[Suffix]] = {}
        for key in sorted(self.first):
            x = self.first[key]
            x = x._replace(known=True, doc_id=0, text_hash=0, at=0) if key in self.twice else x
            cut.setdefault(bisect_right(splitters, int.from_bytes(x.right[:7], "big")), []).append(x)
        for target, some in cut.items():
            yield target, pack_run(some)


def window_range(x: Suffix, low: int, high: int) -> tuple[int, int, int, int]:
    """Windows that start ``low`` to ``high`` bytes before the anchor."""
    return x.doc_id, x.text_hash, x.at - high, x.at - low


def touching(ranges: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Ranges of windows with those of one text that touch as one, so that a repeated passage is one row."""
    out: list[tuple[int, int, int, int]] = []
    for x in sorted(ranges):
        if out and out[-1][:2] == x[:2] and x[2] <= out[-1][3] + 1:
            out[-1] = (*out[-1][:3], max(out[-1][3], x[3]))
        else:
            out.append(x)
    return out


SENT = "target int, doc_id long, text_hash long, low long, high long, run binary"
RANGE = "doc_id long, text_hash long, low long, high long"


def sent_runs(texts: DataFrame, splitters: list[int], length: int, gram: int) -> DataFrame:
    """Pieces of runs by target, and settled places (target -1)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = Run()

        def settled(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array([-1] * len(rows), pa.int32()), *[pa.array(x, pa.int64()) for x in columns], pa.nulls(len(rows), pa.binary())], names)

        def flush() -> Iterator[pa.RecordBatch]:
            for target, data in current.pieces(splitters):
                yield pa.RecordBatch.from_arrays([pa.array([target], pa.int32()), *[pa.nulls(1, pa.int64())] * 4, pa.array([data], pa.binary())], names)

        for batch in batches:
            done = []
            for doc_id, text_hash, text, numbers in zip(*(batch[x].to_pylist() for x in ("doc_id", "text_hash", "text", "open")), strict=True):
                own: list[tuple[int, int, int, int]] = []
                for x in suffixes_of(doc_id, text_hash, text, numbers, length, gram):
                    own += current.add(x)
                done += touching(own)
                if current.bytes > RUN_BYTES:
                    yield from flush()
                    current = Run()
            yield settled(done)
        yield from flush()

    names = [x.split()[0] for x in SENT.split(", ")]
    return texts.select("doc_id", "text_hash", "text", "open").mapInArrow(run, SENT)


def matches(group: list[tuple[int, Suffix]], length: int) -> list[tuple[int, int, int, int]]:
    """Repeated windows of a group, sorted suffixes with what each shares with the one before."""
    if len(group) == 1:
        return []
    shared = [*[x for x, _ in group[1:]], 0]
    # no window can reach further back than its text shares with any other's
    by_left = sorted(range(len(group)), key=lambda i: group[i][1].left)
    alike = [0, *(common(group[a][1].left, group[b][1].left) for a, b in zip(by_left, by_left[1:])), 0]
    back = [0] * len(group)
    for k, i in enumerate(by_left):
        back[i] = max(alike[k], alike[k + 1])
    seen: dict[bytes, int] = {}
    marks: dict[int, set[int]] = {}
    before = 0
    for i, (_, x) in enumerate(group):
        reach = max(before, shared[i])
        before = shared[i]
        for offset in range(max(x.low, length - reach), min(x.high, back[i]) + 1):
            window = offset.to_bytes(2, "little") + x.left[:offset] + x.right[: length - offset]
            other = seen.setdefault(window, i)
            if other != i:
                marks.setdefault(i, set()).add(offset)
                marks.setdefault(other, set()).add(offset)
    out = []
    for i, offsets in marks.items():
        x = group[i][1]
        if not x.known:
            for low, high in spans(sorted(offsets)):
                out.append(window_range(x, low, high))
    return out


def spans(numbers: list[int]) -> Iterator[tuple[int, int]]:
    first = last = numbers[0]
    for x in numbers[1:]:
        if x != last + 1:
            yield first, last
            first = x
        last = x
    yield first, last


def merged(sent: DataFrame, length: int, gram: int, targets: int) -> DataFrame:
    """Repeated windows as doc_id, text_hash, low, high."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, pieces = None, []

        def found() -> Iterator[pa.RecordBatch]:
            group, rows = [], []
            for shares, x in merge([unpack_run(p) for p in pieces]):
                if shares < gram and group:
                    rows += matches(group, length)
                    group = []
                group.append((shares, x))
            if group:
                rows += matches(group, length)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "text_hash", "low", "high"])

        for batch in batches:
            for own, piece in zip(batch["target"].to_pylist(), batch["run"].to_pylist(), strict=True):
                if own != target:
                    yield from found()
                    target, pieces = own, []
                pieces.append(piece)
        yield from found()

    dealt = sent.filter("target >= 0").select("target", "run").repartition(targets, "target").sortWithinPartitions("target")
    return dealt.mapInArrow(run, RANGE)


def repeated_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id (the smallest long where null), text_hash and ranges of window starts that occur elsewhere too."""
    found = written(all_anchors(docs, length, gram), "suffix-anchors")
    numbers, total = open_anchors(found, heavy)
    targets = max(-(-total // TARGET_GRAMS), docs.sparkSession.sparkContext.defaultParallelism)
    cuts = [x / targets for x in range(1, targets)]
    splitters = found.agg(F.percentile_approx("probe", F.array(*map(F.lit, cuts)), F.lit(10 * targets))).first()[0] if cuts else None
    near = _doc_keys(docs.filter(F.octet_length("text") >= length))
    texts = join_texts(near, numbers)
    sent = written(sent_runs(texts, sorted(set(splitters or [])), length, gram), "suffix-runs")
    settled = sent.filter("target < 0").select("doc_id", "text_hash", "low", "high")
    return settled.unionByName(merged(sent, length, gram, targets))


def join_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts with the columns of ``wanted``; a bit set keeps most others out of the shuffle."""
    words = written(bit_set(wanted, F.col("text_hash")), "suffix-bits")
    return texts.filter(in_bit_set(words.scalar(), F.col("text_hash"))).join(wanted, ["doc_id", "text_hash"])


def kept_text(text: bytes, ranges: list[dict], length: int) -> tuple[bytes, int, int]:
    """What is left, how many bytes went, and in how many runs."""
    out, done, gone, runs = [], 0, 0, 0
    start = end = None
    for x in sorted((x["low"], x["high"] + length) for x in ranges):
        if end is None or x[0] > end:
            if end is not None:
                out.append(text[done:start])
                done, gone, runs = end, gone + end - start, runs + 1
            start, end = x
        else:
            end = max(end, x[1])
    if end is not None:
        out.append(text[done:start])
        done, gone, runs = end, gone + end - start, runs + 1
    return b"".join(out) + text[done:], gone, runs


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """doc_id, kept (the bytes that stay), n_bytes, n_removed, n_spans."""
    windows = repeated_windows(docs, length, gram, heavy)
    ranges = written(windows.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("low", "high")).alias("ranges")), "suffix-ranges")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_text(t, r or [], length) for t, r in zip(batch["text"].to_pylist(), batch["ranges"].to_pylist(), strict=True)]
            kept, gone, runs = list(zip(*rows, strict=True)) or ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(kept, pa.binary()), pa.array([len(x) for x in batch["text"].to_pylist()], pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(runs, pa.int64())], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])

    texts = _doc_keys(docs)
    words = written(bit_set(ranges, F.col("text_hash")), "suffix-bits")
    marked = texts.withColumn("near", in_bit_set(words.scalar(), F.col("text_hash")))
    whole = marked.filter(~F.col("near")).select(
        "doc_id", F.col("text").alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"))
    near = marked.filter("near").join(ranges, ["doc_id", "text_hash"], "left").select("doc_id", "text", "ranges")
    parts = near.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
    return whole.unionByName(parts).withColumn("doc_id", F.when(F.col("doc_id") > NO_ID, F.col("doc_id")))
