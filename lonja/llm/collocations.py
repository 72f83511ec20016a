"""Phrases of two to five words that stand together more often than their parts would by chance.

A level at a time: the frequent words get numbers by frequency, then the pairs of frequent neighbours are counted,
the frequent pairs get numbers by frequency, pairs of such a pair and the next word are counted, and so on.  Numbers
address the cells of square tiles directly: pairs whose tile is well filled are counted with a dense ``bincount``, the
others as sorted coordinates with run lengths.  Tasks count what they hold and send one row for each tile; the rows
of a tile are added up in the same two ways.

Ranks go to the ``RANKS`` most frequent words or phrases of a level at most, which bounds what is sent to the tasks.
Those beyond count all the same: words by a 62-bit code that is checked to be theirs alone, phrases by the codes of
their words; a bit filter of at most 2^27 bits keeps out most of what is rare, and where it lets too much pass, more
rows are shuffled, at most one for each place in the text, with equal results.

Everything is per ``lang`` (null: ``und``), whose words have numbers of their own.  Null and empty texts hold no
phrase; an empty table gives no rows; rows that repeat count each time; long texts are read in parts and their
numbers in overlapping slices, so that no phrase is cut.  Ties of the score go by count, then by the phrase's bytes.
"""

from __future__ import annotations

import itertools
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common import frugal, text_of
from lonja.session import written

LEAST, LONGEST, SHOWN = 100, 5, 2000
#: Numbers of a level, the side of a tile, and the pairs that make a tile worth a dense count.
RANKS, TILE, DENSE = 1 << 18, 1 << 10, 1 << 14
#: Partial counts of so many tasks are summed together.
FAN_IN = 64
#: Words of a slice, places that a task counts at once, distinct words that it holds, bytes that it splits at once.
SLICE, FLUSH, HELD, PART = 1 << 20, 1 << 21, 1 << 18, 2 << 20
FILTER_BITS = 1 << 27
#: Codes of words without a rank start here.
CODES = 1 << 62
#: The end of a piece: a byte that no UTF-8 text holds.
MARK = b"\xff"
BYTES = bytes(ord(MARK) if chr(x) in ".,;:!?\n\v\f\r" else 32 if x == 9 else x + 32 if 65 <= x <= 90 else x for x in range(256))
SALTS = 32


def streams(batch: pa.RecordBatch) -> Iterator[tuple[str, Iterator[list[bytes]]]]:
    """For each language of a batch its words, part by part, with a mark after each piece."""
    by_lang = defaultdict(list)
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
        by_lang[lang].append(text)

    def parts(texts: list[bytes]) -> Iterator[list[bytes]]:
        whole = MARK.join(texts).translate(BYTES).replace(MARK, b" " + MARK + b" ")
        at = 0
        while at < len(whole):
            end = whole.find(b" ", at + PART)
            end = len(whole) if end < 0 else end
            yield whole[at:end].split()
            at = end

    for lang, texts in by_lang.items():
        yield lang, parts(texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over the whole table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(MARK, None)
                columns = [pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(list(words.values()), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lang, parts in streams(batch):
                for words in parts:
                    held[lang].update(words)
            if sum(map(len, held.values())) > HELD:
                yield from out()
        yield from out()

    counted = docs.mapInArrow(frugal(run), "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def mix(code: np.ndarray, word: np.ndarray, seed: int) -> np.ndarray:
    """64 bits from the code of a phrase and the word after it."""
    x = code.astype(np.uint64) ^ (word.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def phrase_codes(keys: np.ndarray, seed: int) -> np.ndarray:
    """Codes of phrases, a row of word numbers each."""
    code = keys[:, 0].astype(np.uint64)
    for i in range(1, keys.shape[1]):
        code = mix(code, keys[:, i], seed)
    return code


@dataclass
class Level:
    """What tasks must know of the frequent phrases of one length."""

    keys: np.ndarray  # word numbers of the phrases with a rank, by rank
    bits: np.ndarray | None  # filter of the codes of the others; None where there are none
    seed: int

    def __post_init__(self) -> None:
        codes = phrase_codes(self.keys, self.seed)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]

    def may_hold(self, codes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.zeros(len(codes), bool)
        slot = codes & np.uint64(64 * len(self.bits) - 1)
        return (self.bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)

    def ranks(self, codes: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the phrase at each place; -2 where it may be frequent without a rank, -1 where it is not frequent."""
        out = np.where(self.may_hold(codes), -2, -1)
        if len(self.codes):
            found = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            hit = np.flatnonzero(self.codes[found] == codes)
            rank = self.order[found[hit]]
            same = np.ones(len(hit), bool)
            for i in range(self.keys.shape[1]):
                same &= self.keys[rank, i] == words[at[hit] + i]
            out[hit[same]] = rank[same]
        return out


def tiled(first: np.ndarray, second: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Pairs of numbers of ``bits`` bits as tile and cell in one number, and the bits of a cell."""
    side = min(bits, TILE.bit_length() - 1)
    mask = (1 << side) - 1
    tile = first >> side << (bits - side) | second >> side
    return tile << 2 * side | (first & mask) << side | second & mask, 2 * side


def tally(codes: np.ndarray, cell_bits: int, dense: int = DENSE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each tile with its filled cells in order and how often each occurs."""
    if not len(codes):
        return
    tile = codes >> cell_bits
    order = np.argsort(tile.astype(np.uint16) if codes.max() >> cell_bits < 1 << 16 else tile, kind="stable")
    codes, tile = codes[order], tile[order]
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]]))
    for t, low, high in zip(tile[starts].tolist(), starts.tolist(), np.append(starts[1:], len(tile)).tolist(), strict=True):
        cells = codes[low:high] & (1 << cell_bits) - 1
        if high - low >= dense:
            counts = np.bincount(cells, minlength=1 << cell_bits)
            there = np.flatnonzero(counts)
            yield t, there, counts[there]
        else:
            cells.sort()
            first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            yield t, cells[first], np.diff(np.append(first, len(cells)))


def narrow(values: np.ndarray) -> np.ndarray:
    most = int(values.max(initial=0))
    return values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if most <= np.iinfo(t).max))


def packed(cells: np.ndarray, counts: np.ndarray) -> bytes:
    """Cells in order as gaps, then counts, each in as many bytes as the largest needs."""
    gaps, counts = narrow(np.diff(cells, prepend=0)), narrow(counts)
    return bytes([gaps.itemsize, counts.itemsize]) + gaps.tobytes() + counts.tobytes()


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    sizes = data[0], data[1]
    n = (len(data) - 2) // sum(sizes)
    gaps = np.frombuffer(data, f"u{sizes[0]}", n, 2)
    return np.cumsum(gaps, dtype=np.int64), np.frombuffer(data, f"u{sizes[1]}", n, 2 + n * sizes[0]).astype(np.int64)


class TileSum:
    """The sum of partial counts of one tile, dense once many cells have come."""

    def __init__(self, cell_bits: int, dense: int = DENSE):
        self.cell_bits, self.limit = cell_bits, dense
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.cells = 0, None

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((cells, counts))
        self.held += len(cells)
        if self.held >= self.limit:
            if self.cells is None:
                self.cells = np.zeros(1 << self.cell_bits, np.int64)
            for cells, counts in self.parts:
                self.cells[cells] += counts
            self.parts, self.held = [], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.cells is not None:
            for cells, counts in self.parts:
                self.cells[cells] += counts
            self.parts = []
            there = np.flatnonzero(self.cells)
            return there, self.cells[there]
        cells, counts = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        return cells[first], np.add.reduceat(counts, first)


def row_tally(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and how often each occurs."""
    rows = rows[np.lexsort(rows.T[::-1])]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[starts], np.diff(np.append(starts, len(rows)))


def extended(words: np.ndarray, levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Places where the last level's phrase and the one a word later are frequent, and the ranks of the first (-2: none)."""
    rank = np.where(words >= CODES, -2, words)
    code = words.astype(np.uint64)
    for length, level in enumerate(levels, 2):
        at = np.flatnonzero((rank[:-1] != -1) & (rank[1:] != -1))
        codes = mix(code[at], words[at + length - 1], level.seed)
        new = np.full(len(rank) - 1, -1, np.int64)
        new[at] = level.ranks(codes, words, at)
        code = np.zeros(len(new), np.uint64)
        code[at] = codes
        rank = new
    at = np.flatnonzero((rank[:-1] != -1) & (rank[1:] != -1))
    return at, rank[at]


def places(batches: Iterator[pa.RecordBatch], levels: list[Level]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each slice its words, the places where a phrase to be counted starts, the rank of its first words and its last word."""
    for batch in batches:
        for own, ranked, coded in zip(*(batch[x].to_pylist() for x in ("own", "ranked", "coded")), strict=True):
            words = np.frombuffer(ranked, np.int32).astype(np.int64)
            words[words == -2] = np.frombuffer(coded, np.int64)
            at, rank = extended(words, levels)
            rank, at = rank[at < own], at[at < own]
            yield words, at, rank, words[at + len(levels) + 1]


def tile_sums(parts: DataFrame, cell_bits: int, schema: str, make) -> DataFrame:
    """Rows of ``group, tile, data`` summed by group and tile; ``make(group, tile, cells, counts)`` gives a record batch of ``schema``.

    Rows arrive in order, so that a task holds the counts of one tile at a time, however many rows it has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for batch in batches:
            for group, tile, data in zip(*(batch[x].to_pylist() for x in ("group", "tile", "data")), strict=True):
                if key != (group, tile):
                    if key:
                        yield make(*key, *held.total())
                    key, held = (group, tile), TileSum(cell_bits)
                held.add(*unpacked(data))
        if key:
            yield make(*key, *held.total())

    return parts.repartition("group", "tile").sortWithinPartitions("group", "tile").mapInArrow(frugal(run), schema)


def tile_rows(group: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([group] * len(rows), pa.int64()), pa.array([x for x, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())],
                                      ["group", "tile", "data"])


def ranked_counts(numbered: DataFrame, shared, ranks: int, least: int, names: list[str]) -> DataFrame:
    """Counts of phrases whose first words and last word have ranks, summed by tile.

    A task sends a row for each tile, with all its cells; the rows of some ``FAN_IN`` tasks are summed first, then those of as many
    sums, until one is left.
    """
    bits = (ranks - 1).bit_length()
    cell_bits = 2 * min(bits, TILE.bit_length() - 1)
    schema = "group long, tile long, data binary"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = TaskContext.get().partitionId() // FAN_IN
        pairs, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            rows, size = [], 0
            for tile, cells, counts in tally(np.concatenate(pairs), cell_bits):
                rows.append((tile, packed(cells, counts)))
                size += len(rows[-1][1])
                if size > PART or len(rows) == 4096:
                    yield tile_rows(group, rows)
                    rows, size = [], 0
            yield tile_rows(group, rows)

        for _, _, rank, after in places(batches, shared.value):
            some = (rank >= 0) & (after < CODES)
            pairs.append(tiled(rank[some], after[some], bits)[0])
            held += len(pairs[-1])
            if held > FLUSH:
                yield from out()
                pairs, held = [], 0
        if pairs:
            yield from out()

    def frequent(group: int, tile: int, cells: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        enough = counts >= least
        cells, counts = cells[enough], counts[enough]
        side = cell_bits // 2
        first = (tile >> (bits - side) << side) + (cells >> side)
        second = ((tile & (1 << (bits - side)) - 1) << side) + (cells & (1 << side) - 1)
        levels = shared.value
        rows = np.column_stack([levels[-1].keys[first] if levels else first[:, None], second])
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x)) for x in rows.T), pa.array(counts)], [*names, "a"])

    parts, groups = numbered.mapInArrow(frugal(count), schema), -(-numbered.rdd.getNumPartitions() // FAN_IN)
    while groups > 1:
        parts = tile_sums(parts, cell_bits, schema, lambda group, tile, cells, counts: tile_rows(group // FAN_IN, [(tile, packed(cells, counts))]))
        groups = -(-groups // FAN_IN)
    return tile_sums(parts, cell_bits, ", ".join(f"{x} long" for x in [*names, "a"]), frequent)


def coded_counts(numbered: DataFrame, shared, least: int, names: list[str]) -> DataFrame:
    """Counts of phrases with a part without rank, as sorted rows of word numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            found, n = row_tally(np.concatenate(rows))
            for i in range(0, len(n), 1 << 16):
                columns = [pa.array(np.ascontiguousarray(x)) for x in found[i : i + (1 << 16)].T]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n[i : i + (1 << 16)])], [*names, "n"])

        for words, at, rank, after in places(batches, shared.value):
            some = at[(rank < 0) | (after >= CODES)]
            rows.append(np.column_stack([words[some + i] for i in range(len(names))]))
            held += len(some)
            if held > FLUSH:
                yield from out()
                rows, held = [], 0
        if rows:
            yield from out()

    counted = numbered.mapInArrow(frugal(count), ", ".join(f"{x} long" for x in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)


def phrase_counts(numbered: DataFrame, levels: list[Level], ranks: int, least: int, all_ranked: bool) -> DataFrame:
    """w1 .. wm and a of the frequent phrases one word longer than the last level's; ``all_ranked``: no word is without a rank."""
    names = [f"w{i + 1}" for i in range(len(levels) + 2)]
    shared = numbered.sparkSession.sparkContext.broadcast(levels)
    out = ranked_counts(numbered, shared, ranks, least, names)
    if all_ranked and all(x.bits is None for x in levels):
        return out
    return out.unionByName(coded_counts(numbered, shared, least, names))


def by_frequency(table: DataFrame, count: str, most: int) -> tuple[DataFrame, DataFrame, int]:
    """The most frequent rows, at most ``most``, all others, and how many others there are; equal counts stay together."""
    step = F.floor(16 * F.log2(count)).cast("int")
    steps = sorted(((r["step"], r["count"]) for r in table.groupBy(step.alias("step")).count().collect()), reverse=True)
    taken, cut = 0, None
    for value, n in steps:
        if taken + n > most:
            break
        taken, cut = taken + n, value
    if cut is None:
        return table.limit(0), table, sum(n for _, n in steps)
    return table.filter(step >= cut), table.filter(step < cut), sum(n for _, n in steps) - taken


def filter_of(codes: DataFrame, n: int) -> np.ndarray | None:
    """A bit filter of the column ``code``: 16 bits a row, 2^27 at most."""
    if not n:
        return None
    size = min(FILTER_BITS, 1 << max(16, (16 * n - 1).bit_length()))
    slot = F.col("code").bitwiseAND(F.lit(size - 1))
    words = codes.select(F.shiftright(slot, 6).alias("at"), slot.bitwiseAND(F.lit(63)).cast("int").alias("bit")).groupBy("at").agg(
        F.expr("bit_or(shiftleft(1L, bit))").alias("value")).toArrow()
    out = np.zeros(size // 64, np.uint64)
    out[words["at"].to_numpy()] = words["value"].to_numpy().view(np.uint64)
    return out


def level_of(phrases: DataFrame, length: int, ranks: int) -> Level:
    names = [f"w{i + 1}" for i in range(length)]
    top, others, n_others = by_frequency(phrases, "a", ranks)
    known = top.select("a", *names).toArrow()
    keys = np.column_stack([known[x].to_numpy() for x in names]).astype(np.int64).reshape(-1, length)
    keys = keys[np.lexsort((*keys.T[::-1], -known["a"].to_numpy()))]
    seed = next(s for s in itertools.count(1) if len(np.unique(phrase_codes(keys, s))) == len(keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.column_stack([batch[x].to_numpy() for x in names])
            yield pa.RecordBatch.from_arrays([pa.array(phrase_codes(rows, seed).view(np.int64))], ["code"])

    return Level(keys, filter_of(others.select(*names).mapInArrow(frugal(run), "code long"), n_others), seed)


def word_code(lang, word, salt: int):
    """The code of a word without a rank, as a column."""
    return F.xxhash64(F.concat(lang, F.lit("\0"), word, F.lit(f"\0{salt}"))).bitwiseAND(F.lit(CODES - 1)).bitwiseOR(F.lit(CODES))


def number_words(counts: DataFrame, least: int, ranks: int):
    """Frequent words with their numbers (w1, lang, text, a), and what tasks need: ranks by language and word, filter, salt."""
    frequent = counts.filter(F.col("n") >= least)
    top, others, n_others = by_frequency(frequent, "n", ranks)
    rows = sorted(top.collect(), key=lambda r: (-r.n, r.lang, r.word))
    table: dict[str, dict[bytes, int]] = defaultdict(dict)
    for i, r in enumerate(rows):
        table[r.lang][r.word.encode()] = i
    spark = counts.sparkSession
    schema = "w1 long, lang string, text string, a long"
    numbered = spark.createDataFrame([(i, r.lang, r.word, r.n) for i, r in enumerate(rows)], schema)
    if not n_others:
        return numbered, (dict(table), None, 0)
    for salt in itertools.count():  # until no frequent word shares its code with any other word
        code = word_code(F.col("lang"), F.col("word"), salt).alias("code")
        shared = counts.groupBy(code).agg(F.count("*").alias("n"), F.max("n").alias("most")).filter((F.col("n") > 1) & (F.col("most") >= least))
        if shared.isEmpty():
            break
    coded = others.select(code, "lang", F.col("word").alias("text"), F.col("n").alias("a"))
    return numbered.unionByName(coded.withColumnRenamed("code", "w1")), (dict(table), filter_of(coded, n_others), salt)


def numbered_texts(docs: DataFrame, known) -> DataFrame:
    """Slices of the texts as word numbers: ``ranked`` 32-bit ranks (-1: rare word or end of a piece, -2: next of the 64-bit ``coded``).

    A slice holds its own places and the words that a phrase starting there can reach.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def numbers(words: list[bytes], lang: str) -> np.ndarray:
        from xxhash import xxh64_intdigest

        table, bits, salt = shared.value
        ranks = table.get(lang, {})
        out = np.fromiter(map(ranks.get, words, itertools.repeat(-1)), np.int64, len(words))
        if bits is not None:
            codes = {}
            for word in set(words).difference(ranks, [MARK]):
                code = xxh64_intdigest(lang.encode() + b"\0" + word + b"\0%d" % salt, 42) & CODES - 1 | CODES
                if int(bits[(code & 64 * len(bits) - 1) >> 6]) >> (code & 63) & 1:
                    codes[word] = code
            rare = np.flatnonzero(out == -1)
            out[rare] = [codes.get(words[i], -1) for i in rare.tolist()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [x for lang, words in streams(batch) for x in [*(numbers(w, lang) for w in words), np.array([-1])]]
            whole = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            gap = whole == -1
            whole = whole[~gap | ~np.concatenate([[True], gap[:-1]])]  # one end is as good as many
            rows = []
            for i in range(0, len(whole), SLICE):
                some = whole[i : i + SLICE + LONGEST - 1]
                coded = some >= CODES
                rows.append((min(SLICE, len(whole) - i), np.where(coded, -2, some).astype(np.int32).tobytes(), some[coded].tobytes()))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(x, pa.binary()) for x in columns[1:])], ["own", "ranked", "coded"])

    return docs.mapInArrow(frugal(run), "own long, ranked binary, coded binary")


def longer(counts: DataFrame, shorter: DataFrame, length: int) -> DataFrame:
    """Frequent phrases with text and counts of their first and last words: ``heads`` and ``tails``, by number of words."""
    names = [f"w{i + 1}" for i in range(length)]
    left = shorter.select(*names[:-1], "lang", F.col("text").alias("head"), F.concat("heads", F.array("a")).alias("heads"))
    right = shorter.select(*(F.col(f"w{i}").alias(f"w{i + 1}") for i in range(1, length)), "last", F.concat("tails", F.array("a")).alias("tails"))
    return (counts.join(left, names[:-1]).join(right, names[1:])
            .select(*names, "lang", F.concat_ws(" ", "head", "last").alias("text"), "last", "a", "heads", "tails"))


def collocations(docs: DataFrame, least: int = LEAST, shown: int = SHOWN, ranks: int = RANKS) -> DataFrame:
    """The first ``shown`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), text_of().alias("text"))
    counts = written(word_counts(docs), "phrase-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    words, known = number_words(counts, least, ranks)
    none = F.array().cast("array<long>")
    tables = [written(words.select("w1", "lang", "text", F.col("text").alias("last"), "a", none.alias("heads"), none.alias("tails")), "phrase-level-1")]
    numbered = written(numbered_texts(docs, known), "phrase-numbers")
    levels: list[Level] = []
    for length in range(2, LONGEST + 1):
        tables.append(written(longer(phrase_counts(numbered, levels, ranks, least, known[1] is None), tables[-1], length), f"phrase-level-{length}"))
        if length < LONGEST:
            levels.append(level_of(tables[-1], length, ranks))
    found = []
    for length in range(2, LONGEST + 1):
        names = [f"w{i + 1}" for i in range(length)]
        table = tables[length - 1]
        if length < LONGEST:
            above = tables[length]
            gone = above.filter(F.col("a") >= F.element_at("heads", -1)).select(*names).unionByName(
                above.filter(F.col("a") >= F.element_at("tails", -1)).select(*(F.col(f"w{i + 2}").alias(f"w{i + 1}") for i in range(length))))
            table = table.join(gone, names, "left_anti")
        whole = "cast(1000 as decimal(38, 0)) * cast(a as decimal(19, 0)) * cast(n as decimal(19, 0))"
        cuts = [F.expr(f"struct(({whole}) div (cast(heads[{k - 1}] as decimal(19, 0)) * cast(tails[{length - k - 1}] as decimal(19, 0))) as score, "
                       f"{k} as k, heads[{k - 1}] as l, tails[{length - k - 1}] as r)") for k in range(1, length)]
        best = F.array_min(F.array(*cuts)).alias("best")
        found.append(table.join(totals, "lang").select("lang", F.col("text").alias("phrase"), "a", "n", best).select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score"))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    # the first of each salt, then the first of those
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(SALTS))).orderBy(*order)
    few = every.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= shown).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= shown).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
