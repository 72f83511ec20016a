"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

A text's set holds its distinct shingles of ``size`` words, as 64-bit hashes.  The first permutation places
each shingle in a circle of ``CIRCLE`` seats; coordinate k of a signature is the least value, over the
shingles' seats, of the second permutation shifted by k, so two permutations give all coordinates.

Texts with equal sets are one class.  Classes that share a band of the signature are candidates, and the
smallest class of a bucket is its center.  First every class is compared with its centers on full sets.  Where
the classes around a center then still lie in several components, those outside its largest are
compared with all around it.  Links inside a component change nothing, so no link that a bucket offers is lost,
and no bucket is ever expanded into its pairs.  Blocks of bounded size spread a large group over tasks.

With 52 bands of 7 rows, two texts at a similarity of 0.8 share no band once in 200 000 times; nearer ones
practically never.  Null and empty texts have empty sets and no links.  A text of fewer words than a shingle
is one shingle.  A null ``doc_id`` is never the smallest of others.  An empty table gives no rows.  Texts are read
whole: sets far larger than the circle fill all its seats and so are candidates of each other, which costs
comparisons and changes no link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import bit_set, frugal, in_bit_set, join_groups, text_of
from lonja.llm.components import components
from lonja.session import written

BANDS, ROWS = 52, 7
CIRCLE = 1 << 20
SEED = 20240607
BLOCK_SHINGLES = 1 << 20  # of each side of a block
LAST = (1 << 63) - 1


@lru_cache(maxsize=1)
def _circle(coordinates: int) -> np.ndarray:
    """All shifts of the second permutation: row i holds the values that seat i gives to the coordinates."""
    order = np.random.default_rng(SEED).permutation(CIRCLE).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[:coordinates]]), coordinates)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of word shingles; hashes of words are remembered within bounds."""

    def __init__(self, size: int):
        self.size = size
        self.words: dict[bytes, int] = {}

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes of the text's shingles; A-Z in lower case, words between ``[\\x20\\x09-\\x0D]``."""
        import xxhash

        words, known = text.lower().split(), self.words
        if not words:
            return np.zeros(0, np.uint64)
        if len(known) > 150_000:
            known.clear()
        for new in set(words).difference(known):
            known[new] = xxhash.xxh64_intdigest(new)
        row = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(row))
        out = np.full(len(row) - size + 1, size, np.uint64)
        for i in range(size):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + row[i : len(row) - size + 1 + i])
        return np.unique(out)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    seats = (mix(shingles + np.uint64(SEED)) >> np.uint64(7)) & np.uint64(CIRCLE - 1)
    circle, least = _circle(coordinates), np.full(coordinates, CIRCLE, np.uint32)
    for i in range(0, len(seats), 2048):
        np.minimum(least, circle[seats[i : i + 2048].astype(np.int64)].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature; equal keys mean equal bands at the same place."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2])
    for i in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys.view(np.int64)


def prints(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, print (128 bits of the set) and the band keys of each document."""
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, list_type = Shingler(size), pa.list_(pa.int64())
        for batch in batches:
            sets = [shingler.shingles(x) for x in batch["text"].to_pylist()]
            keys = band_keys(np.array([signature(x, bands * rows) for x in sets], np.uint32).reshape(-1, bands * rows), bands, rows)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                 pa.array([list(x) if len(s) else [] for x, s in zip(keys, sets, strict=True)], list_type)],
                ["doc_id", "n_shingles", "print", "bands"])

    rows_in = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text"))
    return rows_in.mapInArrow(frugal(look), "doc_id long, n_shingles long, print binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """class and its set, from one document of each wanted class (class, print, doc_id)."""
    words = written(bit_set(wanted, F.xxhash64("doc_id")), "near-bits")
    near = docs.select(F.col("doc_id").cast("long"), text_of().cast("binary").alias("text")).filter(
        in_bit_set(words.scalar(), F.xxhash64("doc_id")))
    texts = near.join(wanted, near["doc_id"].eqNullSafe(wanted["doc_id"])).select("class", "print", "text")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            sets = [shingler.shingles(x).tobytes() for x in batch["text"].to_pylist()]
            same = [hashlib.blake2b(x, digest_size=16).digest() == y for x, y in zip(sets, batch["print"].to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch["class"], pa.array(sets, pa.binary())], ["class", "shingles"])
            yield out.filter(pa.array(same, pa.bool_()))

    # an id with several texts may bring one of them twice
    return texts.mapInArrow(frugal(look), "class long, shingles binary").groupBy("class").agg(F.any_value("shingles").alias("shingles"))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, a row for each left set."""
    offsets = np.cumsum([0, *map(len, right)])[:-1]
    joined = np.concatenate(right)
    if len(left) <= 4:
        found = []
        for x in left:
            at = np.minimum(np.searchsorted(x, joined), len(x) - 1)
            found.append(np.add.reduceat((x[at] == joined).astype(np.int64), offsets))
        return np.array(found)
    universe, number = np.unique(joined, return_inverse=True)
    found = np.zeros((len(left), len(right)), np.int64)
    for i, x in enumerate(left):
        at = np.minimum(np.searchsorted(universe, x), len(universe) - 1)
        mark = np.zeros(len(universe), np.uint8)
        mark[at[universe[at] == x]] = 1
        found[i] = np.add.reduceat(mark[number], offsets, dtype=np.int64)
    return found


def compare(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the left and the right sets of each block whose components differ.

    ``blocks``: block (a struct), side (0 left, 1 right), class, component, shingles.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, left, right, size = None, [], [], 0

        def links() -> list[tuple[int, int]]:
            if not left or not right:
                return []
            common = overlaps([x[2] for x in left], [x[2] for x in right])
            total = np.array([len(x[2]) for x in left])[:, None] + np.array([len(x[2]) for x in right])
            apart = np.array([x[1] for x in left])[:, None] != np.array([x[1] for x in right])
            return [(left[i][0], right[j][0]) for i, j in zip(*np.nonzero(apart & (100 * common >= percent * (total - common))), strict=True)]

        def batch_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
            a, b = list(zip(*found, strict=True)) or ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            found = []
            rows = zip(*(batch[x].to_pylist() for x in ("c", "i", "j", "side", "class", "component", "shingles")), strict=True)
            for c, i, j, side, number, component, shingles in rows:
                if (c, i, j) != block or size > 4 * BLOCK_SHINGLES:
                    found += links()
                    right, size = [], 0
                    if (c, i, j) != block:
                        block, left = (c, i, j), []
                (right if side else left).append((number, component, np.frombuffer(shingles, np.uint64)))
                size += len(shingles) // 8 if side else 0
            yield batch_of(found)
        yield batch_of(links())

    dealt = blocks.repartition("c", "i", "j").sortWithinPartitions("c", "i", "j", "side", "class")
    return dealt.select("c", "i", "j", "side", "class", "component", "shingles").mapInArrow(frugal(run), "a long, b long")


def blocks(left: DataFrame, right: DataFrame, sets: DataFrame) -> DataFrame:
    """Deal the left and the right classes around each center ``c`` to blocks of about ``BLOCK_SHINGLES`` a side."""
    def parts(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("c").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias(name))

    def deal(side: DataFrame, own: str, other: str, number: int) -> DataFrame:
        place = F.pmod(F.xxhash64("class"), F.col(f"n{own}")).cast("int").alias(own)
        every = F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1)).alias(other)
        # the two sides of a block are joined with their sets before they are copied to other blocks
        return side.join(counts, "c").join(sets, "class").select(
            "c", "class", "component", "shingles", place, f"n{other}").select(
            "c", "class", "component", "shingles", own, every).withColumn("side", F.lit(number))

    counts = parts(left, "ni").join(parts(right, "nj"), "c")
    return deal(left, "i", "j", 0).unionByName(deal(right, "j", "i", 1))


def alike(n: str, m: str, percent: int) -> Column:
    """Whether sets of these sizes can reach the similarity."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    printed = written(prints(docs, size, bands, rows), "near-prints")
    classes = printed.filter("n_shingles > 0").groupBy("print").agg(
        F.min(F.coalesce("doc_id", F.lit(LAST))).alias("first_id"), F.count(F.lit(1)).alias("size"),
        F.max("n_shingles").cast("int").alias("n"), F.any_value("bands").alias("bands"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "near-classes")

    keys = classes.select("class", "n", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("class", "n")).alias("center"), F.count(F.lit(1)).alias("members"))
    buckets = written(buckets.filter("members > 1"), "near-buckets")
    stars = join_groups(keys, buckets, ["key"], "members").filter("class <> center.class").select(
        F.col("center.class").alias("c"), F.col("center.n").alias("cn"), "class", "n").distinct()
    stars = written(stars, "near-stars")
    centers = stars.select("c", F.col("c").alias("class"), F.col("cn").alias("n")).distinct()

    wanted = stars.select("class").unionByName(stars.select(F.col("c").alias("class"))).distinct()
    wanted = wanted.join(classes.select("class", "print", F.when(F.col("first_id") < LAST, F.col("first_id")).alias("doc_id")), "class")
    wanted = written(wanted, "near-wanted")
    sets = written(shingle_sets(docs, wanted, size), "near-sets")

    def alone(side: DataFrame) -> DataFrame:
        return side.withColumn("component", F.col("class"))

    likely = stars.filter(alike("n", "cn", percent))
    first = centers.join(likely.select("c").distinct(), "c", "left_semi")
    links = written(compare(blocks(alone(first), alone(likely.drop("cn")), sets), percent), "near-links")
    labels = components(links)

    # around a center: those outside its largest component against all; two members have met already
    around = stars.drop("cn").unionByName(centers).join(labels, F.col("class") == F.col("node"), "left").select(
        "c", "class", "n", F.coalesce("label", "class").alias("component"))
    around = written(around, "near-around")
    largest = around.groupBy("c", "component").agg(F.count(F.lit(1)).alias("members")).groupBy("c").agg(
        F.max_by("component", F.struct("members", "component")).alias("main"), F.sum("members").alias("members"), F.count(F.lit(1)).alias("parts"))
    open_centers = written(largest.filter("parts > 1 and members > 2").select("c", "main"), "near-open")
    strays = around.join(open_centers, "c").filter("component <> main").drop("main")
    rest = around.join(open_centers.select("c"), "c", "left_semi")
    more = written(compare(blocks(strays, rest, sets), percent), "near-links")
    labels = components(links.unionByName(more))

    labelled = classes.join(labels, classes["class"] == labels["node"], "left").select(
        "print", "size", "first_id", F.coalesce("label", "class").alias("label"), F.col("label").isNotNull().alias("linked"))
    least = labelled.filter("linked").groupBy("label").agg(F.min("first_id").alias("least_id"))
    groups = labelled.join(least, "label", "left").filter("linked or size > 1").select(
        "print", "size", F.coalesce("least_id", "first_id").alias("least_id"))
    groups = written(groups, "near-groups")
    own = join_groups(printed.select("doc_id", "n_shingles", "print"), groups, ["print"], "size")
    component = F.when(F.col("least_id").isNull(), F.col("doc_id")).when(F.col("least_id") < LAST, F.col("least_id"))
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "print")


def drop_near(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays, with all its columns.

    Rows with one ``doc_id`` share its fate: it goes when none of them is to stay.
    """
    gone = near_groups(docs, size, percent).groupBy(F.col("doc_id").alias("id")).agg(F.bool_or("kept").alias("stays"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.join(gone.filter("not stays"), F.col("doc_id").eqNullSafe(F.col("id")), "left_anti").select("doc.*")
