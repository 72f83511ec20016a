"""Periodic runs of words: stretches that repeat with a fixed distance at least four times.

Blocks of ``2^k`` words, for every ``k``, are compared with the two blocks after them.  A convolution gives the sum
of squared differences of a block and every window that starts ``2^k`` to ``2^(k+1) - 1`` words later; it is taken as
a number-theoretic transform, so the sums are whole numbers modulo a prime and a window without any mismatch
always shows as zero.  Each zero is a distance whose agreement is then extended word by word to both sides, which also
confirms it.  A run of period ``q`` in that range and of four periods or more holds a whole block and its copy, so
none is missed.  A block holding a word that does not come again within two blocks has no copy there and is not
transformed.

Words are numbered anew in every document, so nothing agrees across documents, and many documents share one
transform.  A document is worked through in one task; memory is some hundred bytes for each of its words,
transforms take slices of bounded size.  Null and empty texts have no words and no runs; an empty table gives no
rows; rows that repeat are treated one by one; a null ``doc_id`` stays null.  Texts of up to 2^28 words are
covered by the size of the transform; a Spark string cannot hold more than that in words of seven bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import text_of

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: A prime of 31 bits with transforms of up to 2^27 values, and a generator of its residues.
PRIME, GENERATOR = 2013265921, 31
#: So many values are transformed at once.
SLICE = 1 << 20
WORD = re.compile(r"[^\x20\x09-\x0D]+")
RUN = "array<struct<start: long, length: long, period: long>>"


@lru_cache(maxsize=64)
def roots(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size/2 - 1 of a root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(max(size // 2, 1), np.int64)
    have = 1
    while have < size // 2:  # doubling: the next powers are those so far times root^have
        out[have : 2 * have] = out[:have] * pow(root, have, PRIME) % PRIME
        have *= 2
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Transform of each row; the results stand in bit-reversed order."""
    count, size = rows.shape
    step = size
    while step > 1:
        view = rows.reshape(count, size // step, 2, step // 2)
        low, high = view[:, :, 0], view[:, :, 1]
        total = low + high
        view[:, :, 1] = (low - high) % PRIME * roots(step, False) % PRIME
        view[:, :, 0] = total % PRIME
        step //= 2
    return rows


def back(rows: np.ndarray) -> np.ndarray:
    """The rows whose transforms, in bit-reversed order, are given."""
    count, size = rows.shape
    step = 2
    while step <= size:
        view = rows.reshape(count, size // step, 2, step // 2)
        low, high = view[:, :, 0].copy(), view[:, :, 1] * roots(step, True) % PRIME
        view[:, :, 0] = (low + high) % PRIME
        view[:, :, 1] = (low - high) % PRIME
        step *= 2
    return rows * pow(size, PRIME - 2, PRIME) % PRIME


def mismatches(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Sums of squared differences, modulo the prime, of each block of ``b`` values with the ``b`` windows of its row of ``2 b`` values."""
    count, width = blocks.shape
    turned = np.zeros((count, 2 * width), np.int64)
    turned[:, :width] = blocks[:, ::-1]
    product = back(transform(turned) * transform(windows.copy()) % PRIME)[:, width - 1 : 2 * width - 1]
    own = (blocks * blocks % PRIME).sum(axis=1, keepdims=True)
    before = np.zeros((count, 2 * width + 1), np.int64)
    np.cumsum(windows * windows % PRIME, axis=1, out=before[:, 1:])
    return (own + before[:, width : 2 * width] - before[:, :width] - 2 * product) % PRIME


def reach(words: np.ndarray) -> np.ndarray:
    """How far after each place its word comes again; a very large number where it does not."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), np.iinfo(np.int64).max)
    again = words[order[1:]] == words[order[:-1]]
    out[order[:-1][again]] = (order[1:] - order[:-1])[again]
    return out


def agree(words: np.ndarray, place: int, distance: int, forward: bool) -> int:
    """How many words from ``place`` on (before it, if not forward) equal those ``distance`` later, in steps that double."""
    have, step = 0, 64
    room = len(words) - distance - place if forward else place
    while have < room:
        part = min(step, room - have)
        low = place + have if forward else place - have - part
        differ = np.flatnonzero(words[low : low + part] != words[low + distance : low + distance + part])
        if len(differ):
            return have + int(differ[0] if forward else part - 1 - differ[-1])
        have, step = have + part, 2 * step
    return have


def inside(runs: list[tuple[int, int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each stretch whether one of the runs (start, end, period) holds it whole."""
    if not runs:
        return np.zeros(len(starts), bool)
    spans = np.array(runs)[:, :2]
    spans = spans[np.argsort(spans[:, 0])]
    farthest = np.maximum.accumulate(spans[:, 1])  # of all that start no later
    at = np.searchsorted(spans[:, 0], starts, "right") - 1
    return (at >= 0) & (farthest[np.maximum(at, 0)] >= ends)


def seeds(words: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of the blocks starting at ``at`` that agree with a window ``width`` to ``2 width - 1`` words later."""
    places, distances = [], []
    rows = max(1, SLICE // (2 * width))
    for i in range(0, len(at), rows):
        some = at[i : i + rows]
        zero = mismatches(words[some[:, None] + np.arange(width)], words[some[:, None] + np.arange(width, 3 * width)]) == 0
        row, shift = np.nonzero(zero)
        places.append(some[row])
        distances.append(shift + width)
    return np.concatenate(places), np.concatenate(distances)


def runs_of(words: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """Start, end and smallest period of every maximal run in a row of numbers from 0 on; ``longest`` bounds a run's length."""
    n = len(words)
    longest = n if longest is None else min(longest, n)
    far, found, width = reach(words), [], 1
    # past the end stand numbers that occur once
    filled = np.concatenate([words, words.max(initial=0) + 1 + np.arange(longest + 4)])
    while LEAST_PERIODS * width <= longest:
        at = np.flatnonzero(far < 2 * width) * width
        if len(at):
            place, distance = seeds(filled, at, width)
            # the first block in a run goes on with its distance for more than two distances
            near = place + 3 * distance < n
            place, distance = place[near], distance[near]
            for part in range(9):
                there = place + part * distance // 4
                near = filled[there] == filled[there + distance]
                place, distance = place[near], distance[near]
            # inside a run of a shorter period only multiples of that period agree so far, and they are no periods of their own
            near = ~inside(found, place, place + 3 * distance)
            place, distance = place[near], distance[near]
            order = np.lexsort((place, distance))
            last, done = 0, -1
            for p, d in zip(place[order].tolist(), distance[order].tolist(), strict=True):
                if d == last and p < done:
                    continue
                ahead = agree(words, p, d, True)
                last, done = d, p + ahead
                if ahead <= 2 * d:
                    continue
                start, end = p - agree(words, p, d, False), p + ahead + d
                if end - start >= max(LEAST_WORDS, LEAST_PERIODS * d):
                    found.append((start, end, d))
        # of each block of twice the width; a block cut off by the end is left out
        far = np.maximum(far[0 : len(far) // 2 * 2 : 2], far[1::2])
        width *= 2
    return found


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, with single spaces."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return " ".join([x for x, k in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not k])


def find_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and the text without their repetitions.

    ``rewrite(doc_id, words)``, if given, changes the words of a document before they are looked at.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            texts = [WORD.findall(x) for x in batch["text"].to_pylist()]
            if rewrite:
                texts = [rewrite(i, x) for i, x in zip(ids, texts, strict=True)]
            numbers, offsets, used = [], [0], 0
            for x in texts:
                seen: dict[str, int] = {}
                numbers += [seen.setdefault(w, used + len(seen)) for w in x]
                used += len(seen)
                offsets.append(len(numbers))
            per: list[list[tuple[int, int, int]]] = [[] for _ in ids]
            places = np.array(offsets)
            for start, end, period in runs_of(np.array(numbers, np.int64), max(map(len, texts), default=0)):
                row = int(np.searchsorted(places, start, "right")) - 1
                per[row].append((start - offsets[row], end - start, period))
            for x in per:
                x.sort(key=lambda r: (r[0], r[2]))
            out = [pa.array(ids, pa.int64()), pa.array([len(x) for x in texts], pa.int64()),
                   pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in per],
                            pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                   pa.array([collapsed(*x) for x in zip(texts, per, strict=True)], pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, f"doc_id long, n_words long, runs {RUN}, collapsed string")
