"""Front-coded sorted runs, and their merge by a loser tree that never compares a known common prefix again."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa


class Suffix(NamedTuple):
    """A suffix from its anchor on, with what stands before it and where it is.

    ``right`` starts at the anchor; ``left`` is the text before it, nearest byte first.  The windows that the
    suffix stands for start ``low`` to ``high`` bytes before the anchor.  ``known`` suffixes occur more than
    once in their own run; their places are settled there and are not sent.
    """

    right: bytes
    left: bytes
    low: int
    high: int
    known: bool
    doc_id: int
    text_hash: int
    at: int


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    apart = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (apart.bit_length() + 7) // 8


def pack_run(suffixes: list[Suffix]) -> bytes:
    """A sorted run: of each ``right`` only what differs from the one before."""
    shared, tails, before = [], [], b""
    for x in suffixes:
        same = common(before, x.right)
        shared.append(same)
        tails.append(x.right[same:])
        before = x.right
    columns = [
        np.array(shared, "<u2"), np.array([len(x) for x in tails], "<u2"), np.array([len(x.left) for x in suffixes], "<u2"),
        np.array([x.low for x in suffixes], "<u2"), np.array([x.high for x in suffixes], "<u2"), np.array([x.known for x in suffixes], "u1"),
        np.array([x.doc_id for x in suffixes], "<i8"), np.array([x.text_hash for x in suffixes], "<i8"), np.array([x.at for x in suffixes], "<i8")]
    body = b"".join([x.tobytes() for x in columns] + tails + [x.left for x in suffixes])
    return struct.pack("<QQ", len(suffixes), len(body)) + pa.Codec("zstd").compress(body, asbytes=True)


def unpack_run(data: bytes) -> Iterator[tuple[int, Suffix]]:
    """The suffixes of a run, each with the length it shares with the one before."""
    n, size = struct.unpack_from("<QQ", data)
    body = pa.Codec("zstd").decompress(data[16:], size, asbytes=True)
    at, columns = 0, []
    for kind in ("<u2", "<u2", "<u2", "<u2", "<u2", "u1", "<i8", "<i8", "<i8"):
        column = np.frombuffer(body, kind, n, at)
        columns.append(column.tolist())
        at += column.nbytes
    left_at, right = at + sum(columns[1]), b""
    for shared, tail, left, low, high, known, doc_id, text_hash, place in zip(*columns, strict=True):
        right = right[:shared] + body[at : at + tail]
        yield shared, Suffix(right, body[left_at : left_at + left], low, high, bool(known), doc_id, text_hash, place)
        at, left_at = at + tail, left_at + left


def merge(runs: list[Iterator[tuple[int, Suffix]]]) -> Iterator[tuple[int, Suffix]]:
    """All suffixes in order, each with the length it shares with the one before.

    Every stream's head knows how much it shares with the last one given out.  Of two heads, the one that
    shares more is smaller and no byte is looked at; when both share the same, bytes are compared from there, and
    the loser remembers how much it shares with the winner.
    """
    streams = len(runs)
    if not streams:
        return
    size = 1 << (streams - 1).bit_length()
    heads: list[Suffix | None] = [None] * size
    shares = [0] * size
    for i, run in enumerate(runs):
        heads[i] = next(run, (0, None))[1]

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        same = common(x.right, y.right, shares[a])
        if x.right[same : same + 1] <= y.right[same : same + 1]:
            shares[b] = same
            return a, b
        shares[a] = same
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    best = winners[1]
    while (suffix := heads[best]) is not None:
        yield shares[best], suffix
        shares[best], heads[best] = next(runs[best], (0, None))
        node = (best + size) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1
