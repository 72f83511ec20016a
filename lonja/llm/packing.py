"""Packing documents into sequences of a fixed number of tokens by best-fit decreasing.

A document's ids and an end id are first cut into full windows, which are sequences by themselves.  The rests
are dealt to shards of bounded size; in each shard, from the longest to the shortest, a rest goes to the open
sequence with the least room that holds it.  A segment tree over the remaining room finds that sequence.

Null texts count as empty and give one piece, the end id.  Rows that repeat are packed one by one.  An empty
table gives no pieces.  A sequence is padded to the window unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import text_of
from lonja.llm.tokens import default_path, encoder
from lonja.session import written

WINDOW, END_ID = 1024, 0
SHARD_PIECES = 1 << 15
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SEQUENCE_BITS = 24  # sequences of a shard; a shard has at most a few times SHARD_PIECES of them


def pieces(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Full windows and the rest of each document; ``ids`` are little-endian unsigned 32-bit."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path or default_path("byte_bpe_50k.json")).encode
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"].to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, part))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(x, pa.int64()) for x in columns[:5]] + [pa.array(columns[5], pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECE + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(cut, schema)


class Room:
    """Open sequences by remaining room: a segment tree with the number of sequences in each range of rooms."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.tree[node] += by
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of at least ``need`` that an open sequence has."""
        tree, node = self.tree, need + self.size
        if not tree[node]:
            while node & 1 or not tree[node + 1]:  # up to the first right neighbour that has something
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        return node - self.size

    def take(self, room: int) -> int:
        self._change(room, -1)
        return self.open[room].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each length; the lengths must not increase."""
    room, sequences, offsets, used = Room(window), [], [], 0
    for length in lengths:
        left = room.tightest(length)
        if left is None:
            sequence, left, used = used, window, used + 1
        else:
            sequence = room.take(left)
        sequences.append(sequence)
        offsets.append(window - left)
        if left > length:
            room.add(left - length, sequence)
    return sequences, offsets


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    cut = written(pieces(docs, path, window, end_id, with_ids), "pack-pieces")
    # the written files fix each row's number, whatever is computed again
    cut = cut.withColumn("row", F.monotonically_increasing_id())
    whole = cut.filter(F.col("length") == window).select(
        "*", F.col("row").bitwiseOR(F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")).drop("row")
    rest = cut.filter(F.col("length") < window)
    shards = -(-rest.count() // shard_pieces) or 1

    def fit(table: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("row", "ascending")]
        table = table.sort_by(order)
        sequences, offsets = best_fit(table["length"].to_pylist(), window)
        first = table["shard"][0].as_py() << SEQUENCE_BITS
        table = table.append_column("sequence_id", pa.array([first + x for x in sequences], pa.int64()))
        return table.append_column("offset", pa.array(offsets, pa.int64())).drop_columns(["row", "shard"])

    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInArrow(fit, whole.schema)
    return whole.unionByName(packed)


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, n_tokens and ids of each sequence, from pieces that were packed ``with_ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))
    padded = F.rpad("ids", 4 * window, F.lit(pad_id.to_bytes(4, "little")))
    return out.withColumn("ids", F.when(F.bit_count("n_tokens") == 1, F.col("ids")).otherwise(padded))
