"""Byte-level BPE by merge ranks, encoding and decoding.

Each match of the split pattern is encoded alone.  A segment tree over its byte positions holds in every node
the leftmost minimum pair rank below, as rank and position in one number.  A merge takes the root's pair, and
writes three leaves with their paths: the merged token's pair, its left live neighbour's, and the removed one.
Distinct pieces are encoded once per worker, in a bounded cache.

A null text is empty and has no ids.  Repeated rows give repeated results; an empty table gives none.  A text is held
whole with its ids, and a piece of it (white space alone, one long word) with some list entries a byte, so that a
piece of tens of megabytes needs gigabytes.  Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import text_of
from lonja.llm.tokens import default_path

NONE = 1 << 62
SHIFT = 32  # of a rank above a position
CACHED, CACHED_BYTES = 500_000, 48
ENCODED = "doc_id long, n_tokens long, ids binary, decoded binary"


class Merges:
    """Ranks of byte strings, as ids of pairs of ids."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            lines = (line.split() for line in file if line.strip())
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([x])] for x in range(256)]
        #: for a left and a right id, the id of both together
        self.pairs = {(left, right): rank for token, rank in self.ranks.items() for i in range(1, len(token))
                      if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None}
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        ids, n = [self.single[x] for x in piece], len(piece)
        if n < 2:
            return ids
        pair = self.pairs.get
        size = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            if (rank := pair((ids[i], ids[i + 1]))) is not None:
                tree[size + i] = rank << SHIFT | i
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                if other < value:
                    value = other
                node >>= 1
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] != NONE:
            rank, i = tree[1] >> SHIFT, tree[1] & ((1 << SHIFT) - 1)
            gone = after[i]
            right = after[i] = after[gone]
            ids[i] = rank
            put(gone, NONE)
            if right < n:
                before[right] = i
                joined = pair((rank, ids[right]))
                put(i, NONE if joined is None else joined << SHIFT | i)
            else:
                put(i, NONE)
            if (left := before[i]) >= 0:
                joined = pair((ids[left], rank))
                put(left, NONE if joined is None else joined << SHIFT | left)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def piece(self, text: str) -> bytes:
        data = text.encode()
        whole = self.ranks.get(data)
        return array("I", self.merge(data) if whole is None else [whole]).tobytes()

    def encode(self, pieces: list[str]) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        known, long = self.known, {}
        if len(known) > CACHED:
            known.clear()
        for new in set(pieces).difference(known):
            (known if len(new) <= CACHED_BYTES else long)[new] = self.piece(new)
        table = known | long if long else known
        return b"".join(map(table.__getitem__, pieces))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, array("I", ids)))


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def splitter(pattern: str | None = None):
    import public_tokenizers
    import regex

    return regex.compile(pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, the ids and what they decode to; with ``digests`` the lowercase SHA-256 of both instead."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = merges(path or default_path("byte_bpe_50k.tiktoken")), splitter(pattern).findall
        shown = (lambda x: hashlib.sha256(x).hexdigest()) if digests else (lambda x: x)
        for batch in batches:
            counts, ids, texts = [], [], []
            for text in batch["text"].to_pylist():
                coded = bpe.encode(split(text))
                counts.append(len(coded) // 4)
                ids.append(shown(coded))
                texts.append(shown(bpe.decode(coded)))
            kind = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(texts, kind)], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else ENCODED
    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of encoded rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges(path or default_path("byte_bpe_50k.tiktoken"))
        for batch in batches:
            texts = [bpe.decode(x).decode("utf-8", "replace") for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
