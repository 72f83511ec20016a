"""Token ids in length-delimited binary records, with a separate offset index.

A shard file is a row of frames: length (u64), masked CRC of the length bytes (u32), payload, masked CRC of the
payload (u32), all little-endian; the CRC is that of zlib.  A payload is one byte (bit 0: the row has a
``doc_id``; bits 1 to 7: bytes per id), the ``doc_id`` (i64) and the ids.  The index beside it has an entry for
each record: ``doc_id`` (i64), offset of the frame (u64), number of ids (u64), so that any record can be read alone.

Shards are ranges of ``doc_id``; records ascend in it, ties by a hash of the text.  Files are written under a
name of the attempt and then moved, so a task that runs again leaves one file.  A null text is empty and has
the end id only.  A null ``doc_id`` comes first.  An empty table gives an empty manifest.  A text of any length is one record, held
whole with its ids while it is written and read.  Further columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.common import text_of
from lonja.llm.tokens import default_path, encoder
from lonja.session import scratch_dir, written

END_ID = 1
MANIFEST = "shard long, file string, n_docs long, n_ids long"
RECORD = "doc_id long, shard long, position long, n_ids long, ids binary"
MASK = 0xA282EAD8
ENTRY = "<qQQ"


def masked_crc(data: bytes) -> int:
    """A rotated checksum plus a constant, so that a checksum of data with checksums inside is no fixed point."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(stream) -> bytes | None:
    """The next payload of an open file, None at its end; a damaged frame is an error."""
    head = stream.read(12)
    if not head:
        return None
    length, crc = struct.unpack("<QI", head)
    if crc != masked_crc(head[:8]):
        raise ValueError("damaged length of a record")
    payload = stream.read(length)
    if len(payload) < length or struct.unpack("<I", stream.read(4))[0] != masked_crc(payload):
        raise ValueError("damaged record")
    return payload


def to_payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    if width == 2:
        ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
    return struct.pack("<Bq", width << 1 | (doc_id is not None), doc_id or 0) + ids


def from_payload(payload: bytes) -> tuple[int | None, bytes]:
    head, doc_id = struct.unpack_from("<Bq", payload)
    ids = np.frombuffer(payload, f"<u{head >> 1}", offset=9).astype("<u4").tobytes()
    return doc_id if head & 1 else None, ids


def open_store(uri: str):
    """File system and path of a folder in any store that pyarrow reads."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_records(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write shard and index files into a shared folder; the manifest with a row for each shard."""
    spark = docs.sparkSession
    folder = folder or scratch_dir(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        encode = encoder(path or default_path("word_bpe_49k.json"))
        width = 2 if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        end, n_docs, n_ids, offset = array("I", [end_id]).tobytes(), 0, 0, 0
        store, base = open_store(folder)
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{shard:06d}"
        with store.open_output_stream(f"{name}.bin.{attempt}") as out, store.open_output_stream(f"{name}.idx.{attempt}") as index:
            while first is not None:
                for doc_id, ids in zip(first["doc_id"].to_pylist(), encode.encode(first["text"].to_pylist()), strict=True):
                    ids += end
                    data = frame(to_payload(doc_id, ids, width))
                    out.write(data)
                    index.write(struct.pack(ENTRY, doc_id or 0, offset, len(ids) // 4))
                    n_docs, n_ids, offset = n_docs + 1, n_ids + len(ids) // 4, offset + len(data)
                first = next(batches, None)
        for kind in ("bin", "idx"):
            store.move(f"{name}.{kind}.{attempt}", f"{name}.{kind}")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "file": f"{folder}/part-{shard:06d}", "n_docs": n_docs, "n_ids": n_ids}])

    rows = docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return written(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, path = open_store(row["file"] + ".bin")
            rows, size, position = [], 0, row["start"]
            with store.open_input_stream(path) as stream:
                while (payload := unframe(stream)) is not None:
                    doc_id, ids = from_payload(payload)
                    rows.append((doc_id, row["shard"], position, len(ids) // 4, ids))
                    position, size = position + len(ids) // 4, size + len(ids)
                    if size > 8 << 20:
                        yield _batch(rows)
                        rows, size = [], 0
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)],
                                      [x.split()[0] for x in RECORD.split(", ")])


def read_records(manifest: DataFrame) -> DataFrame:
    """All records in their order: ``position`` is the number of ids before the record."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard, not per document
    starts = manifest.select("shard", "file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    spread = starts.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 4, "shard")
    return spread.mapInArrow(_read, RECORD)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, path = open_store(row["file"] + ".idx")
            with store.open_input_stream(path) as stream:
                while data := stream.read(struct.calcsize(ENTRY) << 15):
                    table = np.frombuffer(data, "<i8").reshape(-1, 3)  # doc_id, offset, number of ids
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["file"]] * len(table)), pa.array(table[:, 1])], ["file", "offset"])


def _seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, files = [], {}
        try:
            for file, offset in zip(batch["file"].to_pylist(), batch["offset"].to_pylist(), strict=True):
                if file not in files:
                    store, path = open_store(file + ".bin")
                    files[file] = store.open_input_file(path)
                files[file].seek(offset)
                rows.append(from_payload(unframe(files[file])))
        finally:
            for stream in files.values():
                stream.close()
        ids, values = list(zip(*rows, strict=True)) or ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "ids"])


def read_shuffled(manifest: DataFrame, seed: int) -> DataFrame:
    """Every record once in an order drawn by ``seed``, by seeking to the offsets of the index files."""
    entries = manifest.select("file").mapInArrow(_entries, "file string, offset long")
    drawn = entries.withColumn("at", F.xxhash64(F.lit(seed), F.regexp_extract("file", r"[^/]+$", 0), "offset"))
    return drawn.repartition("at").sortWithinPartitions("at").select("file", "offset").mapInArrow(_seek, "doc_id long, ids binary")
