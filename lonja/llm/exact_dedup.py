"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

The first pass takes only the length and a prefix hash of every normalised text.  Texts whose length, and
then whose length and prefix, occur once are settled.  What survives becomes a bit set sized by its keys, and the
second pass reads the full content of those texts only.  No text is ever shuffled.

Null texts count as empty.  Rows that share a ``doc_id`` count one by one and share a verdict when their texts
are equal.  Of a group the row with the most code points in the original text stays, then the smallest ``doc_id``; a null
``doc_id`` counts as the largest, and where its row stays the others get a null ``keep_id``.  Very long texts are hashed
where they lie and never move.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import bit_set, in_bit_set, join_groups, text_of
from lonja.session import written

WHITE = " \t\n\x0b\x0c\r"
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    """The text without any white space of ``[\\x20\\x09-\\x0D]``."""
    for char in WHITE:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def exact_groups(docs: DataFrame, hash_all: bool = False, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_hash (binary SHA-256, null where one never had to be taken).

    ``hash_all`` takes the full hash of settled texts too; it does not change the groups.
    """
    norm = normalised(text_of())
    key = F.xxhash64("n_bytes", "prefix")
    sized = docs.select("doc_id", F.char_length(text_of()).alias("n_chars"), norm.alias("norm")).select(
        "doc_id", "n_chars", "norm", F.octet_length("norm").alias("n_bytes"),
        F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"))

    seen = written(sized.groupBy("n_bytes", "prefix").agg(F.count(F.lit(1)).alias("n")), "exact-prefix")
    lengths = seen.groupBy("n_bytes").agg(F.sum("n").alias("n_length")).filter("n_length > 1").select("n_bytes")
    open_keys = written(seen.join(lengths, "n_bytes", "left_semi").filter("n > 1"), "exact-open")
    words = written(bit_set(open_keys, key), "exact-bits")

    survives = in_bit_set(words.scalar(), key)
    full = F.unhex(F.sha2("norm", 256))
    rows = sized.withColumn("open", survives).select(
        "doc_id", "n_chars", "open", (full if hash_all else F.when(F.col("open"), full)).alias("text_hash"))
    rows = written(rows, "exact-rows")

    groups = rows.filter("open").groupBy("text_hash").agg(
        F.count(F.lit(1)).alias("group_size"),
        F.max(F.struct("n_chars", (-F.col("doc_id")).alias("order"))).alias("best"))
    groups = groups.filter("group_size > 1").select("text_hash", "group_size", (-F.col("best.order")).alias("keep_id"))
    found = join_groups(rows, groups, ["text_hash"], "group_size")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_hash")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows with one ``doc_id`` and equal texts stay together."""
    gone = exact_groups(docs).filter("not kept").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("text_hash").alias("hashes"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"))
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")), "left")
    # a text is hashed again only where its document has a row that goes
    own = F.unhex(F.sha2(normalised(text_of("doc.text")), 256))
    return met.filter(F.col("hashes").isNull() | ~F.array_contains("hashes", own)).select("doc.*")
