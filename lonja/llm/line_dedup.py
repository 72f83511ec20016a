"""Lines that many documents share, found with levelled sorted runs of line hashes.

Documents come in batches of descending ``doc_id``.  A batch is folded to one row per line hash, sorted by it,
and merge-anti-joined with the runs so far: what is new names its keeper, the batch's largest ``doc_id``; what
is known only adds its count.  The batch's rows become a run of level 0; a full level is compacted into one
run of the next.  Runs live in the shared scratch folder, so a lost executor costs no batch before its own.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z in lower case.  Keys of fewer than
``least_chars`` code points never count.  Null texts are one empty line.  A line that repeats in a document
counts once for it; rows that share a ``doc_id`` count one by one, and all rows of the largest keep the line.
A null ``doc_id`` is smaller than any other.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import hash128, join_groups, let, text_of
from lonja.session import written

LEAST_CHARS, LEAST_DOCS = 20, 3
#: Batches at least, documents of a batch at most, about.
BATCHES, BATCH_DOCS = 4, 1 << 27
FANOUT = 3
WHITE = " \t\n\x0b\x0c\r"
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NO_ID = -(1 << 63)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def hashed_lines(text: Column, least_chars: int) -> Column:
    """For each line the hash of its key, null where the key is too short to count.

    Letters are lowered in the whole text, which is far cheaper than line by line.
    """
    keys = F.transform(lines_of(F.translate(text, *LOWER)), lambda line: F.btrim(line, F.lit(WHITE)))
    return F.transform(keys, lambda key: F.when(F.char_length(key) >= least_chars, hash128(key)))


def fold(hashes: DataFrame) -> DataFrame:
    """One row per key of a batch: documents that hold it and the largest of them."""
    return hashes.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))


def compact(runs: list[DataFrame]) -> DataFrame:
    both = runs[0]
    for run in runs[1:]:
        both = both.unionByName(run)
    return both.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))


class Runs:
    """Levels of sorted runs; a level holds at most ``fanout`` of them."""

    def __init__(self, fanout: int = FANOUT):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """Add a folded batch; a key that a run has keeps the keeper of that run."""
        fresh = batch
        for run in self.all():
            fresh = fresh.join(run.select("key").hint("merge"), "key", "left_anti")
        if self.all():
            named = fresh.select("key", F.col("keeper").alias("named"))
            batch = batch.join(named.hint("merge"), "key", "left").select("key", "n_docs", F.col("named").alias("keeper"))
        self._put(0, batch)

    def _put(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(written(run.sortWithinPartitions("key"), f"line-run-{level}"))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, compact(full))


def shared_lines(hashed: DataFrame, least_docs: int, batches: int, fanout: int = FANOUT) -> DataFrame:
    """key, n_docs, keeper of the keys in at least ``least_docs`` rows of ``hashed`` (doc_id, keys)."""
    cuts = [x / batches for x in range(1, batches)]
    bounds = hashed.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, cuts)), F.lit(10000))).first()[0] if cuts else None
    bounds = sorted(set(bounds or []), reverse=True)
    order = F.coalesce("doc_id", F.lit(NO_ID))
    runs = Runs(fanout)
    for high, low in zip([None, *bounds], [*bounds, None], strict=True):
        part = hashed
        if high is not None:
            part = part.filter(order < high)
        if low is not None:
            part = part.filter(order >= low)
        runs.add(fold(part.select("doc_id", F.explode(F.array_compact(F.array_distinct("keys"))).alias("key"))))
    return compact(runs.all()).filter(F.col("n_docs") >= least_docs)


def drop_shared_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, batches: int | None = None) -> DataFrame:
    """doc_id, text without the lines it loses, n_lines before, n_dropped; ``batches`` grow with the documents unless given."""
    text = text_of()
    hashed = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), hashed_lines(text, least_chars).alias("keys"))
    hashed = written(hashed.filter(F.exists("keys", lambda x: x.isNotNull())), "line-hashes")
    batches = batches or max(BATCHES, -(-hashed.count() // BATCH_DOCS))
    shared = written(shared_lines(hashed, least_docs, batches), "shared-lines")

    lines = hashed.select("doc_id", "text_hash", F.posexplode("keys").alias("position", "key")).filter("key is not null")
    lost = join_groups(lines, shared, ["key"], "n_docs").filter(F.col("n_docs").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc_id", "text_hash").agg(F.collect_set("position").alias("lost"))

    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_hash")).alias("own")
    found = own.join(lost.alias("lost"), F.col("own.doc_id").eqNullSafe(F.col("lost.doc_id")) &
                     (F.col("own.text_hash") == F.col("lost.text_hash")), "left").select("own.doc_id", "text", "lost")
    # lost lines become null by one merge over positions, so that a text of very many lines is one pass
    lines = lines_of(F.col("text"))
    flags = F.array_sort(F.concat(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.lit(1).alias("kind"), x.alias("line"))),
                                  F.transform("lost", lambda i: F.struct(i.alias("i"), F.lit(0).alias("kind"), F.lit("").alias("line")))))
    kept = F.array_join(let(flags, lambda v: F.filter(v, lambda x, i: (x["kind"] == 1) & (
        (i == 0) | (F.get(v, i - 1)["kind"] == 1)))["line"]), "\n")
    return found.select("doc_id", F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias("text"),
                        F.size(lines_of(F.col("text"))).cast("long").alias("n_lines"),
                        F.coalesce(F.size("lost"), F.lit(0)).cast("long").alias("n_dropped"))
