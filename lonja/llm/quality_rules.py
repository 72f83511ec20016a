"""Quality rules as a short-circuit cascade.

Each rule is a condition on the text under which a document goes.  The cost of a rule and the share it rejects
are measured on a sample; rules then run in the order of rejection per cost, and a row that one rejects is
not shown to the next (a CASE evaluates its branches in turn).  The order changes the work, and the name of
the rule that a row is charged to, but never which rows are kept.

Null and empty texts have no words.  Very long texts are handled in one row each, in time n log n.  Repeated
rows get equal results; an empty table gives none.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.llm.common import let, text_of
from lonja.session import written

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
LEAST_WORDS, MOST_REPEATED = 50, 50


def without(text: Column, chars: str) -> Column:
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """Runs of characters other than ``[\\x20\\x09-\\x0D]``."""
    for char in WHITE[1:]:
        text = F.replace(text, F.lit(char), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def n_symbols(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(without(text, SYMBOLS))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    return let(lines, lambda v: F.size(v) - F.size(F.array_distinct(v)))


def n_repeat_words(words: Column) -> Column:
    """Words inside a window of three words that the text has twice or more.

    A window becomes a long: its hash above, its position in as many low bits as the text needs.  Sorted, equal
    windows are neighbours, which their words at both positions confirm; what they cover is then a sum over their sorted
    positions.  Only a window of other words with an equal hash between two equal ones could hide them: at ten
    million words, whose hashes keep 40 bits, that is expected for about one in 100,000 windows that occur twice.
    """
    def of_words(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits)

        def of_low(mask: Column) -> Column:
            keep = F.bitwise_not(mask - 1)
            windows = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i:
                                  F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(keep) + i)

            def word(x: Column, i: int) -> Column:
                return F.get(w, (x.bitwiseAND(mask - 1) + i).cast("int"))

            def near(a: Column, b: Column) -> Column:
                alike = (a.bitwiseXOR(b) >= 0) & (a.bitwiseXOR(b) < mask)
                return F.coalesce(alike & (word(a, 0) == word(b, 0)) & (word(a, 1) == word(b, 1)) & (word(a, 2) == word(b, 2)), F.lit(False))

            twice = let(F.sort_array(windows), lambda s: F.filter(s, lambda x, i: near(x, F.get(s, i + 1)) | (
                (i > 0) & near(x, F.get(s, i - 1)))))
            places = F.sort_array(F.transform(twice, lambda x: x.bitwiseAND(mask - 1)))
            covered = let(places, lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))),
                F.lit(0).cast("long"), lambda a, x: a + x))
            return covered
        return let(low, of_low)
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(let(words, of_words))


def measured(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, the words and the base counts, with further columns."""
    text = text_of()
    frame = docs.select("doc_id", *more, text.alias("text"), words_of(text).alias("words"))
    return frame.select(
        "doc_id", *more, "text", F.size("words").cast("long").alias("n_words"),
        F.char_length(without(F.col("text"), WHITE)).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).cast("long").alias("n_symbols"), n_dup_lines(F.col("text")).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column


def rules() -> list[Rule]:
    """The production rules, on the text and the base counts."""
    text = F.col("text")
    shouted = F.octet_length(text) - F.octet_length(without(text, "!"))
    upper = F.char_length(F.regexp_replace(text, r"\P{Lu}+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > 2 * F.col("n_words")),
        Rule("exclamations", 10 * shouted > 3 * F.col("n_words")),
        Rule("capitals", 100 * upper > 40 * F.col("word_chars")),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3) & (100 * F.col("n_dup_lines") > 30 * F.size(F.split(text, "\n")))),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 40 * F.col("n_words")),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words"))),
    ]


def ordered(docs: DataFrame, candidates: list[Rule], sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejected rows per second, measured on about ``sample_rows`` documents; only those are looked at."""
    total = docs.count()
    part = docs.sample(fraction=min(1.0, sample_rows / total), seed=1) if total else docs
    part = written(measured(part), "rule-sample")

    def seconds(column: Column) -> tuple[float, int]:
        start = time.perf_counter()
        found = part.agg(F.count_if(column)).first()[0]
        return time.perf_counter() - start, found

    seconds(F.lit(True))
    idle = min(seconds(F.lit(True))[0] for _ in range(2))
    worth = {}
    for rule in candidates:
        took, rejected = seconds(rule.rejects)
        worth[rule.name] = rejected / max(took - idle, 1e-3)
    return sorted(candidates, key=lambda r: (-worth[r.name], r.name))


def cascade(frame: DataFrame, chosen: list[Rule]) -> DataFrame:
    """With ``rejected_by``, the first rule that rejects a row; null for those that stay."""
    first = F.lit(None).cast("string")
    for rule in reversed(chosen):
        first = F.when(rule.rejects, F.lit(rule.name)).otherwise(first)
    return frame.withColumn("rejected_by", first)
