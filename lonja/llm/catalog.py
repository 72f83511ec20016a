"""The registered queries of this package and the SQL that some of them must agree with."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.binary_records import read_records, write_records
from lonja.llm.byte_bpe import encode
from lonja.llm.chat_format import format_chats, read_back, under_loss
from lonja.llm.collocations import collocations
from lonja.llm.common import documents, prepare
from lonja.llm.exact_dedup import exact_groups
from lonja.llm.line_dedup import drop_shared_lines
from lonja.llm.minhash import near_groups
from lonja.llm.packing import pack
from lonja.llm.periodic_runs import find_runs
from lonja.llm.personal_data import KINDS, find, spans_text
from lonja.llm.quality_rules import base_failed, cascade, measured, ordered, rules
from lonja.llm.suffix_dedup import remove_repeats
from lonja.llm.toxicity import THRESHOLD, score

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(run):
        QUERIES[run.__name__] = run
        if sql:
            SQL[run.__name__] = sql
        return run
    return register


@query(r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
     r AS (SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                  first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), hash_all=True).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_hash")).alias("text_sha256"))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir)).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query()
def op6_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_records(documents(spark, sf_dir))).select(
        "doc_id", F.col("position").alias("start"), F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query()
def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), digests=True)


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
     k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
     s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
     d AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_shared_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))

@query(r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
     l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
           WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
     dl AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM l GROUP BY doc_id),
     a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
     x AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM a),
     g AS (SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
     r AS (SELECT doc_id, i, c IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, b, c) >= 2 AS twice FROM g),
     s AS (SELECT doc_id, i, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside FROM r),
     rw AS (SELECT doc_id, count(*) FILTER (inside) AS n_repeat_words FROM s GROUP BY doc_id),
     m AS (SELECT doc_id, text, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                  length(regexp_replace(text, '[^!]', '', 'g')) AS shouted, length(regexp_replace(text, '\P{Lu}', '', 'g')) AS upper,
                  len(string_split(text, chr(10))) AS n_lines
           FROM a LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id)),
     f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 2 * n_words OR 10 * shouted > 3 * n_words OR 100 * upper > 40 * word_chars
            OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_repeat_words > 40 * n_words
            OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM f""")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return cascade(measured(docs), ordered(docs, rules())).withColumn("base_failed", base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("rejected_by").isNull()).alias("kept"))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return score(documents(spark, sf_dir), labels).select(
        "doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query()
def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return find(documents(spark, sf_dir)).select(
        "doc_id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.concat("base", "added")).alias("spans"))


@query(r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, unnest(CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w
               ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS g FROM w),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     k AS (SELECT doc_id, n, s.g, row_number() OVER (PARTITION BY doc_id ORDER BY df, s.g) AS r
           FROM s JOIN n USING (doc_id) JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) d ON d.g = s.g),
     c AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny
           FROM k a JOIN k b ON a.g = b.g AND a.doc_id < b.doc_id
            AND a.r <= a.n // 5 + 1 AND b.r <= b.n // 5 + 1 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
     e AS (SELECT x, y FROM c JOIN s a ON a.doc_id = x JOIN s b ON b.doc_id = y AND b.g = a.g
           GROUP BY x, y, nx, ny HAVING 100 * count(*) >= 80 * (nx + ny - count(*))),
     l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
     p AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT p.x, l.y FROM p JOIN l ON l.x = p.y)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM p GROUP BY x) m ON m.x = w.doc_id""")
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(documents(spark, sf_dir), size=2).select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query(r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS loss FROM conversations
           UNION ALL SELECT -1, v.turn, v.role, '<|im_end|><|im_start|>assistant ok', v.role = 'assistant' FROM (VALUES (0, 'user'), (1, 'assistant')) v (turn, role)),
     s AS (SELECT *, length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\1\\|', 'g'))
                     + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 12 + 1 + 10 + 1 AS n FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (loss), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (loss), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id""")
def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = prepare(spark).read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = F.lit("<|im_end|><|im_start|>assistant ok")
    added = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), control.alias("text"))
    done = format_chats(chats.unionByName(added))
    turns, loss = read_back(F.col("formatted")), F.array_join(under_loss(F.col("formatted"), F.col("turns")), "")
    joined = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = done.select("conv_id", F.size(turns).cast("long").alias("n_turns"), joined.alias("joined"), loss.alias("loss"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("joined", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def planted(doc_id: int | None, words: list[str]) -> list[str]:
    """Every tenth document, by the checksum of its id, goes on with a period of its own from some word on."""
    code, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or code % 10 or not n:
        return words
    start = code // 10 % n
    period = 1 + (n - start) // (3 + code // 10 % 8)
    return words[:start] + [words[start + i % period] for i in range(n - start)]


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    first = F.get(F.sort_array(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"]))), F.lit(0))
    found = find_runs(documents(spark, sf_dir), rewrite=planted).withColumn("best", first)
    length, period = -F.col("best.col1"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        period.alias("period"), F.expr("-1000 * best.col1 div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query(r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
     w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
     t AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
     s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
     g AS (SELECT lang, w[i:i + m - 1] AS g, m FROM (SELECT lang, w, i, unnest(range(1, 6)) AS m FROM s) WHERE i + m - 1 <= len(w)),
     f AS (SELECT lang, g, m, count(*) AS a FROM g GROUP BY lang, g, m HAVING count(*) >= 100),
     k AS (SELECT lang, g, m, a, unnest(range(1, m)) AS k FROM f),
     c AS (SELECT k.lang, k.g, k.a, x.a AS l, y.a AS r, n, (1000::HUGEINT * k.a * n) // (x.a::HUGEINT * y.a) AS score, k
           FROM k JOIN t ON t.lang = k.lang JOIN f x ON x.lang = k.lang AND x.g = k.g[1:k] JOIN f y ON y.lang = k.lang AND y.g = k.g[k + 1:k.m]),
     b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
     i AS (SELECT lang, g, m, a, unnest(range(2, m)) AS k FROM f),
     h AS (SELECT lang, g[j:j + k - 1] AS g, a FROM (SELECT lang, g, a, m, k, unnest(range(1, m - k + 2)) AS j FROM i)),
     d AS (SELECT b.lang, b.g FROM b JOIN h ON h.lang = b.lang AND h.g = b.g WHERE 100 * h.a >= 100 * b.a),
     o AS (SELECT b.*, array_to_string(b.g, ' ') AS phrase FROM b ANTI JOIN d ON d.lang = b.lang AND d.g = b.g)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM o QUALIFY rank <= 2000""")
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
