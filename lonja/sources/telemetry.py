"""Telemetry tables derived from the event stream and the conversations of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.sources.tpch import TpchStar

MODELS = ("small", "large", "huge")


def _events(star: TpchStar) -> DataFrame:
    return star.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def usage(star: TpchStar) -> DataFrame:
    k, prompt = F.col("k"), F.floor(F.col("value") * 10).cast("bigint")
    done = (k * 3).cast("bigint")
    return _events(star).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("endpoint"),
        F.element_at(F.array(*[F.lit(m) for m in (*MODELS, "unlisted")]), k % 4 + 1).alias("model"),
        F.when(k % 5 == 0, None).when(k % 5 == 1, "cli").otherwise("openrouter").alias("provider"),
        prompt.alias("prompt_tokens"), done.alias("completion_tokens"), (prompt + done).alias("total_tokens"),
        F.when(k % 5 != 1, k * 2).cast("bigint").alias("cache_write_tokens"),
        F.when(k % 5 != 1, k * 7).cast("bigint").alias("cache_read_tokens"),
        ((prompt * 3 + done * 15).cast("decimal(20,0)") / F.lit(1000000).cast("decimal(10,0)")).cast("decimal(18,6)").alias("cost_usd"),
        F.col("ts").alias("created_at"))


def tool_calls(star: TpchStar) -> DataFrame:
    k = F.col("k")
    return _events(star).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("endpoint"), F.concat(F.lit("tool_"), k % 3).alias("tool"),
        F.when(k % 10 == 0, "error").otherwise("ok").alias("status"),
        F.floor(F.col("value") * 10).cast("bigint").alias("latency_ms"), (k * 10).cast("bigint").alias("payload_in"),
        (k * k).cast("bigint").alias("payload_out"), F.col("ts").alias("created_at"))


def interactions(star: TpchStar) -> DataFrame:
    k = F.col("k")
    return _events(star).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("endpoint"), F.when(k % 10 == 0, "error").otherwise("ok").alias("status"),
        (F.col("user_id") % 20).cast("string").alias("dashboard"), F.col("ts").alias("started_at"))


def query_log(star: TpchStar) -> DataFrame:
    """One statement per event kind and parameter: text, calls, times and block counters."""
    k, names = F.col("k"), ("ventas", "lineas_ventas", "articulos", "tiendas", "compras", "traspasos", "familias")
    table = [F.element_at(F.array(*[F.lit(f"ps_{n}") for n in names]), k % m + 1) for m in (7, 5, 3)]
    text = F.when(k % 11 == 0, F.concat(F.lit("SELECT "), k)).otherwise(
        F.concat(F.lit("SELECT * FROM "), table[0], F.lit(" JOIN "), table[1], F.lit(" USING (k) JOIN "), table[2],
                 F.lit(" ON kind = '"), F.col("event_type"), F.lit("'")))
    return _events(star).withColumn("query", text).groupBy(
        (F.concat_ws("-", "event_type", "k")).alias("query_id"), "query").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.col("value").cast("decimal(15,2)")) / F.count(F.lit(1)), 4).alias("mean_ms"),
        F.max("value").alias("max_ms"), F.sum(F.col("value").cast("decimal(15,2)")).alias("total_ms"), F.sum("k").alias("rows"),
        F.sum(k % 10).alias("blocks_hit"), F.sum(k % 3).alias("blocks_read"))


def query_sources(star: TpchStar) -> DataFrame:
    """Known statements: one per event kind and remainder of its parameter."""
    return (query_log(star).where("query LIKE '%ps_%'").select((F.substring_index("query_id", "-", -1).cast("int") % 20).alias("source_id"), "query")
            .groupBy("source_id").agg(F.min("query").alias("query")))


def messages(star: TpchStar) -> DataFrame:
    """Conversation turns as JSON messages; assistant turns carry some tool calls."""
    turn = F.col("turn")
    n = F.when((F.col("role") == "assistant") & (turn % 4 == 1), turn % 3).otherwise(0)
    calls = F.when((F.col("role") == "assistant") & (turn % 4 == 1),
                   F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>")))
    return star.raw("conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").alias("conversation_id"), "role",
        F.to_json(F.struct(F.col("text"), calls.alias("tool_calls"))).alias("content"),
        F.length("text").alias("tokens_in"), F.when(turn % 2 == 1, F.length("text") * 2).alias("tokens_out"),
        F.timestamp_add("MINUTE", (F.col("conv_id") * 60 + turn).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"))


def conversations(star: TpchStar) -> DataFrame:
    start = F.timestamp_add("MINUTE", (F.col("conv_id") * 60).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    conv = F.col("conv_id")
    return star.raw("conversations").groupBy("conv_id").agg(
        F.max("turn").alias("last_turn"), F.min_by("text", "turn").alias("first_prompt")).select(
        conv.alias("conversation_id"), F.concat(F.lit("Conversation "), conv).alias("title"), "first_prompt", start.alias("created_at"),
        F.timestamp_add("MINUTE", F.col("last_turn").cast("int"), start).alias("last_interaction_at"),
        F.when(conv % 3 == 0, F.timestamp_add("MINUTE", F.lit(3), start)).alias("last_read_at"))


def reviews(star: TpchStar) -> DataFrame:
    """Weekly documents: each purchase event is a revision; half of the summaries are lists."""
    k = F.col("k")
    text = F.concat(F.lit("summary "), k)
    content = F.when(k % 2 == 0, F.to_json(F.struct(F.array(text, F.lit("more")).alias("executive_summary")))).otherwise(
        F.to_json(F.struct(text.alias("executive_summary"))))
    return _events(star).where("event_type = 'purchase'").select(
        F.to_date(F.date_trunc("week", "ts")).alias("week_start"), F.col("event_id").alias("review_id"),
        F.col("event_id").alias("revision"), content.alias("content"), F.col("ts").alias("created_at"))


def turn_events(star: TpchStar) -> DataFrame:
    """Event log of turns: views act as tokens, clicks as thinking, the rest is durable."""
    kind = F.when(F.col("event_type") == "view", "token").when(F.col("event_type") == "click", "thinking").otherwise(F.col("event_type"))
    return star.raw("events").select("event_id", F.col("user_id").alias("turn_id"), kind.alias("event_type"), F.col("ts").alias("created_at"))


def turns(star: TpchStar) -> DataFrame:
    return star.raw("events").select(F.col("user_id").alias("turn_id")).distinct().select(
        "turn_id", (F.col("turn_id") % 10).alias("conversation_id"), (F.col("turn_id") % 2 == 0).alias("is_finished"))


def spans(star: TpchStar) -> DataFrame:
    return spans_of(star.raw("events"))


def spans_of(events: DataFrame) -> DataFrame:
    """Trace spans: events of a user within the same ten minutes share a trace.  Works on a stream as well."""
    k = F.get_json_object("props", "$.k").cast("int")
    minute = F.floor(F.minute("ts") / 10) * 10
    slot = F.concat(F.date_format("ts", "yyyyMMddHH"), F.lpad(minute.cast("string"), 2, "0"))
    return events.select(F.concat_ws("-", "user_id", slot).alias("trace_id"), F.col("ts"),
                         (F.col("value") * 20).cast("bigint").alias("duration_ms"), (k % 25 == 0).alias("is_error"))
