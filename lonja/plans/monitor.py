"""Monitoring: run ledger, freshness, usage, slow queries, conversations, versioned documents."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions import metrics as M
from lonja.functions.predicates import contains_ci
from lonja.functions.redact import fingerprint
from lonja.operators.ranking import numbered, top
from lonja.operators.similarity import best_match
from lonja.plans.base import one_row

LAST_RUNS = 30
STALE_HOURS = 36
# Feeds that only a full run refreshes; they do not drive the headline (fixed values).
FULL_ONLY_FEEDS = ("catalogos", "tiendas", "proveedores", "gc_comerciales", "gc_pedidos", "gc_lin_pedidos",
                   "compras", "lineas_compras", "albaranes", "facturas_compra")


def _seconds_since(now: dt.datetime, column: str) -> Column:
    return (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(column).cast("timestamp"))) / 1e6


# --- runs -----------------------------------------------------------------------------------------


def last_runs(runs: DataFrame, n: int = LAST_RUNS) -> DataFrame:
    return top(runs, n, F.desc("started_at"), F.desc("run_id"))


def run_trend(runs: DataFrame, n: int = LAST_RUNS) -> DataFrame:
    """Duration and rows of the last runs, oldest first."""
    return last_runs(runs, n).select("run_id", "started_at", "duration_ms", "status", "total_rows").orderBy("started_at", "run_id")


def feed_durations(runs: DataFrame, run_tables: DataFrame, n: int = LAST_RUNS) -> DataFrame:
    """Mean duration of each feed in the last runs, and its newest duration over all runs, from one pass over the ledger of tables.

    A feed without a row in the last runs is left out.
    """
    chosen = last_runs(runs, n).select("run_id", F.lit(True).alias("recent"))
    marked = runs.select("run_id", F.col("started_at").alias("run_start")).join(F.broadcast(chosen), "run_id", "left")
    sums = run_tables.select("run_id", "feed", "started_at", "duration_ms").join(marked, "run_id").groupBy("feed").agg(
        F.coalesce(F.round(F.avg(F.when(F.col("recent"), F.col("duration_ms")))), F.lit(0)).cast("bigint").alias("avg_ms"),
        F.max_by("duration_ms", F.struct("run_start", "started_at")).alias("last_ms"), F.bool_or("recent").alias("shown"))
    return sums.where("shown").drop("shown").orderBy(F.desc("avg_ms"), "feed")


def run_outcomes(runs: DataFrame, n: int = LAST_RUNS) -> DataFrame:
    return last_runs(runs, n).agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial", "failed")])


def _finished(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status").isin("success", "partial"))


def last_finished_run(runs: DataFrame) -> DataFrame:
    """The newest finished run with its throughput."""
    return (top(_finished(runs), 1, F.desc("started_at"), F.desc("run_id"))
            .select("run_id", "duration_ms", "total_rows", M.throughput("total_rows", "duration_ms").alias("rows_per_second")))


def biggest_feeds(runs: DataFrame, run_tables: DataFrame, k: int = 10) -> DataFrame:
    """Feeds of the newest finished run by rows."""
    newest = top(_finished(runs), 1, F.desc("started_at"), F.desc("run_id")).select("run_id")
    rows = run_tables.join(F.broadcast(newest), "run_id", "left_semi").select("feed", "rows_synced", "entry_id")
    return top(rows, k, F.desc("rows_synced"), F.asc("feed"), F.asc("entry_id"))


def recent_failures(runs: DataFrame, run_tables: DataFrame, now: dt.datetime, hours: int = 24) -> DataFrame:
    """Failed runs and failed tables of runs that started in the last hours."""
    since = F.lit(now - dt.timedelta(hours=hours))
    recent = runs.where(F.col("started_at") > since)
    failed_runs = recent.agg(F.count_if(F.col("status") == "failed").alias("runs_failed"))
    tables = run_tables.where(F.col("status") == "failed").join(recent.select("run_id"), "run_id", "left_semi")
    return one_row(failed_runs, tables.agg(F.count(F.lit(1)).alias("tables_failed")))


def run_header(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def run_detail(run_tables: DataFrame, run_id: int) -> DataFrame:
    return run_tables.where(F.col("run_id") == run_id).orderBy("started_at", "feed")


# --- freshness ------------------------------------------------------------------------------------


def oldest_watermark(watermarks: DataFrame, now: dt.datetime) -> DataFrame:
    known = watermarks.where(F.col("status").isin("ok", "error"))
    return top(known, 1, F.asc("last_sync_at"), F.asc("feed")).select(
        "feed", F.floor(_seconds_since(now, "last_sync_at")).cast("bigint").alias("age_seconds"))


def freshness(watermarks: DataFrame, now: dt.datetime, stale_hours: float = STALE_HOURS) -> DataFrame:
    """Every feed with its age; stale is strictly more than the limit."""
    return watermarks.select("feed", "last_sync_at", (_seconds_since(now, "last_sync_at") > stale_hours * 3600).alias("is_stale"))


def health(watermarks: DataFrame, now: dt.datetime, stale_hours: float = STALE_HOURS,
           excluded: Sequence[str] = FULL_ONLY_FEEDS) -> DataFrame:
    """Headline freshness over the feeds that delta runs refresh; the stalest of all if none is left."""
    rows = freshness(watermarks, now, stale_hours).withColumn("in_headline", ~F.col("feed").isin(*excluded))
    rank = F.struct(~F.col("in_headline"), F.col("last_sync_at"), F.col("feed"))
    return rows.agg(F.count(F.lit(1)).alias("feeds"),
                    F.coalesce(F.bool_or(F.col("is_stale") & F.col("in_headline")), F.lit(False)).alias("any_stale"),
                    F.min_by("feed", rank).alias("stalest"), F.min_by("last_sync_at", rank).alias("stalest_sync"))


def readiness(watermarks: DataFrame, now: dt.datetime, stale_hours: float = STALE_HOURS) -> DataFrame:
    """The same without exclusions."""
    return health(watermarks, now, stale_hours, excluded=("",))


# --- usage and cost -------------------------------------------------------------------------------

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens", "cost_usd")


def usage_by_period(usage: DataFrame, today: dt.date) -> DataFrame:
    """Tokens and cost today, in the last 7 and in the last 30 days, in one pass."""
    spans = {"today": 0, "week": 7, "month": 30}
    since = {n: today - dt.timedelta(days=d) for n, d in spans.items()}
    rows = usage.where(F.col("created_at") >= F.lit(min(since.values())))
    sums = rows.agg(*[M.sum_if(F.col("created_at") >= F.lit(day), c).cast("decimal(38,6)").alias(f"{n}_{c}")
                      for n, day in since.items() for c in USAGE])
    cells = [F.struct(F.lit(n).alias("period"), *[F.col(f"{n}_{c}").alias(c) for c in USAGE]) for n in spans]
    return sums.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def usage_by_endpoint(usage: DataFrame) -> DataFrame:
    return usage.groupBy("endpoint").agg(F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"),
                                         F.sum("cost_usd").alias("cost_usd")).orderBy(F.desc("total_tokens"), "endpoint")


def usage_by_provider(usage: DataFrame, default: str = "openrouter") -> DataFrame:
    """Calls, tokens, cost and cache hit rate per provider; no cache information means no rate."""
    sums = usage.groupBy(F.coalesce("provider", F.lit(default)).alias("provider")).agg(
        F.count(F.lit(1)).alias("calls"), F.sum("total_tokens").alias("total_tokens"), F.sum("cost_usd").alias("cost_usd"),
        F.sum("prompt_tokens").alias("prompt"), F.sum("cache_write_tokens").alias("cache_write"),
        F.sum("cache_read_tokens").alias("cache_read"))
    return sums.withColumn("cache_hit_pct", M.cache_hit_pct("cache_read", "prompt", "cache_write")).orderBy(F.desc("calls"), "provider")


def call_cost(usage: DataFrame, rates: DataFrame, default: Sequence[float], billed_provider: str = "openrouter") -> DataFrame:
    """Cost per call from a price list per million tokens; unknown models pay the default, other providers nothing.

    ``rates`` is (model, prompt_rate, completion_rate, write_rate, read_rate).
    """
    names = ("prompt_rate", "completion_rate", "write_rate", "read_rate")
    priced = usage.join(rates, "model", "left")
    rate = {n: F.coalesce(F.col(n), F.lit(d)) for n, d in zip(names, default)}
    zero = F.lit(0)
    cost = (F.col("prompt_tokens") * rate["prompt_rate"] + F.col("completion_tokens") * rate["completion_rate"]
            + F.coalesce("cache_write_tokens", zero) * rate["write_rate"] + F.coalesce("cache_read_tokens", zero) * rate["read_rate"])
    billed = F.coalesce("provider", F.lit(billed_provider)) == billed_provider
    return priced.withColumn("call_cost", F.when(billed, cost / 1_000_000).otherwise(0.0)).drop(*names)


def daily_budget(usage: DataFrame, today: dt.date, budget: float, billed_provider: str = "openrouter") -> DataFrame:
    """Spend of the day with the provider that bills per token, against the budget."""
    billed = usage.where((F.col("created_at") >= F.lit(today)) & (F.col("provider") == billed_provider))
    return billed.agg(M.total("cost_usd").alias("spent")).select(
        "spent", F.lit(budget).alias("budget"), (F.col("spent") >= budget).alias("exceeded"))


def tool_call_stats(calls: DataFrame, now: dt.datetime, days: int = 30) -> DataFrame:
    """Calls, mean and longest latency and payload sizes by endpoint, tool and status."""
    rows = calls.where(F.col("created_at") >= F.lit(now - dt.timedelta(days=days)))
    return rows.groupBy("endpoint", "tool", "status").agg(
        F.count(F.lit(1)).alias("calls"), F.round(F.avg(F.col("latency_ms").cast("double"))).cast("bigint").alias("avg_ms"),
        F.max("latency_ms").alias("max_ms"), F.sum("payload_in").alias("payload_in"),
        F.sum("payload_out").alias("payload_out")).orderBy(F.desc("calls"), "endpoint", "tool", "status")


def interactions(log: DataFrame, k: int = 50, **filters: str | None) -> DataFrame:
    """The newest interactions, narrowed by the given columns."""
    for column, value in filters.items():
        if value:
            log = log.where(F.col(column) == value)
    return top(log, k, F.desc("started_at"), F.desc("id"))


# --- queries --------------------------------------------------------------------------------------


def slow_queries(log: DataFrame, marker: str = "ps_", k: int = 20) -> DataFrame:
    """Slowest statements on mirror tables by mean time, with their cache hit ratio."""
    hit = M.percent("blocks_hit", M.dbl("blocks_hit") + M.dbl("blocks_read"))
    rows = log.where(F.col("query").contains(marker)).select(
        "query_id", F.left("query", F.lit(500)).alias("query"), "calls", "mean_ms", "max_ms", "total_ms", "rows", hit.alias("cache_hit_pct"))
    return top(rows, k, F.desc_nulls_last("mean_ms"), F.asc("query_id"))


def query_origins(log: DataFrame, sources: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Most likely source of each logged statement by the mirror tables both mention."""
    left = log.select("query_id", fingerprint("query").alias("tokens"))
    right = sources.select("source_id", fingerprint("query").alias("tokens"))
    return best_match(left, "query_id", right, "source_id", threshold=threshold)


# --- conversations and documents ------------------------------------------------------------------


def conversation_list(conversations: DataFrame, messages: DataFrame, search: str = "", modes: Sequence[str] = (),
                      since: dt.datetime | None = None, k: int | None = None, offset: int = 0) -> DataFrame:
    """Conversations with message counts, tool use, tokens, last preview and unread flag, newest first.

    A message content is a JSON object with a text, a JSON string, or anything else (shown as it is).
    """
    calls = F.get_json_object("content", "$.tool_calls")
    n_calls = F.when(F.col("role") == "assistant", F.coalesce(F.json_array_length(calls), F.lit(0))).otherwise(0)
    as_string = F.when(F.startswith("content", F.lit('"')), F.get_json_object("content", "$"))
    preview = F.coalesce(as_string, F.get_json_object("content", "$.text"), F.col("content"))
    stats = messages.withColumns({"_calls": n_calls, "_preview": F.left(preview, F.lit(120))}).groupBy("conversation_id").agg(
        F.count(F.lit(1)).alias("messages"), F.sum("_calls").alias("tool_calls"), F.count_if(F.col("_calls") > 0).alias("rounds"),
        F.max_by("_preview", F.struct("created_at", "message_id")).alias("preview"),
        F.sum(F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"))
    read, active = F.col("last_read_at"), F.col("last_interaction_at")
    unread = F.coalesce(F.when(read.isNull(), active > F.col("created_at")).otherwise(active > read), F.lit(False))
    rows = conversations.where(contains_ci(search, "title", "first_prompt")) if search.strip() else conversations
    if modes:
        rows = rows.where(F.col("mode").isin(*modes))
    if since is not None:
        rows = rows.where(F.col("last_interaction_at") >= F.lit(since))
    zero = F.lit(0)
    seconds = F.floor((F.unix_micros(active.cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 1e6)
    out = rows.join(stats, "conversation_id", "left").select(
        "conversation_id", unread.alias("is_unread"), F.coalesce("messages", zero).alias("messages"),
        F.coalesce("tool_calls", zero).alias("tool_calls"), F.coalesce("rounds", zero).alias("rounds"),
        seconds.alias("duration_s"), "preview", F.coalesce("tokens", zero).alias("tokens"), "last_interaction_at")
    ordered = out.orderBy(F.desc("last_interaction_at"), "conversation_id")
    return ordered.offset(offset).limit(k) if k else ordered


def latest_reviews(reviews: DataFrame, k: int = 50) -> DataFrame:
    """Per week the latest revision, how many there are, and the start of its summary."""
    newest = reviews.groupBy("week_start").agg(
        F.count(F.lit(1)).alias("revisions"), F.max("revision").alias("revision"),
        F.max_by("content", "revision").alias("content"), F.max_by("review_id", "revision").alias("review_id"))
    summary = F.get_json_object("content", "$.executive_summary")
    first = F.get_json_object("content", "$.executive_summary[0]")
    is_list = F.json_array_length(summary).isNotNull()
    text = F.when(is_list, F.coalesce(first, F.lit(""))).otherwise(F.coalesce(F.left(summary, F.lit(220)), F.lit("")))
    return top(newest.select("week_start", "review_id", "revision", "revisions", text.alias("summary")), k, F.desc("week_start"))


def document_versions(documents: DataFrame, key: str = "document_id", at: str = "created_at", tie: str = "version_id") -> DataFrame:
    """Version number of each document revision, oldest 1, those without a time first; one document may have most of them."""
    return numbered(documents, [key], [F.col(at).asc_nulls_first(), F.col(tie).asc_nulls_first()], "version")


def revision_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Entries that appear in only one of two revisions; copies of an entry do not count."""
    added = after.subtract(before).withColumn("change", F.lit("added"))
    return added.unionByName(before.subtract(after).withColumn("change", F.lit("removed")))


# --- turn events ----------------------------------------------------------------------------------

TRANSIENT_KINDS = ("token", "thinking")


def replay_after(events: DataFrame, turns: DataFrame, conversation_id, after_id: int | None = None) -> DataFrame:
    """Events of a conversation after an id, in order."""
    mine = events.join(turns.where(F.col("conversation_id") == conversation_id).select("turn_id"), "turn_id", "left_semi")
    rows = mine if after_id is None else mine.where(F.col("event_id") > after_id)
    return rows.orderBy("event_id")


def prune_transient(events: DataFrame, finished: DataFrame, kinds: Sequence[str] = TRANSIENT_KINDS) -> DataFrame:
    """Drop streaming-only events of finished turns; durable events and running turns stay."""
    done = finished.select("turn_id").distinct().withColumn("_done", F.lit(True))
    marked = events.join(done, "turn_id", "left")
    return marked.where(~(F.coalesce("_done", F.lit(False)) & F.col("event_type").isin(*kinds))).drop("_done")


# --- traces ---------------------------------------------------------------------------------------


def keep_trace(has_error: Column, duration_ms: Column, trace_id: Column, slow_ms: int = 5000, percent: int = 10) -> Column:
    """Keep errors, slow traces and a fixed share of the rest, chosen by a hash of the id."""
    lot = F.conv(F.left(F.md5(trace_id.cast("string")), F.lit(8)), 16, 10).cast("bigint") % 100
    return has_error | (duration_ms > slow_ms) | (lot < percent)


def sample_traces(spans: DataFrame, wait_seconds: int = 10, slow_ms: int = 5000, percent: int = 10) -> DataFrame:
    """Decide per trace from the spans of its first seconds."""
    first = spans.groupBy("trace_id").agg(F.min("ts").alias("first_ts"))
    seen = spans.join(first, "trace_id").where(F.col("ts") <= F.col("first_ts") + F.make_dt_interval(secs=F.lit(wait_seconds)))
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    traces = seen.groupBy("trace_id", "first_ts").agg(
        F.bool_or("is_error").alias("has_error"), F.count(F.lit(1)).alias("spans"),
        ((F.max(micros + F.col("duration_ms") * 1000) - F.min(micros)) / 1000).alias("elapsed_ms"))
    keep = keep_trace(F.col("has_error"), F.col("elapsed_ms"), F.col("trace_id"), slow_ms, percent)
    return traces.withColumn("keep", keep)
