"""Monitoring, redaction and similarity."""

import datetime as dt

from pyspark.sql import functions as F

from lonja.catalog.params import EVENTS_NOW
from lonja.catalog.registry import Catalog
from lonja.functions import labels as L
from lonja.functions import metrics as M
from lonja.functions import redact as R
from lonja.functions.periods import constants
from lonja.operators import control
from lonja.operators.similarity import best_match
from lonja.plans import monitor as m
from lonja.plans import review
from lonja.sources import telemetry as t

NOW = f"TIMESTAMP '{EVENTS_NOW}'"
TODAY = EVENTS_NOW.date()
LAST = "(SELECT * FROM r_runs ORDER BY started_at DESC, run_id DESC LIMIT 30)"
USAGE = """u AS (SELECT event_id AS id, event_type AS endpoint, (['small', 'large', 'huge', 'unlisted'])[k % 4 + 1] AS model,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 5 = 1 THEN 'cli' ELSE 'openrouter' END AS provider, CAST(floor(value * 10) AS BIGINT) AS prompt_tokens,
    k * 3 AS completion_tokens, CAST(floor(value * 10) AS BIGINT) + k * 3 AS total_tokens, CASE WHEN k % 5 <> 1 THEN k * 2 END AS cache_write_tokens,
    CASE WHEN k % 5 <> 1 THEN k * 7 END AS cache_read_tokens, CAST((CAST(floor(value * 10) AS BIGINT) * 3 + k * 3 * 15) * 0.000001 AS DECIMAL(18,6)) AS cost_usd,
    ts AS created_at FROM r_events)"""
LOG = """log AS (SELECT query_id, query, COUNT(*) AS calls, SUM(CAST(value AS DECIMAL(15,2))) AS total_ms, MAX(value) AS max_ms, SUM(k) AS rows,
    SUM(k % 10) AS blocks_hit, SUM(k % 3) AS blocks_read FROM (SELECT *, event_type || '-' || k AS query_id, CASE WHEN k % 11 = 0 THEN 'SELECT ' || k
        ELSE 'SELECT * FROM ps_' || n[k % 7 + 1] || ' JOIN ps_' || n[k % 5 + 1] || ' USING (k) JOIN ps_' || n[k % 3 + 1] || ' ON kind = ''' || event_type || '''' END AS query
        FROM r_events, (SELECT ['ventas', 'lineas_ventas', 'articulos', 'tiendas', 'compras', 'traspasos', 'familias'] AS n)) GROUP BY 1, 2)"""
TOKENS = "list_sort(list_distinct(regexp_extract_all(lower({0}), '{1}')))"
CHATS = """msg AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN turn % 3 ELSE 0 END AS calls,
    length(text) + CASE WHEN turn % 2 = 1 THEN length(text) * 2 ELSE 0 END AS tokens FROM conversations)"""
SECRET_RULE = ((r'(token\s*=\s*)"[0-9a-f]{40}"', '$1"[redacted]"', "token"), (r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "[email]", "@"))
RATES = (("small", 0.25, 1.25, 0.3, 0.03), ("large", 3.0, 15.0, 3.75, 0.3), ("huge", 15.0, 75.0, 18.75, 1.5))
DEFAULT_RATE = (3.0, 15.0, 3.75, 0.3)
WORDS = "[a-z0-9]+"


def register(c: Catalog) -> None:
    _runs(c)
    _usage(c)
    _chats(c)
    _text(c)


def _runs(c: Catalog) -> None:
    c.add("a18_run_verdicts", "run_id l, started_at ts, finished_at ts, tables_ok l, tables_failed l, total_tables l, total_rows l, duration_ms l, status s",
          lambda s: s.runs, "SELECT * FROM r_runs")
    c.add("k1_run_trend", "run_id l, started_at ts, duration_ms l, status s, total_rows l", lambda s: m.run_trend(s.runs), f"SELECT * FROM {LAST}")
    c.add("k2_feed_durations", "feed s, avg_ms l, last_ms l", lambda s: m.feed_durations(s.runs, s.run_tables), f"""
        WITH last AS (SELECT t.feed, arg_max(t.duration_ms, (r.started_at, t.started_at)) AS last_ms FROM r_run_tables t JOIN r_runs r ON r.run_id = t.run_id GROUP BY 1)
        SELECT t.feed, CAST(ROUND(AVG(t.duration_ms)) AS BIGINT) AS avg_ms, ANY_VALUE(last_ms) AS last_ms FROM r_run_tables t JOIN last ON last.feed = t.feed
        WHERE t.run_id IN (SELECT run_id FROM {LAST}) GROUP BY 1""")
    c.add("k3_run_outcomes", "total l, success l, partial l, failed l", lambda s: m.run_outcomes(s.runs), f"""
        SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'success') AS success, COUNT(*) FILTER (WHERE status = 'partial') AS partial,
            COUNT(*) FILTER (WHERE status = 'failed') AS failed FROM {LAST}""")
    newest = "SELECT run_id FROM r_runs WHERE status IN ('success', 'partial') ORDER BY started_at DESC, run_id DESC LIMIT 1"
    c.add("k4_biggest_feeds", "feed s, rows_synced l", lambda s: m.biggest_feeds(s.runs, s.run_tables),
          f"SELECT feed, rows_synced FROM r_run_tables WHERE run_id = ({newest}) ORDER BY rows_synced DESC, feed, entry_id LIMIT 10")
    c.add("k5_last_run_throughput", "run_id l, duration_ms l, total_rows l, rows_per_second d", lambda s: m.last_finished_run(s.runs), f"""
        SELECT run_id, duration_ms, total_rows, CASE WHEN duration_ms > 0 THEN ROUND(CAST(total_rows AS DOUBLE) / (CAST(duration_ms AS DOUBLE) / 1000.0), 2) END AS rows_per_second
        FROM r_runs WHERE run_id = ({newest})""")
    c.add("d29_run_throughput", "run_id l, rows_per_second d", lambda s: s.runs.select("run_id", M.throughput("total_rows", "duration_ms").alias("rows_per_second")), """
        SELECT run_id, CASE WHEN duration_ms > 0 THEN ROUND(CAST(total_rows AS DOUBLE) / (CAST(duration_ms AS DOUBLE) / 1000.0), 2) END AS rows_per_second FROM r_runs""")
    c.add("k6_oldest_watermark", "feed s, age_seconds l", lambda s: m.oldest_watermark(s.watermarks, EVENTS_NOW), f"""
        SELECT feed, CAST(floor((epoch_us({NOW}) - epoch_us(last_sync_at)) / 1e6) AS BIGINT) AS age_seconds FROM r_watermarks
        WHERE status IN ('ok', 'error') ORDER BY last_sync_at, feed LIMIT 1""")
    c.add("k7_recent_failures", "runs_failed l, tables_failed l", lambda s: m.recent_failures(s.runs, s.run_tables, dt.datetime(2024, 1, 1, 12)), """
        WITH recent AS (SELECT run_id, status FROM r_runs WHERE epoch_us(started_at) > epoch_us(TIMESTAMP '2024-01-01 12:00:00') - 86400000000),
        failed AS (SELECT 1 AS run, 0 AS feed FROM recent WHERE status = 'failed'
            UNION ALL SELECT 0, 1 FROM r_run_tables t SEMI JOIN recent USING (run_id) WHERE t.status = 'failed')
        SELECT COALESCE(SUM(run), 0) AS runs_failed, COALESCE(SUM(feed), 0) AS tables_failed FROM failed""")
    late = "TIMESTAMP '2024-01-31 20:00:00'"
    c.add("k8_freshness", "feed s, last_sync_at ts, is_stale b", lambda s: m.freshness(s.watermarks, dt.datetime(2024, 1, 31, 20), 24),
          f"SELECT feed, last_sync_at, epoch_us({late}) - epoch_us(last_sync_at) > 86400000000 AS is_stale FROM r_watermarks")
    c.add("k8_health_headline", "feeds l, any_stale b, stalest s, stalest_sync ts",
          lambda s: m.health(s.watermarks, dt.datetime(2024, 1, 31, 20), 24, ("view_0", "error_1", "signup_2")), f"""
        WITH h AS (SELECT *, feed NOT IN ('view_0', 'error_1', 'signup_2') AS shown, epoch_us({late}) - epoch_us(last_sync_at) > 86400000000 AS stale FROM r_watermarks)
        SELECT (SELECT COUNT(*) FROM h) AS feeds, (SELECT bool_or(stale) FROM h WHERE shown) AS any_stale, feed AS stalest, last_sync_at AS stalest_sync
        FROM h WHERE shown ORDER BY last_sync_at, feed LIMIT 1""")
    c.add("k22_readiness", "feeds l, any_stale b, stalest s, stalest_sync ts", lambda s: m.readiness(s.watermarks, dt.datetime(2024, 1, 31, 20)), f"""
        SELECT COUNT(*) AS feeds, bool_or(epoch_us({late}) - epoch_us(last_sync_at) > 129600000000) AS any_stale,
            arg_min(feed, (last_sync_at, feed)) AS stalest, MIN(last_sync_at) AS stalest_sync FROM r_watermarks""")
    c.add("k23_run_detail", "entry_id l, feed s, started_at ts, duration_ms l, status s, rows_synced l", lambda s: m.run_detail(s.run_tables, 42),
          "SELECT entry_id, feed, started_at, duration_ms, status, rows_synced FROM r_run_tables WHERE run_id = 42")
    c.add("k25_failed_share", "failed_share d", lambda s: review.failed_share(s.run_tables.select(F.when(F.col("status") == "failed", "x").alias("error"))),
          "SELECT AVG(CASE WHEN status = 'failed' THEN 1.0 ELSE 0.0 END) AS failed_share FROM r_run_tables")
    def synced(s):
        """A first success of a new feed, a later one of a known feed, a failure of another."""
        at = dt.datetime(2024, 3, 1, 5, tzinfo=dt.timezone.utc)
        held = s.watermarks.select("feed", F.col("last_sync_at").cast("timestamp").alias("last_sync_at"), "rows_synced", "status",
                                   F.lit(None).cast("string").alias("error_msg"), F.lit(None).cast("timestamp").alias("updated_at"))
        rows = control.set_watermark(held, "brand_new", at, 11, True)
        rows = control.set_watermark(rows, "click_2", at, 12, True)
        return control.set_watermark(rows, "view_0", at, 0, False, "lost connection")

    c.add("a17_set_watermark", "feed s, last_sync_at ts, rows_synced l, status s, error_msg s", synced, """
        WITH told(feed, moment, n, status, error) AS (VALUES ('brand_new', TIMESTAMP '2024-03-01 05:00:00', 11, 'ok', NULL),
            ('click_2', TIMESTAMP '2024-03-01 05:00:00', 12, 'ok', NULL), ('view_0', NULL, 0, 'error', 'lost connection'))
        SELECT feed, COALESCE(moment, last_sync_at) AS last_sync_at, CASE WHEN t.status IS NULL THEN rows_synced ELSE n END AS rows_synced,
            COALESCE(t.status, w.status) AS status, error AS error_msg
        FROM r_watermarks w FULL JOIN told t USING (feed)""")
    c.add("a17_reset_watermarks", "feed s, last_sync_at ts", lambda s: control.reset_watermarks(s.watermarks, ["click_2", "view_0", "not_there"]).select("feed", "last_sync_at"),
          "SELECT feed, last_sync_at FROM r_watermarks WHERE feed <> 'click_2' AND feed <> 'view_0'")
    c.add("a18_finished_runs", "run_id l, status s, tables_ok l, tables_failed l, total_tables l, total_rows l", lambda s: control.finish_runs(
        s.runs.withColumn("status", F.when(F.col("run_id") % 4 == 0, "running").otherwise(F.col("status"))),
        s.run_tables.where("run_id % 8 <> 0"), dt.datetime(2024, 3, 1)), """
        WITH counts AS (SELECT run_id, COUNT(*) FILTER (status = 'ok') AS fine, COUNT(*) FILTER (status <> 'ok') AS bad, SUM(rows_synced) AS n
            FROM r_run_tables WHERE run_id % 8 <> 0 GROUP BY 1),
        open AS (SELECT run_id, COALESCE(fine, 0) AS fine, CASE WHEN counts.run_id IS NULL THEN 1 ELSE bad END AS bad, COALESCE(n, 0) AS n
            FROM (SELECT run_id FROM r_runs WHERE run_id % 4 = 0) LEFT JOIN counts USING (run_id))
        SELECT run_id, CASE WHEN bad = 0 THEN 'success' WHEN fine = 0 THEN 'failed' ELSE 'partial' END AS status, fine AS tables_ok, bad AS tables_failed,
            fine + bad AS total_tables, n AS total_rows FROM open
        UNION ALL SELECT run_id, status, tables_ok, tables_failed, total_tables, total_rows FROM r_runs WHERE run_id % 4 <> 0""")
    c.add("a17_watermarks", "feed s, last_sync_at ts, rows_synced l, status s", lambda s: s.watermarks, "SELECT * FROM r_watermarks")


def _usage(c: Catalog) -> None:
    spans = (("today", "2024-01-30"), ("week", "2024-01-23"), ("month", "2023-12-31"))
    names = ("prompt_tokens", "completion_tokens", "total_tokens", "cost_usd")
    rows = " UNION ALL ".join(f"SELECT '{n}' AS period, " + ", ".join(f"COALESCE(SUM({x}), 0) AS {x}" for x in names) + f" FROM u WHERE created_at >= DATE '{d}'" for n, d in spans)
    c.add("k9_usage_by_period", "period s, prompt_tokens l, completion_tokens l, total_tokens l, cost_usd d", lambda s: m.usage_by_period(t.usage(s), TODAY),
          f"WITH {USAGE} {rows}")
    c.add("k10_usage_by_endpoint", "endpoint s, calls l, total_tokens l, cost_usd d", lambda s: m.usage_by_endpoint(t.usage(s)),
          f"WITH {USAGE} SELECT endpoint, COUNT(*) AS calls, SUM(total_tokens) AS total_tokens, SUM(cost_usd) AS cost_usd FROM u GROUP BY 1")
    c.add("k10_usage_by_provider", "provider s, calls l, total_tokens l, cost_usd d, prompt l, cache_write l, cache_read l, cache_hit_pct d",
          lambda s: m.usage_by_provider(t.usage(s)), f"""
        WITH {USAGE}, g AS (SELECT COALESCE(provider, 'openrouter') AS provider, COUNT(*) AS calls, SUM(total_tokens) AS total_tokens, SUM(cost_usd) AS cost_usd,
            SUM(prompt_tokens) AS prompt, SUM(cache_write_tokens) AS cache_write, SUM(cache_read_tokens) AS cache_read FROM u GROUP BY 1)
        SELECT *, CASE WHEN cache_read IS NOT NULL THEN CAST(cache_read AS DOUBLE) / CAST(prompt + COALESCE(cache_write, 0) + cache_read AS DOUBLE) * 100 END AS cache_hit_pct FROM g""")
    names = "(model, prompt_rate, completion_rate, write_rate, read_rate)"
    c.add("k11_call_cost", "id l, model s, call_cost d", lambda s: m.call_cost(
        t.usage(s), constants(s.spark, RATES, "model string, prompt_rate double, completion_rate double, write_rate double, read_rate double"), DEFAULT_RATE)
        .withColumn("call_cost", F.round("call_cost", 9)), f"""
        WITH {USAGE}, rates{names} AS (VALUES {', '.join(str(r) for r in RATES)})
        SELECT id, u.model, CASE WHEN COALESCE(provider, 'openrouter') = 'openrouter' THEN ROUND((CAST(prompt_tokens AS DOUBLE) * COALESCE(CAST(prompt_rate AS DOUBLE), 3.0)
            + CAST(completion_tokens AS DOUBLE) * COALESCE(CAST(completion_rate AS DOUBLE), 15.0) + COALESCE(CAST(cache_write_tokens AS DOUBLE), 0) * COALESCE(CAST(write_rate AS DOUBLE), 3.75)
            + COALESCE(CAST(cache_read_tokens AS DOUBLE), 0) * COALESCE(CAST(read_rate AS DOUBLE), 0.3)) / 1000000, 9) ELSE 0 END AS call_cost
        FROM u LEFT JOIN rates r ON r.model = u.model""")
    c.add("k12_daily_budget", "spent d, budget d, exceeded b", lambda s: m.daily_budget(t.usage(s), TODAY, 0.5),
          f"WITH {USAGE} SELECT SUM(cost_usd) AS spent, 0.5 AS budget, SUM(cost_usd) >= 0.5 AS exceeded FROM u WHERE provider = 'openrouter' AND created_at >= DATE '2024-01-30'")
    c.add("k13_tool_call_stats", "endpoint s, tool s, status s, calls l, avg_ms l, max_ms l, payload_in l, payload_out l", lambda s: m.tool_call_stats(t.tool_calls(s), EVENTS_NOW), f"""
        SELECT event_type AS endpoint, 'tool_' || (k % 3) AS tool, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END AS status, COUNT(*) AS calls,
            ROUND(CAST(SUM(CAST(floor(value * 10) AS BIGINT)) AS DOUBLE) / COUNT(*)) AS avg_ms, MAX(CAST(floor(value * 10) AS BIGINT)) AS max_ms,
            SUM(k * 10) AS payload_in, SUM(k * k) AS payload_out FROM r_events WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY 1, 2, 3""")
    c.add("k14_slow_queries", "query_id s, query s, calls l, mean_ms d, max_ms d, total_ms d, rows l, cache_hit_pct d", lambda s: m.slow_queries(t.query_log(s)), f"""
        WITH {LOG}, x AS (SELECT *, CAST(((2 * CAST(total_ms * 10000 AS HUGEINT) + calls) // (2 * calls)) AS DOUBLE) / 10000 AS mean_ms FROM log WHERE query LIKE '%ps\\_%' ESCAPE '\\')
        SELECT query_id, left(query, 500) AS query, calls, mean_ms, max_ms, total_ms, rows,
            ROUND(CAST(blocks_hit AS DOUBLE) / NULLIF(CAST(blocks_hit + blocks_read AS DOUBLE), 0) * 100, 1) AS cache_hit_pct FROM x ORDER BY mean_ms DESC, query_id LIMIT 20""")
    tok = TOKENS.format("query", r"\bps_[a-z_]+")
    c.add("k15_query_origins", "query_id s, best_source_id l, similarity d", lambda s: m.query_origins(t.query_log(s), t.query_sources(s)), f"""
        WITH {LOG}, a AS (SELECT query_id, {tok} AS ta FROM log), src AS (SELECT CAST(split_part(query_id, '-', 2) AS INTEGER) % 20 AS source_id, MIN(query) AS query FROM log
            WHERE query LIKE '%ps\\_%' ESCAPE '\\' GROUP BY 1), b AS (SELECT source_id, {tok} AS tb FROM src),
        p AS (SELECT query_id, source_id, len(list_intersect(ta, tb)) AS c, len(ta) + len(tb) AS n FROM a, b WHERE len(ta) > 0),
        j AS (SELECT *, CAST(c AS DOUBLE) / (n - c) AS similarity FROM p WHERE CAST(c AS DOUBLE) / (n - c) >= 0.5)
        SELECT query_id, source_id AS best_source_id, similarity FROM j QUALIFY ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, source_id) = 1""")
    c.add("k21_table_tokens", "query_id s, tables s", lambda s: t.query_log(s).select("query_id", F.array_join(R.fingerprint("query"), ",").alias("tables")),
          f"WITH {LOG} SELECT query_id, array_to_string({tok}, ',') AS tables FROM log")
    c.add("k24_interactions", "id l, endpoint s, status s, dashboard s, started_at ts", lambda s: m.interactions(t.interactions(s), endpoint="click", status="ok"), """
        SELECT event_id AS id, event_type AS endpoint, CASE WHEN k % 10 = 0 THEN 'error' ELSE 'ok' END AS status, CAST(user_id % 20 AS VARCHAR) AS dashboard, ts AS started_at
        FROM r_events WHERE event_type = 'click' AND k % 10 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 50""")
    c.add("j5_trace_sampling", "trace_id s, has_error b, spans l, elapsed_ms d, keep b", lambda s: m.sample_traces(t.spans(s)), """
        WITH sp AS (SELECT user_id || '-' || strftime(time_bucket(INTERVAL 10 MINUTE, ts), '%Y%m%d%H%M') AS trace_id, ts, CAST(floor(value * 20) AS BIGINT) AS duration_ms, k % 25 = 0 AS is_error FROM r_events),
        f AS (SELECT trace_id, MIN(ts) AS first_ts FROM sp GROUP BY 1),
        g AS (SELECT sp.trace_id, bool_or(is_error) AS has_error, COUNT(*) AS spans, (MAX(epoch_us(ts) + duration_ms * 1000) - MIN(epoch_us(ts))) / 1000 AS elapsed_ms
            FROM sp JOIN f ON f.trace_id = sp.trace_id AND ts <= first_ts + INTERVAL 10 SECOND GROUP BY 1)
        SELECT *, has_error OR elapsed_ms > 5000 OR CAST('0x' || left(md5(trace_id), 8) AS BIGINT) % 100 < 10 AS keep FROM g""")
    c.add("j6_replay_after", "event_id l, turn_id l, event_type s", lambda s: m.replay_after(t.turn_events(s), t.turns(s), 3, 5000), """
        SELECT event_id, user_id AS turn_id, CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'thinking' ELSE event_type END AS event_type
        FROM events WHERE user_id % 10 = 3 AND event_id > 5000""")
    c.add("j6_prune_transient", "event_id l, turn_id l, event_type s", lambda s: m.prune_transient(t.turn_events(s), t.turns(s).where("is_finished")), """
        SELECT event_id, user_id AS turn_id, CASE event_type WHEN 'view' THEN 'token' WHEN 'click' THEN 'thinking' ELSE event_type END AS event_type
        FROM events WHERE NOT (user_id % 2 = 0 AND event_type IN ('view', 'click'))""")


def _chats(c: Catalog) -> None:
    listing = f"""WITH {CHATS} SELECT conv_id AS conversation_id, CASE WHEN conv_id % 3 = 0 THEN MAX(turn) > 3 ELSE MAX(turn) > 0 END AS is_unread, COUNT(*) AS messages,
        SUM(calls) AS tool_calls, COUNT(*) FILTER (WHERE calls > 0) AS rounds, MAX(turn) * 60 AS duration_s, left(arg_max(text, turn), 120) AS preview, SUM(tokens) AS tokens,
        MAX(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(conv_id * 60 + turn AS BIGINT))) AS last_interaction_at, arg_min(text, turn) AS first_prompt FROM msg GROUP BY conv_id"""
    cols = "conversation_id l, is_unread b, messages l, tool_calls l, rounds l, duration_s l, preview s, tokens l, last_interaction_at ts"
    c.add("k16_conversation_list", cols, lambda s: m.conversation_list(t.conversations(s), t.messages(s)), listing)
    c.add("g5_conversation_page", cols, lambda s: m.conversation_list(t.conversations(s), t.messages(s), k=20, offset=40),
          f"SELECT * FROM ({listing}) ORDER BY last_interaction_at DESC, conversation_id LIMIT 20 OFFSET 40")
    c.add("b21_conversation_search", cols, lambda s: m.conversation_list(t.conversations(s), t.messages(s), search="THE"),
          f"SELECT * FROM ({listing}) WHERE contains(lower(first_prompt), 'the') OR contains(lower('Conversation ' || conversation_id), 'the')")
    c.add("k17_latest_reviews", "week_start date, review_id l, revision l, revisions l, summary s", lambda s: m.latest_reviews(t.reviews(s)), """
        SELECT CAST(date_trunc('week', ts) AS DATE) AS week_start, MAX(event_id) AS review_id, MAX(event_id) AS revision, COUNT(*) AS revisions,
            'summary ' || arg_max(k, event_id) AS summary FROM r_events WHERE event_type = 'purchase' GROUP BY 1""")
    c.add("f5_document_versions", "version_id l, document_id l, version l", lambda s: m.document_versions(s.raw("events").select(
        F.col("user_id").alias("document_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("version_id"))), """
        SELECT event_id AS version_id, user_id AS document_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version FROM events""")
    c.add("h2_revision_diff", "text s, change s", lambda s: m.revision_diff(*[
        s.raw("conversations").where(F.col("turn") % 2 == n).select("text") for n in (0, 1)]), """
        WITH b AS (SELECT text FROM conversations WHERE turn % 2 = 0), a AS (SELECT text FROM conversations WHERE turn % 2 = 1)
        SELECT text, 'added' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT text, 'removed' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")


# a text for each redaction rule, made from a document's digest, and what must be left of it
SECRET_TEXTS = [
    ("Authorization: Basic # end", "Authorization: Basic [redacted] end"), ("say Bearer # end", "say Bearer [redacted] end"),
    ("Authorization: # end", "Authorization: [redacted] end"), ("key sk-ant-# end", "key [redacted] end"), ("key sk-# end", "key [redacted] end"),
    ("jwt eyJ#.#.# end", "jwt [redacted] end"), ("at postgresql://u:#@host/db end", "at postgres://[redacted] end"),
    ("at https://u:#@host end", "at https:[redacted]@host end"), ("password = # end", "password=[redacted] end"),
    ('{"accessToken": "#"} end', '{"accessToken": "[redacted]"} end')]


def _text(c: Catalog) -> None:
    def with_secret():
        made = F.element_at(F.array(*[F.lit(t) for t, _ in SECRET_TEXTS]), (F.col("doc_id") % 10 + 1).cast("int"))
        return F.concat_ws(" ", F.lit("doc"), F.replace(made, F.lit("#"), F.md5("text")))

    c.add("k18_every_secret_rule", "doc_id l, clean s", lambda s: s.raw("documents").select("doc_id", R.redact(with_secret()).alias("clean")),
          "SELECT doc_id, 'doc ' || CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{want}'" for i, (_, want) in enumerate(SECRET_TEXTS)) + " END AS clean FROM documents")

    def chain(column: str) -> str:
        # the same rules without look-ahead, which DuckDB lacks; no document holds a redacted text already
        rules = [(r"(?i)\bBearer\s+[A-Za-z0-9._\-+/=]{8,}", "Bearer [redacted]"), (r"\bsk-[A-Za-z0-9_\-]{16,}", "[redacted]"),
                 (r"\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[redacted]"), (r"(?i)postgres(?:ql)?://[^\s''\"<>]*", "postgres://[redacted]"),
                 (r":[^@\s''\"]+@", ":[redacted]@"), (r"(?i)password\s*=\s*[^\s&''\"]+", "password=[redacted]"),
                 (r'(token\s*=\s*)"[0-9a-f]{40}"', '\\1"[redacted]"'), (r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]{2,}", "[email]")]
        for pattern, new in rules:
            column = f"regexp_replace({column}, '{pattern}', '{new}', 'g')"
        return column

    c.add("k18_redacted_documents", "doc_id l, changed b, n_chars l, digest s", lambda s: s.raw("documents").select(
        "doc_id", "text", R.redact("text", SECRET_RULE).alias("clean")).select(
        "doc_id", (F.col("clean") != F.col("text")).alias("changed"), F.length("clean").alias("n_chars"), F.md5("clean").alias("digest")), f"""
        SELECT doc_id, clean <> text AS changed, length(clean) AS n_chars, md5(clean) AS digest FROM (SELECT doc_id, text, {chain('text')} AS clean FROM documents)""")
    c.add("k19_redacted_tail", "doc_id l, tail s", lambda s: s.raw("documents").select("doc_id", R.redact_tail("text", 80, extra_rules=SECRET_RULE).alias("tail")),
          f"SELECT doc_id, right({chain('text')}, 80) AS tail FROM documents")
    c.add("k20_attribute_denylist", "event_id l, kept s", lambda s: t._events(s).select("event_id", F.create_map(
        F.lit("db.user"), F.col("event_type"), F.lit("http.route"), F.concat(F.lit("/"), F.col("event_type")), F.lit("k"), F.col("k").cast("string")).alias("attrs"))
        .select("event_id", F.to_json(R.drop_denied("attrs")).alias("kept")),
          """SELECT event_id, '{"http.route":"/' || event_type || '","k":"' || k || '"}' AS kept FROM r_events""")
    words, bench = TOKENS.format("text", WORDS), TOKENS.format("text", WORDS)
    c.add("c18_best_match", "doc_id l, best_item_id l, similarity d", lambda s: best_match(
        s.raw("documents").select("doc_id", R.fingerprint("text", WORDS).alias("tokens")), "doc_id",
        s.raw("benchmark").select("item_id", R.fingerprint("text", WORDS).alias("tokens")), "item_id", threshold=0.3), f"""
        WITH a AS (SELECT doc_id, {words} AS ta FROM documents), b AS (SELECT item_id, {bench} AS tb FROM benchmark),
        p AS (SELECT doc_id, item_id, len(list_intersect(ta, tb)) AS c, len(ta) + len(tb) AS n FROM a, b WHERE len(ta) > 0 AND len(tb) > 0),
        j AS (SELECT *, CAST(c AS DOUBLE) / (n - c) AS similarity FROM p WHERE CAST(c AS DOUBLE) / (n - c) >= 0.3)
        SELECT doc_id, item_id AS best_item_id, similarity FROM j QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY similarity DESC, item_id) = 1""")
    c.add("i_duration_and_age_text", "run_id l, duration s, age s, rows s, speed s", lambda s: s.runs.select(
        "run_id", L.duration_text("duration_ms").alias("duration"), L.age_text(F.floor(F.col("duration_ms") / 1000)).alias("age"),
        L.es_number(F.col("total_rows") * 1000).alias("rows"), L.throughput_text(F.col("total_rows") * 100).alias("speed")), """
        WITH x AS (SELECT run_id, duration_ms, total_rows, duration_ms // 1000 AS s FROM r_runs)
        SELECT run_id, CASE WHEN duration_ms < 1000 THEN duration_ms || 'ms' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm'
            WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS duration,
            CASE WHEN s < 60 THEN '< 1m' WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 60) || 'm' END AS age,
            replace(format('{:,}', CAST(total_rows * 1000 AS BIGINT)), ',', '.') AS rows,
            CASE WHEN total_rows * 100 >= 1000 THEN replace(format('{:,}', CAST(total_rows * 100 AS BIGINT)), ',', '.') || ' /s' ELSE format('{:.1f}', CAST(total_rows * 100 AS DOUBLE)) || ' /s' END AS speed FROM x""")
    c.add("i_es_number_formats", "store s, currency s, percent s, delta s", lambda s: s.stock.groupBy("store").agg(F.sum("qty").cast("decimal(20,2)").alias("q")).select(
        "store", L.es_currency("q").alias("currency"), L.es_percent(F.col("q") / 8).alias("percent"), L.signed_percent(F.col("q") / 1000).alias("delta")), """
        WITH x AS (SELECT store, CAST(SUM(qty) AS BIGINT) AS q FROM r_stock GROUP BY 1)
        SELECT store, '€' || translate(format('{:,.2f}', CAST(q AS DOUBLE)), ',.', '.,') AS currency, translate(format('{:,.1f}', CAST((q * 10 * 2 + 8) // 16 AS DOUBLE) / 10), ',.', '.,') || '%' AS percent,
            CASE WHEN q > 0 THEN '+' ELSE '' END || translate(format('{:,.1f}', CAST(q AS DOUBLE) / 10), ',.', '.,') || '%' AS delta FROM x""")
    c.add("i_slug_and_title", "item_id l, slug s, title s", lambda s: s.items.select("item_id", L.slug(F.concat_ws("  ", "ref", F.lit("Él"), "description")).alias("slug"),
                                                                                   L.title_case(F.concat(F.lit("DE LA "), "department", F.lit(" Y "), "color")).alias("title")), """
        SELECT item_id, left(regexp_replace(regexp_replace(lower(concat_ws('  ', ref, 'el', description)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 48) AS slug,
            'De la ' || upper(left(department, 1)) || substring(department, 2) || ' y ' || upper(left(color, 1)) || substring(color, 2) AS title FROM r_items""")
