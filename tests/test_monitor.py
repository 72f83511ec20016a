import datetime as dt

from pyspark.sql import functions as F

from lonja.plans import monitor

T0 = dt.datetime(2024, 5, 1, 8, 0)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def chats(spark):
    conversations = spark.createDataFrame([
        (1, "ask", "Sales 100%", "how much", at(0), at(9), None), (2, "build", "x", "Sales by store", at(0), at(30), at(30)),
        (3, "ask", "empty", "hi", at(0), at(0), None), (4, "ask", "read before", "hi", at(0), at(50), at(40))],
        "conversation_id int, mode string, title string, first_prompt string, created_at timestamp, last_interaction_at timestamp, last_read_at timestamp")
    messages = spark.createDataFrame([
        (1, "a", "user", '{"text": "how much"}', 3, None, at(1)), (1, "b", "assistant", '{"text": "wait", "tool_calls": [1, 2]}', 4, 5, at(2)),
        (1, "c", "assistant", '"plain answer"', None, 7, at(9)), (2, "d", "assistant", '{"tool_calls": []}', 1, 1, at(3)),
        (2, "e", "user", '{"tool_calls": [1]}', 1, 1, at(30)), (4, "f", "user", "not json " + "z" * 200, 1, 1, at(50))],
        "conversation_id int, message_id string, role string, content string, tokens_in int, tokens_out int, created_at timestamp")
    return conversations, messages


def test_conversation_statistics(spark):
    got = {r["conversation_id"]: r for r in monitor.conversation_list(*chats(spark)).collect()}
    first = got[1]
    assert (first["messages"], first["tool_calls"], first["rounds"], first["tokens"]) == (3, 2, 1, 19)
    assert (first["preview"], first["duration_s"], first["is_unread"]) == ("plain answer", 540, True)
    assert (got[2]["tool_calls"], got[2]["rounds"], got[2]["is_unread"], got[2]["preview"]) == (0, 0, False, '{"tool_calls": [1]}')
    assert (got[3]["messages"], got[3]["preview"], got[3]["is_unread"], got[3]["tokens"]) == (0, None, False, 0)
    assert got[4]["is_unread"] and len(got[4]["preview"]) == 120


def test_conversation_filters_and_pages(spark):
    ids = lambda **o: [r["conversation_id"] for r in monitor.conversation_list(*chats(spark), **o).collect()]
    assert ids() == [4, 2, 1, 3]
    assert ids(search=" sales ") == [2, 1] and ids(search="0%") == [1] and ids(search="  ") == [4, 2, 1, 3]
    assert ids(modes=["ask"]) == [4, 1, 3] and ids(since=at(9)) == [4, 2, 1]
    assert ids(k=2, offset=1) == [2, 1]


def test_health_falls_back_when_all_feeds_are_excluded(spark):
    marks = spark.createDataFrame([("compras", at(0)), ("tiendas", at(5))], "feed string, last_sync_at timestamp")
    got = monitor.health(marks, at(60 * 40)).first()
    assert (got["feeds"], got["any_stale"], got["stalest"]) == (2, False, "compras")
    assert monitor.readiness(marks, at(60 * 40)).first()["any_stale"]
    assert monitor.health(marks.where("feed = 'none'"), at(1)).first()["feeds"] == 0


def test_stale_is_strict(spark):
    marks = spark.createDataFrame([("ventas", at(0))], "feed string, last_sync_at timestamp")
    assert not monitor.freshness(marks, at(36 * 60)).first()["is_stale"]
    assert monitor.freshness(marks, at(36 * 60) + dt.timedelta(seconds=1)).first()["is_stale"]


def test_review_summaries(spark, rows):
    data = [(dt.date(2024, 4, 29), 1, 1, '{"executive_summary": "old"}'), (dt.date(2024, 4, 29), 2, 2, '{"executive_summary": ["first", "second"]}'),
            (dt.date(2024, 4, 22), 3, 1, '{"executive_summary": "' + "t" * 300 + '"}'), (dt.date(2024, 4, 15), 4, 1, '{"executive_summary": []}'),
            (dt.date(2024, 4, 8), 5, 1, "{}")]
    reviews = spark.createDataFrame(data, "week_start date, review_id int, revision int, content string")
    got = {r["review_id"]: (r["revisions"], r["summary"]) for r in monitor.latest_reviews(reviews).collect()}
    assert got == {2: (2, "first"), 3: (1, "t" * 220), 4: (1, ""), 5: (1, "")}


def test_unknown_model_and_foreign_provider(spark):
    usage = spark.createDataFrame([("a", "openrouter", 1_000_000, 0, None, None), ("zzz", None, 0, 1_000_000, 1_000_000, 0), ("a", "cli", 5, 5, 5, 5)],
                                  "model string, provider string, prompt_tokens long, completion_tokens long, cache_write_tokens long, cache_read_tokens long")
    rates = spark.createDataFrame([("a", 1.0, 2.0, 3.0, 4.0)], "model string, prompt_rate double, completion_rate double, write_rate double, read_rate double")
    got = sorted(r["call_cost"] for r in monitor.call_cost(usage, rates, (10.0, 20.0, 30.0, 40.0)).collect())
    assert got == [0.0, 1.0, 50.0]


def test_pruning_keeps_durable_and_running(spark, rows):
    events = spark.createDataFrame([(1, 10, "token"), (2, 10, "log"), (3, 11, "thinking"), (4, None, "token")], "event_id int, turn_id int, event_type string")
    done = spark.createDataFrame([(10,), (10,)], "turn_id int")
    assert rows(monitor.prune_transient(events, done).select("event_id")) == [(2,), (3,), (4,)]


def test_revision_diff_ignores_copies(spark, rows):
    a, b = (spark.createDataFrame([(x,) for x in xs], "t string") for xs in (["x", "x", "y"], ["x", "z", "z"]))
    assert rows(monitor.revision_diff(a, b)) == [("y", "removed"), ("z", "added")]


def test_daily_budget(spark):
    usage = spark.createDataFrame([(at(1), 2.0, "openrouter"), (at(2), 7.0, "cli"), (at(3), 7.0, None), (at(-600), 9.0, "openrouter")],
                                  "created_at timestamp, cost_usd double, provider string")
    got = monitor.daily_budget(usage, T0.date(), 2.0).first()
    assert (got["spent"], got["exceeded"]) == (2.0, True)
    assert not monitor.daily_budget(usage.where(F.lit(False)), T0.date(), 2.0).first()["exceeded"]
