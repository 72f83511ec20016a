"""Feeds: their run in order, checks of their rows and declared columns, and stepping through periods."""

import datetime as dt

from pyspark.sql import Observation
from pyspark.sql import functions as F

from lonja.catalog.params import AS_OF
from lonja.catalog.registry import Catalog
from lonja.functions import periods as T
from lonja.model import SPECS
from lonja.operators import checks, control
from lonja.session import scratch_dir

MARK = dt.datetime(2001, 6, 1, 8, 30, tzinfo=dt.timezone.utc)
KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "customer": ["c_custkey"], "events": ["user_id", "event_type"],
        "part": ["p_brand", "p_type"], "conversations": ["conv_id", "turn"]}
# source column -> table column: one that fits, one whose texts are no ids, one the source lacks, one the table lacks
ORDER_MAP = {"o_orderkey": "ticket_id", "o_totalprice": "net", "O_ORDERDATE": "sale_date", "o_orderpriority": "customer_id", "o_clerk": "hour", "o_orderstatus": "colour"}
DESCRIBED = {"orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
             "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
             "pages": "page_id bigint, url string, html string"}


def feed_run(s, kind: str):
    """Run five feeds, given in no order and one of them broken; the ledger rows with their place in the run."""
    folder = scratch_dir(s.spark, "feeds")

    def load(name: str, day: str | None = None):
        def to_table(since: dt.datetime | None) -> int:
            df, counted = s.raw(name), Observation()
            if since is not None:
                df = df.where(F.col(day) >= F.lit(since.date()))
            # the count rides on the write
            df.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{folder}/{name}")
            return counted.get["rows"]
        return to_table

    def broken(since):
        raise LookupError("no such table")

    feeds = [control.Feed("stock", "stock", broken), control.Feed("events", "cascade", load("events", "ts"), True),
             control.Feed("orders", "sales", load("orders", "o_orderdate"), True), control.Feed("customer", "masters", load("customer")),
             control.Feed("lineitem", "wholesale", load("lineitem", "l_shipdate"), True), control.Feed("nation", "dimensions", load("nation"))]
    results = control.run_feeds(feeds, kind, {"orders": MARK, "lineitem": MARK}.get, lambda: dt.datetime.now(dt.timezone.utc))
    ledger = control.ledger_rows(s.spark, 1, results)
    places = s.spark.createDataFrame([(i, r.feed) for i, r in enumerate(results, 1)], "place int, feed string")
    return ledger.join(F.broadcast(places), "feed")


def ranges(s):
    """One range per order, of a kind that its key decides: calendar units in full, in progress, and others."""
    day, kind = F.col("o_orderdate").cast("date"), F.pmod("o_orderkey", F.lit(10))
    starts = {1: "week", 2: "month", 3: "quarter", 4: "year"}
    lo = F.when(kind == 0, day)
    hi = F.when(kind == 0, day)
    for k, unit in starts.items():
        first = F.trunc(day, unit)
        last = F.date_add(first, 6) if unit == "week" else F.date_sub(F.add_months(first, {"month": 1, "quarter": 3, "year": 12}[unit]), 1)
        lo, hi = lo.when(kind == k, first).when(kind == k + 4, F.trunc(F.lit(AS_OF), unit)), hi.when(kind == k, last).when(kind == k + 4, F.lit(AS_OF))
    lo, hi = lo.otherwise(day), hi.otherwise(F.date_add(day, 9))
    return s.raw("orders").select(lo.alias("lo"), hi.alias("hi")).groupBy("lo", "hi").agg(F.count(F.lit(1)).alias("orders"))


def stepped(s):
    back, on = (T.step_range("lo", "hi", d, AS_OF) for d in (-1, 1))
    return ranges(s).select("lo", "hi", "orders", T.period_of("lo", "hi", AS_OF).alias("period"), back["lo"].alias("back_lo"), back["hi"].alias("back_hi"),
                            on["lo"].alias("on_lo"), on["hi"].alias("on_hi"))


def register(c: Catalog) -> None:
    for kind, watermarked in (("full", "full_upsert"), ("delta", "upsert")):
        since = {"orders": " WHERE o_orderdate >= DATE '2001-05-31'", "lineitem": " WHERE l_shipdate >= DATE '2001-05-31'"} if kind == "delta" else {}
        names = ["nation", "customer", "orders", "lineitem", "stock", "events"] if kind == "full" else ["orders", "lineitem", "events"]
        parts = [f"SELECT {i} AS place, '{n}' AS feed, " + ("'full_refresh' AS method, 'failed' AS status, 0 AS rows_synced" if n == "stock" else
                 f"'{'full_refresh' if n in ('nation', 'customer') else 'full_upsert' if n == 'events' else watermarked}' AS method, 'ok' AS status, COUNT(*) AS rows_synced FROM {n}{since.get(n, '')}")
                 for i, n in enumerate(names, 1)]
        c.add(f"a20_{kind}_run", "place l, feed s, method s, status s, rows_synced l", lambda s, kind=kind: feed_run(s, kind), " UNION ALL ".join(parts))
    c.add("a21_key_report", "name s, rows l, absent l, repeated l", lambda s: checks.key_report({n: (s.raw(n), k) for n, k in KEYS.items()}).withColumnRenamed("table", "name"),
          " UNION ALL ".join(f"SELECT '{n}' AS name, COUNT(*) AS rows, 0 AS absent, COUNT(*) - COUNT(DISTINCT ({', '.join(k)})) AS repeated FROM {n}" for n, k in KEYS.items()))
    c.add("a22_conversion_report", "source s, target s, in_source b, in_table b, n_values l, lost l",
          lambda s: checks.conversion_report(s.raw("orders"), ORDER_MAP, SPECS["tickets"]).withColumnRenamed("values", "n_values"), """
        SELECT source, target, source <> 'o_clerk' AS in_source, target <> 'colour' AS in_table, CASE WHEN source <> 'o_clerk' THEN n ELSE 0 END AS n_values,
            CASE WHEN target = 'customer_id' THEN n ELSE 0 END AS lost
        FROM (VALUES ('o_orderkey', 'ticket_id'), ('o_totalprice', 'net'), ('O_ORDERDATE', 'sale_date'), ('o_orderpriority', 'customer_id'), ('o_clerk', 'hour'),
            ('o_orderstatus', 'colour')) m(source, target), (SELECT COUNT(*) AS n FROM orders)""")
    fields = [(n, i, *f.split()) for n, text in DESCRIBED.items() if n.startswith("pa") for i, f in enumerate(text.split(", "))]
    c.add("a25_described_feeds", "name s, position l, field s, type s, rows l, filled l",
          lambda s: checks.describe_feeds({n: s.raw(n) for n in ("orders", "part", "pages")}, "pa").withColumnsRenamed({"table": "name", "column": "field"}), " UNION ALL ".join(
              f"SELECT '{n}' AS name, {i} AS position, '{column}' AS field, '{kind}' AS type, COUNT(*) AS rows, COUNT({column}) AS filled FROM {n}" for n, i, column, kind in fields))
    c.add("b9_stepped_ranges", "lo date, hi date, orders l, period s, back_lo date, back_hi date, on_lo date, on_hi date", stepped, """
        WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey % 10 AS k FROM orders),
        u AS (SELECT day, k, CASE (k - 1) % 4 WHEN 0 THEN 'week' WHEN 1 THEN 'month' WHEN 2 THEN 'quarter' WHEN 3 THEN 'year' END AS unit,
            CASE WHEN k BETWEEN 5 AND 8 THEN DATE '2001-06-15' ELSE day END AS base FROM d),
        r AS (SELECT CAST(CASE WHEN k IN (0, 9) THEN day ELSE date_trunc(unit, base) END AS DATE) AS lo, CAST(CASE WHEN k = 0 THEN day WHEN k = 9 THEN day + 9
            WHEN k >= 5 THEN base ELSE date_trunc(unit, base) + CASE unit WHEN 'week' THEN INTERVAL 7 DAY WHEN 'month' THEN INTERVAL 1 MONTH WHEN 'quarter' THEN INTERVAL 3 MONTH
                ELSE INTERVAL 1 YEAR END - INTERVAL 1 DAY END AS DATE) AS hi FROM u),
        g AS (SELECT lo, hi, COUNT(*) AS orders FROM r GROUP BY ALL),
        units(place, unit, width) AS (VALUES (1, 'day', INTERVAL 1 DAY), (2, 'week', INTERVAL 7 DAY), (3, 'month', INTERVAL 1 MONTH), (4, 'quarter', INTERVAL 3 MONTH), (5, 'year', INTERVAL 1 YEAR)),
        named AS (SELECT lo, hi, orders, arg_min(unit, place) AS period, arg_min(width, place) AS width FROM g LEFT JOIN units
            ON lo = date_trunc(unit, lo) AND hi = CASE WHEN lo = date_trunc(unit, DATE '2001-06-15') AND hi = DATE '2001-06-15' THEN hi ELSE lo + width - INTERVAL 1 DAY END GROUP BY ALL),
        moved AS (SELECT *, CAST(lo - width AS DATE) AS b, CAST(lo + width AS DATE) AS o FROM named)
        SELECT lo, hi, orders, period, COALESCE(b, lo) AS back_lo, COALESCE(CASE WHEN DATE '2001-06-15' BETWEEN b AND b + width THEN LEAST(b + width - INTERVAL 1 DAY, DATE '2001-06-15') ELSE b + width - INTERVAL 1 DAY END, hi) AS back_hi,
            COALESCE(o, lo) AS on_lo, COALESCE(CASE WHEN DATE '2001-06-15' BETWEEN o AND o + width THEN LEAST(o + width - INTERVAL 1 DAY, DATE '2001-06-15') ELSE o + width - INTERVAL 1 DAY END, hi) AS on_hi FROM moved""")
