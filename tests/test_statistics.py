import random
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lonja.functions import stats
from lonja.operators import ranking, similarity
from lonja.operators.similarity import best_match

QUIET = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def flags(spark, values):
    """values[0] is the current period, the rest its history."""
    df = spark.createDataFrame([(-i, float(v) if v is not None else None) for i, v in enumerate(values)], "t int, v double")
    r = stats.anomaly(df, "v", "t").first()
    return r["is_anomaly"], r["direction"]


def test_anomaly_examples(spark):
    assert flags(spark, [50, 100, 98, 102, 99, 101]) == (True, "low")
    assert flags(spark, [150, 100, 98, 102, 99, 101]) == (True, "high")
    assert flags(spark, [100, 98, 102, 99, 101, 100]) == (False, "normal")
    assert flags(spark, [100, 98, 102, 99]) == (False, None)             # too short
    assert flags(spark, [70, 100, 100, 100, 100]) == (False, "normal")   # constant history
    assert flags(spark, [None, 100, 98, 102, 99, 101]) == (False, None)  # no current value
    assert flags(spark, [50, 100, None, 98, 102, 99, 101]) == (True, "low")


def test_anomaly_drops_text_history(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["99", "n/a", "101", "98", "102", "100", "50"])], "t int, v string")
    r = stats.anomaly(df, "v", "t").first()
    assert (r["n"], r["is_anomaly"], r["direction"]) == (5, True, "low")


def test_streak(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("a", 3, True), ("a", 4, False), ("b", 1, True), ("c", 1, False)],
                               "k string, p int, broken boolean")
    got = dict(df.groupBy("k").agg(stats.leading_streak(F.col("p"), F.col("broken"))).collect())
    assert got == {"a": 2, "b": 0, "c": 1}


def test_numbering_a_hot_group(spark):
    """One group holds most rows: the numbers equal a plain count, and no window covers the whole group."""
    df = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
                                  (F.col("id") * 7919 % 4001).alias("at"), "id")
    out = ranking.numbered(df, ["k"], [F.asc("at"), F.asc("id")], partitions=7)
    got = sorted((r["k"], r["at"], r["id"], r["n"]) for r in out.collect())
    want, seen = [], {}
    for k, at, i in sorted((r["k"], r["at"], r["id"]) for r in df.collect()):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, at, i, seen[k]))
    assert got == want


def test_numbering_rows_of_one_moment_and_none(spark):
    """All rows share one time or have none: their ranges are cut within it, and no range holds most rows."""
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("k"), F.when(F.col("id") % 4 > 0, F.lit(7)).alias("at"), "id")
    out = ranking.numbered(df, ["k"], [F.asc_nulls_first("at"), F.asc("id")], partitions=6)
    rows = sorted(((r["k"] or "", r["at"] or 0, r["id"]) for r in df.collect()))
    want, seen = {}, {}
    for k, _, i in rows:
        seen[k] = seen.get(k, 0) + 1
        want[i] = seen[k]
    assert {r["id"]: r["n"] for r in out.collect()} == want
    stored = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()})
    assert max(r["count"] for r in stored.groupBy("_part").count().collect()) < 2500
    whole = ranking.numbered(df, [], [F.desc("id")], partitions=3)
    assert {r["id"]: r["n"] for r in whole.collect()} == {i: 5000 - i for i in range(5000)}
    assert ranking.numbered(df.limit(0), ["k"], [F.asc("id")]).collect() == []


def test_top_share_of_nothing_and_over_a_wide_range(spark):
    df = spark.createDataFrame([(x,) for x in [-(10**15), 0, 7, 7, 7, 10**15, 3 * 10**15]], "c long").select((F.col("c").cast("decimal(20,0)") / 100).cast("decimal(20,2)").alias("v"))
    r = ranking.top_share(df, "v", 3).first()
    assert (r["members"], r["top_members"], r["top_total"]) == (7, 3, Decimal(4 * 10**15 + 7) / 100)
    none = ranking.top_share(df.limit(0), "v").first()
    assert (none["members"], none["top_members"], none["top_total"], none["total"]) == (0, 0, None, None)


@QUIET
@given(st.lists(st.integers(-500, 200_000), min_size=1, max_size=60))
def test_top_share_is_exact(spark, cents):
    df = spark.createDataFrame([(c,) for c in cents], "c int").select((F.col("c").cast("decimal(12,2)") / 100).cast("decimal(20,2)").alias("v"))
    r = ranking.top_share(df, "v").first()
    k = -(-len(cents) // 10)
    assert (r["members"], r["top_members"]) == (len(cents), k)
    assert round(float(r["top_total"]) * 100) == sum(sorted(cents, reverse=True)[:k])
    assert round(float(r["total"]) * 100) == sum(cents)


def test_top_share_of_equal_values(spark):
    df = spark.range(1000).select(F.lit("5.00").cast("decimal(10,2)").alias("v"))
    r = ranking.top_share(df, "v").first()
    assert float(r["top_total"]) == 500.0


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def check_best(spark, left, right, threshold):
    a = spark.createDataFrame(left, "id int, tokens array<string>")
    b = spark.createDataFrame(right, "cid int, tokens array<string>")
    got = {r["id"]: (r["best_cid"], round(r["similarity"], 9)) for r in best_match(a, "id", b, "cid", threshold=threshold).collect()}
    want = {}
    for i, ta in left:
        hits = [(-jaccard(ta, tb), c) for c, tb in right if ta and tb and jaccard(ta, tb) >= threshold]
        if hits:
            s, c = min(hits)
            want[i] = (c, round(-s, 9))
    assert got == want


def test_best_match_against_brute_force(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(25)] + ["the"]
    text = lambda: rng.sample(words, rng.randint(0, 9)) + ["the"] * rng.randint(0, 1)
    left = [(i, text()) for i in range(60)] + [(1000 + i, ["the", "w1", "w2"]) for i in range(60)]   # a third are copies
    right = [(i, text()) for i in range(30)] + [(90, ["the"]), (91, ["w2", "w1", "the"]), (92, ["the", "w1", "w2"])]
    for threshold in (0.3, 0.5, 0.8, 1.0):
        check_best(spark, left, right, threshold)


def test_share_and_heat(spark, rows):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "k string, v double")
    assert rows(ranking.share_of_total(df, ["k"], "v", "pct")) == [("a", 3.0, 75.0), ("b", 1.0, 25.0)]
    heat = ranking.normalise_to_max(spark.createDataFrame([("a", "4"), ("b", "x"), ("c", "-1")], "k string, v string"), ["k"], ["v"])
    assert rows(heat.select("k", "v_heat")) == [("a", 1.0), ("b", None), ("c", -0.25)]
    assert rows(ranking.share_of_total(df.where("k = 'z'"), ["k"], "v", "pct")) == []


def test_mixed_order_both_ways(spark):
    df = spark.createDataFrame([("10",), ("9",), ("b",), ("A",), (" ",), (None,)], "c string")
    up = [r[0] for r in df.orderBy(*ranking.mixed_order("c")).collect()]
    down = [r[0] for r in df.orderBy(*ranking.mixed_order("c", descending=True)).collect()]
    assert up[:4] == ["9", "10", "A", "b"] and set(up[4:]) == {" ", None}
    assert down[:4] == ["10", "9", "b", "A"] and set(down[4:]) == {" ", None}


def test_pages(spark):
    df = spark.range(50)
    assert [r[0] for r in ranking.page(df, 3, 10, F.asc("id")).collect()] == [10, 11, 12]
    assert [r[0] for r in ranking.page_after(df, 3, "id", 12).collect()] == [13, 14, 15]
    assert [r[0] for r in ranking.page_after(df, 2, "id", None).collect()] == [0, 1]
    clipped, flag = ranking.clip(df.withColumn("x", F.lit(1)), 10, 1)
    assert [tuple(r) for r in ranking.page_with_total(df, 2, "id", 12).collect()] == [(13, 50), (14, 50)]
    assert [r[0] for r in ranking.clip(df, 2, 1, F.desc("id"))[0].collect()] == [49, 48]
    assert clipped.columns == ["id"] and clipped.count() == 10 and tuple(flag.first()) == (True, True)


def test_candidates_share_enough_after_their_first_common_token(spark, monkeypatch):
    """A token that all sets use makes no candidates by itself, and is dealt to many salts without losing a pair."""
    monkeypatch.setattr(similarity, "USES_OF_A_SALT", 50)
    sets = [[f"all{j}" for j in range(3)] + [f"own{i}-{j}" for j in range(4)] for i in range(150)]
    near = [s[:6] + ["x"] for s in sets[:20]]
    frame = lambda rows, key: spark.createDataFrame(list(enumerate(rows)), f"{key} int, tokens array<string>")
    a, b = similarity._distinct_sets(similarity._sets(frame(sets, "i"), "i", "tokens")), similarity._distinct_sets(similarity._sets(frame(near, "c"), "c", "tokens"))
    uses = a.select(F.explode("tokens").alias("token")).unionByName(b.select(F.explode("tokens").alias("token"))).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    assert similarity.candidates_of(a, b, uses, 0.5).count() == 20
    got = best_match(frame(sets, "i"), "i", frame(near, "c"), "c", threshold=0.5).collect()
    assert sorted((r["i"], r["best_c"]) for r in got) == [(i, i) for i in range(20)]
    # sets that differ in rare tokens only: the common ones must still find them
    alike = frame([[f"all{j}" for j in range(9)] + [f"r{i}"] for i in range(120)], "i")
    got = best_match(alike, "i", frame([[f"all{j}" for j in range(9)] + ["q"]], "c"), "c", threshold=0.5).collect()
    assert len(got) == 120
