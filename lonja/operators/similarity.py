"""Best match between token sets: exact Jaccard above a threshold, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.session import written

#: Uses of a token that one salt takes, and salts of a token at most.
USES_OF_A_SALT, MOST_SALTS = 10_000, 64


def _sets(df: DataFrame, key: str, tokens: str, span: DataFrame | None = None) -> DataFrame:
    """(key, sorted distinct tokens, hash of the set); empty sets never match anything."""
    clean = F.sort_array(F.array_distinct(F.col(tokens)))
    # a one-element explode keeps the filters below from computing the tokens again
    rows = df.select(F.col(key).alias("key"), F.explode(F.array(clean)).alias("tokens")).where(F.size("tokens") > 0)
    if span is not None:
        rows = (rows.crossJoin(F.broadcast(span)).where(F.size("tokens").between(F.col("lo"), F.col("hi")))
                .select("key", "tokens"))
    return rows.withColumn("fp", F.md5(F.concat_ws("\u001f", "tokens")))


def _distinct_sets(sets: DataFrame, *extra: Column) -> DataFrame:
    """One row per different set: copies of a text, however many, are compared once."""
    return sets.groupBy("fp").agg(F.first("tokens").alias("tokens"), *extra).withColumn("size", F.size("tokens"))


def _prefixes(sets: DataFrame, ranks: DataFrame, threshold: float, side: str) -> DataFrame:
    """The rarest tokens of each set, enough of them that two similar sets must share one, with their places in the common order.

    Sets of n tokens with Jaccard >= t overlap in at least ceil(t * n) tokens, so the first
    n - ceil(t * n) + 1 tokens in any common order contain one of them.  A token that very many sets use is dealt
    to salts: each row of side a goes to one of them, those of side b to all.
    """
    keep = (F.col("size") - F.ceil(F.col("size") * threshold) + 1).cast("int")
    ranked = (sets.select("fp", "size", F.explode("tokens").alias("token")).join(ranks, "token")
              .groupBy("fp", "size").agg(F.sort_array(F.collect_list(F.struct("uses", "token"))).alias("t")))
    salts = F.least(F.ceil(F.col("x.uses") / USES_OF_A_SALT), F.lit(MOST_SALTS)).cast("int")
    salt = F.array(F.pmod(F.xxhash64(f"{side}_fp"), salts).cast("int")) if side == "a" else F.sequence(F.lit(0), salts - 1)
    return ranked.select(F.col("fp").alias(f"{side}_fp"), F.col("size").alias(f"{side}_size"),
                         F.posexplode(F.slice("t", F.lit(1), keep)).alias("p", "x")).select(
        f"{side}_fp", f"{side}_size", F.col("p").alias(f"{side}_place"), F.col("x.token").alias("token"), F.explode(salt).alias("salt"))


def candidates_of(a: DataFrame, b: DataFrame, uses: DataFrame, threshold: float) -> DataFrame:
    """Pairs that can be similar enough: of fitting sizes, with a shared rare token before which nothing is shared yet,
    and enough tokens after it on both sides."""
    needed = F.ceil((F.col("a_size") + F.col("b_size")) * (threshold / (1 + threshold)) - 1e-9)
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    return (_prefixes(a, uses, threshold, "a").join(_prefixes(b, uses, threshold, "b"), ["token", "salt"])
            .where((F.col("a_size") >= F.col("b_size") * threshold) & (F.col("b_size") >= F.col("a_size") * threshold) & (left >= needed))
            .select("a_fp", "b_fp").distinct())


def best_match(items: DataFrame, item_key: str, candidates: DataFrame, candidate_key: str, tokens: str = "tokens",
               threshold: float = 0.5) -> DataFrame:
    """For every item the most similar candidate with Jaccard >= threshold; ties go to the lowest candidate key.

    Exact at any size: sets whose sizes rule out the threshold are dropped, equal sets are folded,
    and pairs come only from shared rare tokens.  No candidate list is cut.  The token sets in
    question are written out once, so that long texts are not cut into tokens again per branch.
    """
    b = written(_distinct_sets(_sets(candidates, candidate_key, tokens), F.min("key").alias("candidate")), "candidates")
    span = b.agg((F.min("size") * threshold).alias("lo"), (F.max("size") / threshold).alias("hi"))
    # sizes first: sets that cannot reach the threshold are neither hashed nor shuffled
    left = written(_sets(items, item_key, tokens, span), "items")
    a = _distinct_sets(left)
    uses = (a.select(F.explode("tokens").alias("token")).unionByName(b.select(F.explode("tokens").alias("token")))
            .groupBy("token").agg(F.count(F.lit(1)).alias("uses")))
    pairs = candidates_of(a, b, uses, threshold)
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    scored = (pairs.join(a.select(F.col("fp").alias("a_fp"), F.col("tokens").alias("a_tokens")), "a_fp")
              .join(b.select(F.col("fp").alias("b_fp"), F.col("tokens").alias("b_tokens"), "candidate"), "b_fp")
              .select("a_fp", "candidate", (common / (F.size("a_tokens") + F.size("b_tokens") - common)).alias("similarity"))
              .where(F.col("similarity") >= threshold))
    best = scored.groupBy("a_fp").agg(F.max("similarity").alias("similarity"),
                                      F.min_by("candidate", F.struct(-F.col("similarity"), F.col("candidate"))).alias("candidate"))
    return left.select("key", F.col("fp").alias("a_fp")).join(best, "a_fp").select(
        F.col("key").alias(item_key), F.col("candidate").alias(f"best_{candidate_key}"), "similarity")
