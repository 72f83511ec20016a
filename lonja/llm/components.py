"""Connected components by label propagation with pointer jumping, wholly in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.session import written


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for every node of ``links`` (a, b): the smallest node that it reaches.

    A round takes the least label among a node's neighbours, then the label of that label, so the longest
    path halves each time.  Labels are written after each round; only a count of changes reaches the driver.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        fresh = written(nearer.join(jump, nearer["label"] == jump["at"]).select("node", "old", F.least("label", "further").alias("label")), "labels")
        changed = fresh.filter("label <> old").limit(1).count()
        labels = fresh.select("node", "label")
        if not changed:
            return labels
    raise RuntimeError("components did not settle")
