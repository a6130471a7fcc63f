"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settle


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of `links`, which has columns a and b.

    Labels fall to the smallest among neighbours, then jump to the label of their label, until none changes; the number of
    rounds grows with the logarithm of the longest path. Each round is checkpointed, and only a count reaches the driver.
    """
    both = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("m"))
        fallen = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "m").alias("via"))
        up = labels.select(F.col("node").alias("via"), F.col("component").alias("top"))
        fresh = settle(fallen.join(up, "via").select("node", "old", F.least("via", "top").alias("component")))
        done = fresh.where("component < old").isEmpty()
        labels = fresh.select("node", "component")
        if done:
            return labels
