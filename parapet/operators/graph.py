"""Connected components by smallest labels with pointer jumping; every round is a stored table, nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parapet.sources.shared import discard, stored


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> (node, label): the smallest node reachable, for every node with a link. Self links are allowed.

    Labels fall to the smallest of the neighbours' and then to that label's own label, so that a chain of n nodes takes some log n
    rounds. Tables of earlier rounds are deleted.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = stored(both, "edges")
    table = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        labels = table.select("node", "label")
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = stored(labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = stored(lower.join(jump, "label", "left").select("node", "old", F.coalesce("further", "label").alias("label")), "labels")
        discard(lower, table)
        table = moved
        if moved.where("label != old").isEmpty():
            discard(edges)
            return moved.select("node", "label")
