"""Connected components of a link table, with DataFrame joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node of each node's component; ``edges`` are ``(a, b)`` longs.

    Every round takes the smallest label among the neighbours and then the label of that
    label, so rounds grow with the logarithm of the distance.  A hub's links are summed
    map-side or joined, never gathered; each round is written to the shared folder.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels.node == near.a).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        step = stored(step)
        jump = step.select(F.col("node").alias("at"), F.col("label").alias("further"))
        moved = step.join(jump, step.label == jump["at"]).select("node", "old", F.least("label", "further").alias("label"))
        moved = stored(moved)
        if moved.where("label <> old").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
