"""Connected components of a graph of links, by rounds of smallest neighbour labels and label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, label for every node of ``edges(a, b)``; the label is the smallest node of its component.

    Each round takes the smallest label among a node's neighbours and then follows labels of labels, so the rounds needed grow
    with the logarithm of a component's width. Every round is a written table.
    """
    e = edges.select("a", "b")
    both = stored(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")), "labels")
    for _ in range(most_rounds):
        heard = both.join(labels, F.col("a") == F.col("node")).groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", F.least("label", "heard").alias("near"), F.col("label").alias("old"))
        jump = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        new = stored(near.join(jump, "near", "left").select("node", F.least("near", F.coalesce("far", "near")).alias("label"), "old"), "labels")
        labels = new.select("node", "label")
        if new.where("label != old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
