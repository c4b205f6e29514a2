"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; a component is named by its smallest node.

    Every round takes the smallest label among neighbours and then the label of that label, so long chains
    shrink quickly. Each round ends in a checkpoint; only the number of changes comes to the driver."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut_lineage(both.where("a <> b").distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b"))
                         .select("node", F.least("node", "b").alias("component")))
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        step = labels.join(near, "node").select("node", F.col("component").alias("old"),
                                                F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = cut_lineage(step.join(jump, "component")
                           .select("node", F.least("component", "further").alias("component"), "old"))
        labels = step.select("node", "component")
        if not step.where("component <> old").limit(1).count():
            return labels
