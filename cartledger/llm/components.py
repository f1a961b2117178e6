"""Connected components over a table of links, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartledger.llm.session import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (x, y); the component is its smallest node.

    Each round a node takes the smallest label around it and then the label of
    its label, so paths shrink about by half.  Labels are reduced in the map
    tasks, so a node with very many links does not meet in one task.
    """
    both = staged(
        links.select("x", "y").union(links.select(F.col("y"), F.col("x"))).where("x != y").distinct(), "links"
    )
    labels = staged(
        both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("x"), F.min("y")).alias("component")), "labels"
    )
    while True:
        around = (
            both.join(labels, F.col("y") == F.col("node"))
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("component").alias("offer"))
        )
        lower = labels.join(around, "node").select(
            "node", F.col("component").alias("before"), F.least("component", "offer").alias("component")
        )
        lower = staged(lower, "labels")
        target = lower.select(F.col("node").alias("target"), F.col("component").alias("jump"))
        jumped = lower.join(target, F.col("component") == F.col("target")).select(
            "node", F.col("jump").alias("component"), (F.col("jump") != F.col("before")).alias("moved")
        )
        jumped = staged(jumped, "labels")
        labels = jumped.select("node", "component")
        if jumped.where("moved").isEmpty():
            return labels
