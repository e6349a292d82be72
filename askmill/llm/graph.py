"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askmill.tables import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; the component is named by its smallest node.

    Every round each node takes the smallest label around it and then the label of that label, so that
    long chains shrink by half or more. Each round is written as a table of its own, and two rounds are
    compared by two sums.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(both.where("a != b").distinct())
    labels = stored(edges.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    before = None
    while True:
        around = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        near = labels.join(around, "node").select("node", F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        shorter = stored(
            near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"))
        )
        drop_stored(labels)
        labels = shorter
        state = labels.agg(F.count("*"), F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()
        if state == before:
            drop_stored(edges)
            return labels.withColumnRenamed("label", "component")
        before = state
