"""Connected groups of linked records, by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from siltstone.runtime import settle


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group_id) of every node of the undirected ``links``; the group's id is its smallest node.

    Each round takes the smallest label among neighbours, then the label of that label, so
    the rounds grow with the logarithm of a group's length. Every round is written to the
    shared folder, which cuts the lineage. A node in a third of all links meets only partial
    minima. Null ends are ignored; no links give no rows.
    """
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    edges = settle(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = settle(edges.groupBy("u").agg(F.least("u", F.min("v")).alias("label")), "labels")
    while True:  # labels only get smaller, so it ends
        seen = edges.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("_near"))
        lower = labels.join(seen, "u").select("u", "label", F.least("label", "_near").alias("_low"))
        target = labels.select(F.col("u").alias("_low"), F.col("label").alias("_jump"))
        stepped = settle(lower.join(target, "_low").select("u", F.least("_low", "_jump").alias("label"), (F.least("_low", "_jump") < F.col("label")).alias("_moved")), "labels")
        moved = stepped.where("_moved").limit(1).count()
        labels = stepped.drop("_moved")
        if not moved:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("group_id"))
