"""Connected components by minimum labels and pointer jumping, with checkpoints in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.shared import exchanged, materialise, salted_join


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b). The graph never leaves the executors.

    Each round gives a node the smallest label among its own and its neighbours', then follows labels twice; rounds end
    when no label changes, after about the logarithm of the longest path. Rows that look up the same node or label, such
    as the spokes of a hub, are dealt to many tasks.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where(F.col("a") != F.col("b")).distinct()
    both = materialise(both, f"{name}-edges")
    labels = materialise(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), f"{name}-labels")
    while True:
        told = salted_join(both, labels.withColumnRenamed("node", "b"), ["b"]).groupBy("a").agg(F.min("label").alias("near"))
        heard = labels.join(exchanged(told), labels["node"] == told["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        heard = materialise(heard, f"{name}-heard")
        ahead = heard.select(F.col("node").alias("label"), F.col("label").alias("_l"))
        after = materialise(salted_join(heard, ahead, ["label"]).select("node", "old", F.least("label", "_l").alias("label")), f"{name}-labels")
        changed = not after.where(F.col("label") != F.col("old")).isEmpty()
        labels = after.select("node", "label")
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
