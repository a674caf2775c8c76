"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreframe.session import discard, store


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of `edges` (a, b): the smallest node it is connected with.

    Each round takes the smallest label over the edges and then the label of the label, so
    chains shorten by half. Labels are written to the shared folder round by round; the
    minimum is taken on the map side, and a node of very many edges meets its one label in
    a join whose large side can be split.
    """
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = edges.select("a", "b").unionByName(turned)
    both = store(both.distinct(), "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    labels = store(labels.withColumn("label", F.least("node", "label")), "labels")
    while True:
        reached = both.join(labels, F.col("a") == F.col("node"))
        reached = reached.select(F.col("b").alias("node"), "label")
        near = reached.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        near = store(near, "near-labels")
        root = near.select(F.col("node").alias("label"), F.col("label").alias("root"))
        jumped = near.join(root, "label").select("node", F.col("root").alias("label"))
        last, labels = labels, store(jumped, "labels")
        old = last.select("node", F.col("label").alias("old"))
        done = labels.join(old, "node").filter("label <> old").isEmpty()
        discard(near, last)
        if done:
            discard(both)
            return labels
