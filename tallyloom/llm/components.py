"""Connected components of an edge table by least labels, one shared table for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of `edges` (a, b); the label is the component's smallest node.

    Each round takes the least label among the neighbours, then the label of that label, and
    ends when a round changes nothing. Labels are grouped with partial sums, so a node with
    very many neighbours is one row for each map task. Self-loops and repeats do no harm; no
    edges give an empty table.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialise(both.distinct(), "links")
    labels = materialise(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        roots = labels.select(F.col("node").alias("mid"), F.col("label").alias("root"))
        step = materialise(lower.join(roots, "mid").select("node", "old", F.least("mid", "root").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            return labels
