"""Smallest label of connected rows, by alternating hooks and jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from haltwise.sources.folders import Steps


def smallest_labels(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node connected to each node of edges (u, v). Lineage is cut in the shared folder each round."""
    steps = Steps(edges.sparkSession)
    both = steps.write(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = steps.write(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("label")).select(F.col("u").alias("node"), "label"), "labels")
    while True:
        # Hook: the smallest label among neighbours; jump: that label's own label.
        seen = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("m"))
        hooked = labels.join(seen, labels["node"] == seen["u"]).select("node", F.least("label", "m").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        nxt = steps.write(hooked.join(up, "label", "left").select("node", F.least(F.col("label"), F.coalesce("upper", "label")).alias("label")), "labels")
        settled = nxt.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty()
        steps.drop(labels)
        if settled:
            steps.drop(both)
            return nxt
        labels = nxt
