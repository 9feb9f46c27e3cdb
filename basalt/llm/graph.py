"""Connected components by label propagation with pointer jumping; everything stays on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def connected(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node it reaches) for every node of the edges ``a``, ``b`` (long).

    Each round takes the smallest label next to a node and then the label of that label, so that the
    distance still to go at least halves along a path; each round is written, so no lineage grows.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        next_ = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("root"), F.col("label").alias("root_label"))
        jumped = next_.join(root, next_["label"] == root["root"], "left").select("node", "was", F.least("label", "root_label").alias("label"))
        before, labels = labels, stored(jumped, "labels")
        discard(before)
        if labels.where("was <> label").isEmpty():
            discard(both)
            return labels.select("node", "label")
