"""Connected components by minimum labels with pointer jumping, on stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, label) for every node of edges (a, b): label is the smallest node that it reaches.

    Each round takes the least label among neighbours, hands it to the old root, and follows the
    root's label one step further; rounds are few even for long chains. Nothing is collected but
    one count per round. A hot node or label meets partial aggregates and plain joins only."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.save(both.where("a <> b").distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("n")).select("node", F.least("node", "n").alias("label")), f"{name}-0")
    k = 0
    while True:
        k += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        roots = met.groupBy(F.col("label").alias("new")).agg(F.min("new").alias("root"))
        nxt = met.join(roots, "new", "left").select("node", F.least("new", F.coalesce("root", "new")).alias("label"), F.col("label").alias("old"))
        nxt = scratch.save(nxt, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        labels = nxt.select("node", "label")
        if not nxt.where("label <> old").limit(1).count():
            return labels
