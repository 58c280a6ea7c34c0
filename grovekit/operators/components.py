"""Unconstrained connected components by minimum labels (GRP-11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.scale import Workspace


def min_label(edges: DataFrame, keys: Sequence[str], ws: Workspace) -> DataFrame:
    """(keys, node, label): each node of an edge (keys, a, b) with the smallest node it is connected to within its key.

    Labels pass along edges and then jump to their label's label, so the rounds grow with the logarithm of a path.
    """
    both = edges.select(*keys, "a", "b").union(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null").distinct()
    both = ws.save(both, "edges")
    now = ws.save(both.groupBy(*keys, "a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "label0")
    k = 0
    while True:
        seen = both.join(now.withColumnRenamed("node", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("m"))
        step = now.join(seen, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = now.select(*keys, F.col("node").alias("label"), F.col("label").alias("up"))
        nxt = ws.save(step.join(jump, [*keys, "label"], "left").select(*keys, "node", F.coalesce("up", "label").alias("label"), (F.coalesce("up", "label") != F.col("old")).alias("moved")), f"label{k + 1}")
        ws.drop(f"label{k}")
        done = nxt.where("moved").isEmpty()
        now, k = nxt.drop("moved"), k + 1
        if done:
            return now
