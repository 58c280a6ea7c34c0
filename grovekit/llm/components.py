"""Consolidating pairwise matches into groups by randomised graph contraction.

Every round each vertex hooks to the neighbour (or itself) that comes first in a fresh hash order; edges are relabelled with the
hooks and deduplicated, until none is left.  The hooks are tables that shrink geometrically; composed from the last to the
first they give every vertex its group.  No vertex's neighbours are ever gathered in a task (only ``min`` is aggregated, with
map-side combining), and the two relabelling joins are inner equi-joins whose hot keys adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.scale import Workspace, read, star_edges, tidy

#: A round removes a quarter of the vertices on average, so 200 are enough for any table; more mean an error.
MAX_ROUNDS = 200


def _order(c, seed: int):
    return F.xxhash64(c, F.lit(seed))


def connected_groups(edges: DataFrame, ws: Workspace, a: str = "a", b: str = "b", seed: int = 7) -> DataFrame:
    """(vertex, group_id) for every vertex of an edge between two different vertices; group_id is the smallest of the group.

    ``edges`` holds bigint ends in any direction; repeated edges, loops and null ends are allowed and add nothing.  An empty
    table gives an empty result.
    """
    now = ws.save(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(f"{a} is not null and {b} is not null and {a} <> {b}"), "edges0")
    hooks, k = [], 0
    while not now.isEmpty():
        if k == MAX_ROUNDS:
            raise RuntimeError(f"edges are left after {MAX_ROUNDS} rounds of contraction")
        both = now.select(F.col("a").alias("v"), F.col("b").alias("w")).union(now.select(F.col("b").alias("v"), F.col("a").alias("w")))
        first = both.groupBy("v").agg(F.min(F.struct(_order(F.col("w"), seed + k).alias("h"), F.col("w").alias("w"))).alias("m"))
        own = F.struct(_order(F.col("v"), seed + k).alias("h"), F.col("v").alias("w"))
        hook = ws.save(first.select("v", F.least(own, F.col("m"))["w"].alias("r")), f"hooks{k}")
        left, right = hook.select(F.col("v").alias("a"), F.col("r").alias("ra")), hook.select(F.col("v").alias("b"), F.col("r").alias("rb"))
        joined = now.join(left, "a").select("b", "ra").join(right, "b").where("ra <> rb")
        nxt = ws.save(joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"edges{k + 1}")
        ws.drop(f"edges{k}")
        hooks.append(hook)
        now, k = nxt, k + 1
    if not hooks:
        return now.select(F.col("a").alias("vertex"), F.col("a").alias("group_id"))
    labels = hooks[-1]
    for hook in reversed(hooks[:-1]):
        later = labels.select(F.col("v").alias("r"), F.col("r").alias("s"))
        labels = hook.join(later, "r", "left").select("v", F.coalesce("s", "r").alias("r"))
    labels = ws.save(labels, "labels")
    ws.drop(*[f"hooks{i}" for i in range(k)], f"edges{k}")
    least = labels.groupBy("r").agg(F.min("v").alias("group_id"))
    return labels.join(least, "r").select(F.col("v").alias("vertex"), "group_id")


def box_matches(boxes: DataFrame, links: DataFrame) -> DataFrame:
    """Edges (a, b) of box ids: rows of ``links`` that name two known boxes, and boxes of one tree with the same bunch_id.

    tree_id is compared without blanks and letter case; a null, blank or negative bunch_id says nothing; links with a null
    end or an end that names no box are left out.
    """
    known = boxes.select("box_id", F.lower(tidy(F.col("tree_id"))).alias("tree"), "side_index", "box_index", "bunch_id").where("box_id is not null")
    at = known.select("tree", "side_index", "box_index", "box_id")
    ends = links.select(F.lower(tidy(F.col("tree_id"))).alias("tree"), "side_i", "i", "side_j", "j").where("side_i is not null and i is not null and side_j is not null and j is not null and tree is not null")
    one = ends.join(at.withColumnsRenamed({"side_index": "side_i", "box_index": "i", "box_id": "a"}), ["tree", "side_i", "i"])
    two = one.select("tree", "side_j", "j", "a").join(at.withColumnsRenamed({"side_index": "side_j", "box_index": "j", "box_id": "b"}), ["tree", "side_j", "j"])
    told = known.where(F.col("bunch_id").isNotNull() & (tidy(F.col("bunch_id")) != "") & ~tidy(F.col("bunch_id")).startswith("-") & F.col("tree").isNotNull())
    return two.where("a <> b").select("a", "b").union(star_edges(told, ["tree", "bunch_id"], "box_id"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "p1")
    edges = box_matches(read(spark, sf_dir, "gt_boxes"), read(spark, sf_dir, "edges"))
    return connected_groups(edges, ws).select(F.col("vertex").alias("box_id"), "group_id")
