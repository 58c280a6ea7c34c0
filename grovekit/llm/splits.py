"""Splits that keep related records together, over a persisted spanning forest.

Borůvka's rounds: each component takes its lightest edge to another component, the chosen edges join the forest, chains of
hooks are cut short by pointer doubling and the edges relabelled, keeping the lightest of parallel ones.  Weights are made
unique by a hash and the edge's ends, so chosen edges form no cycle but the pair that choose each other.  Only minima are
aggregated; no component is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grovekit.functions.names import split_name, told, tree_key
from grovekit.scale import Workspace, distributed_rank, read, star_edges
from grovekit.sources.files import file_states, signature, stored

#: Size bands are so narrow that the largest group of a band is at most 2 ** (1 / BANDS) times its smallest: 9 %.
BANDS = 8


def spanning_forest(edges: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of undirected edges (a, b, weight): the forest's edges and each vertex's root, the smallest vertex.

    Repeated edges, loops and null ends add nothing.  Both are written tables; labels has (vertex, root).
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rank = F.struct(F.col("weight").cast("double").alias("w"), F.xxhash64(low, high).alias("h"), low.alias("lo"), high.alias("hi"))
    now = ws.save(edges.where("a <> b").groupBy(low.alias("a"), high.alias("b")).agg(F.min("weight").alias("weight")).select("a", "b", rank.alias("e")), "edges0")
    forest, hops, k = [], [], 0
    while not now.isEmpty():
        both = now.select(F.col("a").alias("v"), F.col("b").alias("w"), "e").union(now.select(F.col("b").alias("v"), F.col("a").alias("w"), "e"))
        pick = ws.save(both.groupBy("v").agg(F.min(F.struct("e", "w")).alias("m")).select("v", F.col("m.w").alias("p"), F.col("m.e").alias("e")), f"pick{k}")
        forest.append(pick.select(F.col("e.lo").alias("a"), F.col("e.hi").alias("b"), F.col("e.w").alias("weight")).distinct())
        back = pick.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        ptr = ws.save(pick.join(back, "p").select("v", F.when((F.col("pp") == F.col("v")) & (F.col("v") < F.col("p")), F.col("v")).otherwise(F.col("p")).alias("p")), f"ptr{k}_0")
        step = 0
        while True:
            up = ptr.select(F.col("v").alias("p"), F.col("p").alias("q"))
            nxt = ws.save(ptr.join(up, "p").select("v", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")), f"ptr{k}_{step + 1}")
            ws.drop(f"ptr{k}_{step}")
            moved = not nxt.where("moved").isEmpty()
            ptr, step = nxt.select("v", "p"), step + 1
            if not moved:
                break
        hops.append(ptr)
        ra, rb = ptr.select(F.col("v").alias("a"), F.col("p").alias("ra")), ptr.select(F.col("v").alias("b"), F.col("p").alias("rb"))
        moved_edges = now.join(ra, "a").join(rb, "b").where("ra <> rb")
        nxt = ws.save(moved_edges.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.min("e").alias("e")), f"edges{k + 1}")
        ws.drop(f"edges{k}")
        now, k = nxt, k + 1
    if not hops:
        return now.select("a", "b", F.col("e.w").alias("weight")), now.select(F.col("a").alias("vertex"), F.col("a").alias("root"))
    whole = forest[0]
    for part in forest[1:]:
        whole = whole.union(part)
    whole = ws.save(whole, "forest")
    labels = hops[-1]
    for hop in reversed(hops[:-1]):
        labels = hop.join(labels.select(F.col("v").alias("p"), F.col("p").alias("s")), "p", "left").select("v", F.coalesce("s", "p").alias("p"))
    labels = ws.save(labels, "raw_labels")
    least = labels.groupBy("p").agg(F.min("v").alias("root"))
    return whole, ws.save(labels.join(least, "p").select(F.col("v").alias("vertex"), "root"), "labels")


def related_rows(manifest: DataFrame) -> DataFrame:
    """Edges between rows that must share a split: the same tree (weight 1) or the same session (weight 2)."""
    rows = manifest.select("row_id", tree_key(F.col("tree_id")).alias("tree"), told(F.col("session_id")).alias("session")).where("row_id is not null")
    tree = star_edges(rows.where("tree is not null"), ["tree"], "row_id").withColumn("weight", F.lit(1.0))
    session = star_edges(rows.where("session is not null"), ["session"], "row_id").withColumn("weight", F.lit(2.0))
    return tree.union(session)


def manifest_forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of the manifest, persisted: built by the first query that needs them and read by the others.

    They are kept by the manifest's files, sizes and times of change, so a changed manifest gets a forest of its own.
    """
    key = signature(file_states(spark, f"{sf_dir}/split_manifest.parquet"), "forest", 2)
    made: list = []

    def make(which: int) -> DataFrame:
        if not made:
            made.extend(spanning_forest(related_rows(read(spark, sf_dir, "split_manifest")), Workspace(spark, "p5")))
        return made[which]

    return stored(spark, "forest", key, lambda: make(0)), stored(spark, "forest_labels", key, lambda: make(1))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, labels = manifest_forest(spark, sf_dir)
    return labels.select(F.col("vertex").alias("row_id"), F.col("root").alias("group_id"))


def p5_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest's edges: for each row but one of a group, why it is tied to the others."""
    forest, _ = manifest_forest(spark, sf_dir)
    return forest.select(F.col("a").alias("row_lo"), F.col("b").alias("row_hi"), F.when(F.col("weight") == 1, "tree").otherwise("session").alias("tie"))


def band_quotas(bands: list[tuple[int, int, int]], wanted: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """For each band (number, groups, rows) how many of its groups each split gets, by one rule for all bands.

    Bands come largest groups first.  A band's groups are shared out like the rows the splits still lack, in whole groups by
    largest remainders; what a split gets beyond or short of its part is made up in the bands of smaller groups.
    """
    rows, total = sum(r for _, _, r in bands), sum(wanted.values())
    lack = {k: v / total * rows for k, v in wanted.items()}
    out = {}
    for band, n, r in sorted(bands, reverse=True):
        open_ = {k: max(v, 0.0) for k, v in lack.items()}
        whole = sum(open_.values())
        part = {k: n * (v / whole if whole else wanted[k] / total) for k, v in open_.items()}
        quota = {k: int(v) for k, v in part.items()}
        for k in sorted(part, key=lambda k: (quota[k] - part[k], k))[: n - sum(quota.values())]:
            quota[k] += 1
        for k, q in quota.items():
            lack[k] -= q * r / n
        out[band] = sorted(quota.items())
    return out


def deal_splits(groups: DataFrame, targets: DataFrame, seed: int = 11) -> DataFrame:
    """(group_id, size, new_split): groups dealt to splits so that each gets its share of the rows.

    ``groups`` is (group_id, size); ``targets`` (split_name, share), a handful of rows, shares scaled to sum to one.  Groups are
    stratified by size band, numbered within their band in a hash order without gaps, and each split gets as many
    consecutive numbers as :func:`band_quotas` says, whether the band holds one giant or a billion single rows.  Only the
    bands' counts come to the driver, at most ``BANDS`` for each power of two up to the largest group.
    """
    wanted = {r.split_name: float(r.share) for r in targets.where("split_name is not null and share > 0").groupBy("split_name").agg(F.max("share").alias("share")).collect()}
    if not wanted:
        return groups.select("group_id", "size", F.lit(None).cast("string").alias("new_split"))
    banded = groups.withColumn("band", F.floor(F.log2("size") * BANDS + 1e-9).cast("int")).withColumn("h", F.xxhash64("group_id", F.lit(seed)))
    bands = [(r["band"], r["n"], r["rows"]) for r in banded.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("rows")).collect()]
    numbered = distributed_rank(banded, ["band"], [F.col("h"), F.col("group_id")], "rank")
    cuts = []
    for band, quota in band_quotas(bands, wanted).items():
        first = 0
        for name, q in quota:
            if q:
                cuts.append((band, first, first + q, name))
            first += q
    table = F.broadcast(groups.sparkSession.createDataFrame(cuts, "_band int, _from bigint, _to bigint, new_split string"))  # a few rows a band
    on = (F.col("band") == F.col("_band")) & (F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to"))
    return numbered.join(table, on).select("group_id", "size", "new_split")


def assign(manifest: DataFrame, targets: DataFrame, ws: Workspace, labels: DataFrame | None = None) -> DataFrame:
    """Each row with its group and its new split; a row tied to no other is its own group.  ``labels``: of a forest already built."""
    if labels is None:
        _, labels = spanning_forest(related_rows(manifest), ws)
    rows = manifest.select("row_id", F.col("source"), split_name(F.col("new_split")).alias("old_split"))
    grouped = ws.save(rows.join(labels.withColumnRenamed("vertex", "row_id"), "row_id", "left").select("row_id", "source", "old_split", F.coalesce("root", "row_id").alias("group_id")), "grouped")
    sizes = ws.save(grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")), "sizes")
    dealt = ws.save(deal_splits(sizes, targets), "dealt")
    return grouped.join(dealt.select("group_id", F.col("size").alias("group_size"), "new_split"), "group_id")


def p5_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the manifest with its new split."""
    ws = Workspace(spark, "p5")
    return assign(read(spark, sf_dir, "split_manifest"), read(spark, sf_dir, "split_targets"), ws, manifest_forest(spark, sf_dir)[1]).select("row_id", "group_id", "group_size", "new_split")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups, actual and target share of each split."""
    targets = read(spark, sf_dir, "split_targets")
    out = assign(read(spark, sf_dir, "split_manifest"), targets, Workspace(spark, "p5"), manifest_forest(spark, sf_dir)[1])
    got = out.groupBy("new_split").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("group_id").alias("n_groups"))
    got = got.withColumn("actual_share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy()))
    return targets.select(F.col("split_name").alias("new_split"), F.col("share").alias("target_share")).join(got, "new_split", "full").select(
        "new_split", "target_share", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("actual_share", F.lit(0.0)).alias("actual_share"))
