"""Aggregates over entities: counts, feature vectors, error metrics, agreement and rank statistics (AGG).

Everything is a declarative aggregation; groups are combined map-side before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.scale import Workspace, band_of, parts_for, score_cuts


def N() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))



def class_counts(df: DataFrame, keys: Sequence[str], cls: str, classes: int) -> DataFrame:
    """(keys, cls, n) with a row for every class of every key, 0 where there is none."""
    per = df.groupBy(*keys).agg(*[F.count_if(F.col(cls) == k).alias(f"_{k}") for k in range(classes)])
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.col(f"_{k}").alias("n")) for k in range(classes)]))
    return per.select(*keys, pairs.alias("_p")).select(*keys, F.col("_p.cls").alias(cls), F.col("_p.n").alias("n"))


def threshold_cube(df: DataFrame, keys: Sequence[str], value: str, cuts: Sequence[float]) -> DataFrame:
    """(keys, tau, n): rows whose value reaches each cut; one pass, no join with the grid."""
    per = df.groupBy(*keys).agg(*[F.count_if(F.col(value) >= c).alias(f"_{i}") for i, c in enumerate(cuts)])
    pairs = F.explode(F.array(*[F.struct(F.lit(float(c)).alias("tau"), F.col(f"_{i}").alias("n")) for i, c in enumerate(cuts)]))
    return per.select(*keys, pairs.alias("_p")).select(*keys, "_p.tau", "_p.n")


def summary(c: Column, prefix: str) -> list[Column]:
    """Sum, mean, population deviation, min, quartiles and max; 0 where there is nothing."""
    quart = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    parts = {"sum": F.sum(c), "mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "q25": quart[0], "median": quart[1], "q75": quart[2], "max": F.max(c)}
    return [F.coalesce(v, F.lit(0.0)).alias(f"{prefix}_{k}") for k, v in parts.items()]


def tree_features(boxes: DataFrame, tree: str, sides: int, classes: int) -> DataFrame:
    """The feature vector of a tree from its boxes (tree, side, cls, score, cy, area): 15 numbers a class and 7 more.

    Sides and classes without boxes count as zeros: per class the per-side counts' sum, max, mean, population deviation, min,
    variation, number of sides seen and consistency; the scores' sum, mean, max and numbers reaching .5 and .6; mean height in the
    image (.5 without boxes) and mean area.  And: sides, boxes, class shares, and share of class 3 among classes 2 and 3.
    """
    cell = boxes.groupBy(tree, "side", "cls").agg(N().alias("n"), F.sum("score").alias("s"), F.max("score").alias("m"), F.count_if(F.col("score") >= 0.5).alias("n5"), F.count_if(F.col("score") >= 0.6).alias("n6"), F.sum("cy").alias("cy"), F.sum("area").alias("area"))
    aggs = []
    for k in range(classes):
        here = lambda c, k=k: F.sum(F.when(F.col("cls") == k, F.col(c)).otherwise(0))
        n, sq = here("n"), F.sum(F.when(F.col("cls") == k, F.col("n") * F.col("n")).otherwise(0))
        seen = F.count_if((F.col("cls") == k) & (F.col("n") > 0))
        most, least = F.coalesce(F.max(F.when(F.col("cls") == k, F.col("n"))), F.lit(0)), F.when(seen < sides, F.lit(0)).otherwise(F.min(F.when(F.col("cls") == k, F.col("n"))))
        mean = n / sides
        std = F.sqrt(F.greatest(sq / sides - mean * mean, F.lit(0.0)))
        out = {"sum": n, "max": most, "mean": mean, "std": std, "min": least, "cv": std / F.greatest(mean, F.lit(1e-9)), "sides": seen, "steady": 1 - std / F.greatest(most, F.lit(1)),
               "conf_sum": here("s"), "conf_mean": here("s") / F.greatest(n, F.lit(1)), "conf_max": F.coalesce(F.max(F.when(F.col("cls") == k, F.col("m"))), F.lit(0.0)), "n5": here("n5"), "n6": here("n6"),
               "cy": F.when(n > 0, here("cy") / F.greatest(n, F.lit(1))).otherwise(0.5), "area": here("area") / F.greatest(n, F.lit(1))}
        aggs += [v.cast("double").alias(f"c{k}_{name}") for name, v in out.items()]
    wide = cell.groupBy(tree).agg(*aggs)
    total = sum((F.col(f"c{k}_sum") for k in range(1, classes)), F.col("c0_sum"))
    late = F.col(f"c{classes - 2}_sum") + F.col(f"c{classes - 1}_sum")
    return wide.withColumns({"n_sides": F.lit(float(sides)), "total": total, **{f"share_{k}": F.col(f"c{k}_sum") / F.greatest(total, F.lit(1.0)) for k in range(classes)}, "late_share": F.col(f"c{classes - 1}_sum") / F.greatest(late, F.lit(1.0))})


def robust_scale(df: DataFrame, keys: Sequence[str], c: str, floor: float, at_least: int = 1) -> DataFrame:
    """(keys, center, scale, n): median and 1.4826 times the median absolute deviation, at least ``floor``, of groups big enough."""
    med = df.groupBy(*keys).agg(F.median(c).alias("center"), N().alias("n")).where(F.col("n") >= at_least)
    dev = df.join(med, list(keys)).groupBy(*keys, "center", "n").agg((1.4826 * F.median(F.abs(F.col(c) - F.col("center")))).alias("mad"))
    return dev.select(*keys, "center", F.greatest("mad", F.lit(floor)).alias("scale"), "n")


def weighted_vector(df: DataFrame, keys: Sequence[str], vector: str, weight: str, out: str) -> DataFrame:
    """Weighted mean of vectors, entry by entry."""
    e = df.select(*keys, weight, F.posexplode(vector).alias("_i", "_x"))
    mean = e.groupBy(*keys, "_i").agg((F.sum(F.col(weight) * F.col("_x")) / F.sum(weight)).alias("_m"))
    return mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(out))


def noisy_or(score: Column) -> Column:
    return 1 - F.exp(F.sum(F.log1p(-F.least(score, F.lit(0.999999)))))


def count_errors(df: DataFrame, cls: str, pred: str, true: str) -> DataFrame:
    """Mean absolute error, root mean square error, bias, exact and within-one shares, for each class and over all (cls null)."""
    d = F.col(pred) - F.col(true)
    aggs = [N().alias("n"), F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(d).alias("bias"), F.avg((d == 0).cast("double")).alias("exact"), F.avg((F.abs(d) <= 1).cast("double")).alias("within_one")]
    return df.groupingSets([[cls], []], cls).agg(*aggs)


def joint_within_one(df: DataFrame, entity: str, pred: str, true: str) -> DataFrame:
    """Share of entities whose counts of all classes are within one, and whose totals are."""
    per = df.groupBy(entity).agg(F.bool_and(F.abs(F.col(pred) - F.col(true)) <= 1).alias("all"), F.abs(F.sum(F.col(pred) - F.col(true))).alias("t"))
    return per.agg(N().alias("n"), F.avg(F.col("all").cast("double")).alias("joint"), F.avg((F.col("t") <= 1).cast("double")).alias("total"))


def confusion(pred: DataFrame, true: DataFrame, match: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """(pred_cls, gt_cls, n) with class ``classes`` as background: unmatched predictions and truths."""
    p = pred.select(*keys, "det_id", F.col("cls").alias("pred_cls"))
    t = true.select(*keys, "gt_id", F.col("cls").alias("gt_cls"))
    left = p.join(match.select(*keys, "det_id", "gt_id"), [*keys, "det_id"], "left").join(t, [*keys, "gt_id"], "full")
    return left.groupBy(F.coalesce("pred_cls", F.lit(classes)).alias("pred_cls"), F.coalesce("gt_cls", F.lit(classes)).alias("gt_cls")).agg(N().alias("n"))


def class_scores(conf: DataFrame, classes: int) -> DataFrame:
    """Precision, recall and F1 of each class from a confusion table with background."""
    tp = F.sum(F.when((F.col("k") == F.col("pred_cls")) & (F.col("k") == F.col("gt_cls")), F.col("n")).otherwise(0))
    p = F.sum(F.when(F.col("k") == F.col("pred_cls"), F.col("n")).otherwise(0))
    t = F.sum(F.when(F.col("k") == F.col("gt_cls"), F.col("n")).otherwise(0))
    each = conf.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))).groupBy(F.col("k").alias("cls")).agg(tp.alias("tp"), p.alias("n_pred"), t.alias("n_true"))
    pr, rc = F.col("tp") / F.greatest("n_pred", F.lit(1)), F.col("tp") / F.greatest("n_true", F.lit(1))
    return each.withColumn("precision", pr).withColumn("recall", rc).withColumn("f1", 2 * F.col("tp") / F.greatest(F.col("n_pred") + F.col("n_true"), F.lit(1)))


def average_precision(flagged: DataFrame, totals: DataFrame, keys: Sequence[str], variant: str = "coco", grid: Sequence[float] | None = None) -> DataFrame:
    """101-point average precision of (keys, score, tie, tp) against (keys, n_true).

    ``coco``: at each recall step the precision envelope at the first point that reaches it; ``raw``: the largest precision at any
    recall from there on (the same number); ``interp``: the envelope interpolated linearly between recalls.  A true row's
    precision is never below that of the row before it, so the envelope is level up to each recall and ``interp`` is the same
    number again.  Keys without any prediction get 0.  ``tie`` orders rows of equal score; it may be a struct.

    ``grid``: thresholds of which ``tp`` says, in an array of booleans, which ones a row is true at; then the result has a
    row for each ``threshold`` too.  Ranks don't depend on the threshold, so rows are not multiplied by the grid.
    """
    if variant not in ("coco", "raw", "interp"):
        raise ValueError(f"unknown variant: {variant}")
    ks, cuts_of = list(keys), range(len(grid) if grid else 1)
    hit = [F.coalesce(F.get("tp", F.lit(i)) if grid else F.col("tp"), F.lit(False)).cast("long") for i in cuts_of]
    # scores are cut into bands, so that no task sorts a whole class; band totals are a small table that carries the sums over
    ws = Workspace(flagged.sparkSession, "ap")
    flagged = ws.save(flagged.select(*ks, "score", "tie", "tp"), "flagged")
    cuts = score_cuts(flagged, "score", parts_for(flagged.count(), 10_000))  # small ranges, so that all cores sort
    banded = flagged.select(*ks, (-band_of(F.col("score"), cuts)).alias("_b"), "score", "tie", *[h.alias(f"_h{i}") for i, h in enumerate(hit)])
    total = banded.groupBy(*ks, "_b").agg(N().alias("_n"), *[F.sum(f"_h{i}").alias(f"_s{i}") for i in cuts_of])
    earlier = Window.partitionBy(*ks).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offset = ws.save(total.select(*ks, "_b", before("_n").alias("_on"), *[before(f"_s{i}").alias(f"_o{i}") for i in cuts_of]), "offset")
    w = Window.partitionBy(*ks, "_b").orderBy(F.desc("score"), "tie")
    run = banded.select(*ks, "_b", F.row_number().over(w).alias("_k"), *[f"_h{i}" for i in cuts_of], *[F.sum(f"_h{i}").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_c{i}") for i in cuts_of])
    run = run.where(" or ".join(f"_h{i} > 0" for i in cuts_of)).join(offset, [*ks, "_b"])
    point = lambda i: F.struct(F.lit(float(grid[i]) if grid else 0.0).alias("threshold"), F.col(f"_h{i}").alias("h"), (F.col(f"_c{i}") + F.col(f"_o{i}")).alias("c"))
    true = run.select(*ks, (F.col("_k") + F.col("_on")).alias("k"), F.explode(F.array(*[point(i) for i in cuts_of])).alias("_x")).where("_x.h > 0")
    by = [*ks, "threshold"] if grid else ks
    best = true.select(*ks, "k", "_x.threshold", "_x.c").join(totals.where("n_true > 0"), by)
    step = F.least(F.floor(F.col("c") / F.col("n_true") * 100 + 1e-9), F.lit(100)).cast("int")
    best = best.groupBy(*by, step.alias("_t")).agg(F.max(F.col("c") / F.col("k")).alias("_p"))
    # the best precision of a step serves the steps from the one reached before it up to its own
    later = F.max("_p").over(Window.partitionBy(*by).orderBy(F.desc("_t")))
    lower = F.coalesce(F.lag("_t").over(Window.partitionBy(*by).orderBy("_t")), F.lit(-1))
    got = best.select(*by, (later * (F.col("_t") - lower)).alias("_a")).groupBy(*by).agg((F.sum("_a") / 101).alias("ap"))
    return totals.where("n_true > 0").join(got, by, "left").select(*by, F.coalesce("ap", F.lit(0.0)).alias("ap"))


def contingency_scores(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and normalised mutual information (arithmetic mean) of two labellings."""
    pair = lambda c: F.sum(c * (c - 1) / 2)
    cells = df.groupBy(a, b).agg(N().alias("n"))
    ra, rb = df.groupBy(a).agg(N().alias("n")), df.groupBy(b).agg(N().alias("n"))
    total = df.agg(N().cast("double").alias("t"))
    h = lambda c, t: -F.sum(c / t * F.ln(c / t))
    joint = cells.crossJoin(F.broadcast(total)).agg(pair(F.col("n")).alias("sab"), h(F.col("n"), F.col("t")).alias("hab"), F.max("t").alias("t"))  # one row
    sa = ra.crossJoin(F.broadcast(total)).agg(pair(F.col("n")).alias("sa"), h(F.col("n"), F.col("t")).alias("ha"))
    sb = rb.crossJoin(F.broadcast(total)).agg(pair(F.col("n")).alias("sb"), h(F.col("n"), F.col("t")).alias("hb"))
    one = joint.crossJoin(sa).crossJoin(sb)  # one row each
    want = F.col("sa") * F.col("sb") / (F.col("t") * (F.col("t") - 1) / 2)
    return one.select(((F.col("sab") - want) / ((F.col("sa") + F.col("sb")) / 2 - want)).alias("ari"), ((F.col("ha") + F.col("hb") - F.col("hab")) / ((F.col("ha") + F.col("hb")) / 2)).alias("nmi"))


def mean_rank(df: DataFrame, c: str, out: str) -> DataFrame:
    """Ranks from 1 with equal values sharing their mean rank, by counts of values; values are sorted by ranges, no task sorts all."""
    counts = df.groupBy(c).agg(N().alias("_n"))
    cuts = score_cuts(df, c, parts_for(df.count()))
    banded = counts.withColumn("_b", F.size(F.filter(F.lit(cuts), lambda x: x <= F.col(c))))
    earlier = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = banded.groupBy("_b").agg(F.sum("_n").alias("_n"))
    off = sizes.select("_b", earlier(Window.orderBy("_b")).alias("_o"))  # one row a range
    before = F.col("_o") + earlier(Window.partitionBy("_b").orderBy(c))
    ranks = banded.join(F.broadcast(off), "_b").select(F.col(c).alias("_c"), (before + (F.col("_n") + 1) / 2).alias(out))
    return df.join(ranks, F.col(c) == F.col("_c")).drop("_c")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    both = mean_rank(mean_rank(df.select(x, y), x, "_rx"), y, "_ry")
    return both.agg(N().alias("n"), F.corr("_rx", "_ry").alias("rho"))


def auc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve by rank sums; equal scores count half."""
    r = mean_rank(df.select(F.col(score).alias("_s"), positive.cast("int").alias("_y")), "_s", "_r")
    s = r.agg(F.sum("_y").cast("double").alias("p"), F.sum(1 - F.col("_y")).cast("double").alias("m"), F.sum(F.col("_r") * F.col("_y")).alias("rs"))
    return s.select(((F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m"))).alias("auc"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """Kruskal-Wallis H, corrected for ties."""
    r = mean_rank(df.select(value, group), value, "_r")
    g = r.groupBy(group).agg(N().cast("double").alias("n"), F.sum("_r").alias("s"))
    ties = df.groupBy(value).agg(N().cast("double").alias("t")).agg(F.sum(F.pow("t", F.lit(3.0)) - F.col("t")).alias("ties"))
    h = g.agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), N().alias("groups")).crossJoin(ties)  # one row each
    raw = 12 / (F.col("n") * (F.col("n") + 1)) * F.col("q") - 3 * (F.col("n") + 1)
    return h.select("groups", (raw / (1 - F.col("ties") / (F.pow("n", F.lit(3.0)) - F.col("n")))).alias("h"))


def link_scores(nodes: DataFrame, keys: Sequence[str], node: str, side: str, pred: str, true: str) -> DataFrame:
    """Precision, recall and F1 of cross-side pairs put together, by counts within groups (no pairs are formed)."""
    def pairs(by: Sequence[str]) -> Column:
        return F.sum("n") * (F.sum("n") - 1) / 2 - F.sum(F.col("n") * (F.col("n") - 1) / 2)

    def total(by: list[str], out: str) -> DataFrame:
        cell = nodes.groupBy(*keys, *by, side).agg(N().cast("double").alias("n"))
        return cell.groupBy(*keys, *by).agg(pairs(by).alias("p")).agg(F.sum("p").alias(out))

    t = total([pred, true], "both").crossJoin(total([pred], "made")).crossJoin(total([true], "real"))  # one row each
    p, r = F.col("both") / F.greatest("made", F.lit(1.0)), F.col("both") / F.greatest("real", F.lit(1.0))
    return t.select("both", "made", "real", p.alias("precision"), r.alias("recall"), (2 * F.col("both") / F.greatest(F.col("made") + F.col("real"), F.lit(1.0))).alias("f1"))
