"""Calibrating counts and thresholds by exhaustive grids over small histograms (GRP-12, 15..17, 20).

Rows are first aggregated to a histogram of (prediction, truth) pairs, whose size depends on the counts' range and not on the
number of rows; the grid is expanded over that histogram only.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def N() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))



def fit_coefficient(cube: DataFrame, by: Sequence[str], grid: Sequence[float]) -> DataFrame:
    """For each key of ``by`` the threshold tau and factor k with the least mean |rint(k n) - y| over (tau, n, y).

    Ties go to the smaller tau, then the smaller k.
    """
    hist = cube.groupBy(*by, "tau", "n", "y").agg(N().alias("w"))
    each = hist.withColumn("k", F.explode(F.lit([float(g) for g in grid])))
    mae = F.sum(F.col("w") * F.abs(F.rint(F.col("k") * F.col("n")) - F.col("y"))) / F.sum("w")
    scored = each.groupBy(*by, "tau", "k").agg(mae.alias("mae"))
    best = scored.groupBy(*by).agg(F.min(F.struct(F.round("mae", 9).alias("e"), "tau", "k")).alias("m"))
    return best.select(*by, "m.tau", "m.k", F.round("m.e", 6).alias("mae"))


def fit_affine(df: DataFrame, by: str, pred: str, true: str, slopes: Sequence[float], shifts: Sequence[float]) -> DataFrame:
    """Slope a and shift b of least mean |max(rint(a x + b), 0) - y|; ties to the slope nearest 1, then the smallest shift."""
    hist = df.groupBy(by, pred, true).agg(N().alias("w"))
    each = hist.withColumn("a", F.explode(F.lit([float(x) for x in slopes]))).withColumn("b", F.explode(F.lit([float(x) for x in shifts])))
    est = F.greatest(F.rint(F.col("a") * F.col(pred) + F.col("b")), F.lit(0.0))
    scored = each.groupBy(by, "a", "b").agg((F.sum(F.col("w") * F.abs(est - F.col(true))) / F.sum("w")).alias("mae"))
    key = F.struct(F.round("mae", 9).alias("e"), F.abs(F.col("a") - 1).alias("da"), F.abs("b").alias("db"), "a", "b")
    return scored.groupBy(by).agg(F.min(key).alias("m")).select(by, "m.a", "m.b", F.round("m.e", 6).alias("mae"))


def forward_blend(df: DataFrame, members: Sequence[str], true: str, most: int, weights: Sequence[float]) -> DataFrame:
    """Greedy blend: start with the best member, add (1-w) blend + w member while that lowers the mean |rint(blend) - y|.

    Each step scores all members and weights in one aggregate over all rows; the result is one row a step.
    """
    error = lambda c: F.avg(F.abs(F.greatest(F.rint(c), F.lit(0.0)) - F.col(true)))
    first = df.agg(*[error(F.col(m)).alias(m) for m in members]).first()
    best = min(members, key=lambda m: (round(first[m], 9), m))
    blend, value, trail = F.col(best), first[best], [(1, best, 1.0, float(first[best]))]
    while len(trail) < most:
        options = [(m, float(w), (1 - w) * blend + w * F.col(m)) for m in members for w in weights]
        row = df.agg(*[error(c).alias(f"o{i}") for i, (_, _, c) in enumerate(options)]).first()
        i = min(range(len(options)), key=lambda i: (round(row[f"o{i}"], 9), i))
        if row[f"o{i}"] >= value - 1e-9:
            break
        value, blend = row[f"o{i}"], options[i][2]
        trail.append((len(trail) + 1, options[i][0], options[i][1], float(value)))
    return df.sparkSession.createDataFrame(trail, "step int, member string, weight double, mae double")


def best_cut_triple(df: DataFrame, value: str, cls: str, grid: Sequence[int] | None = None) -> DataFrame:
    """Cuts a < b < c with most rows whose class equals the number of cuts reached; ties to the smallest a, b, c.

    Without ``grid`` every cut that tells rows apart is tried, and those beside them that put all rows on one side.  A triple's
    hits are differences of the classes' running counts over the grid; only the histogram comes to the driver.
    """
    hist = df.groupBy(value, cls).agg(N().alias("n")).collect()
    known = [(int(r[value]), r[cls], r["n"]) for r in hist if r[value] is not None]
    if grid is None:
        grid = range(min(v for v, _, _ in known) - 2, max(v for v, _, _ in known) + 4) if known else []
    g = np.array(sorted({int(x) for x in grid}), dtype=np.int64)
    below = np.array([[sum(n for v, k, n in known if k == c and v < x) for x in g] for c in range(4)], dtype=np.int64)
    total = sum(n for _, k, n in known if k == 3)
    best = None
    if hist and len(g) >= 3:
        first, third = below[0] - below[1], below[2] - below[3] + total
        for i in range(len(g) - 2):
            hits = first[i] + (below[1] - below[2])[i + 1 : -1, None] + third[None, i + 2 :]
            hits = np.where(np.arange(hits.shape[1])[None] >= np.arange(hits.shape[0])[:, None], hits, -1)
            j, k = np.unravel_index(int(np.argmax(hits)), hits.shape)
            if best is None or hits[j, k] > best[3]:
                best = (int(g[i]), int(g[i + 1 + j]), int(g[i + 2 + k]), int(hits[j, k]))
    return df.sparkSession.createDataFrame([best] if best else [], "a int, b int, c int, hits bigint")


def project_integers(df: DataFrame, key: str, part: str, x: str) -> DataFrame:
    """Whole numbers with the key's rounded total, nearest to x in summed squares: the cheapest steps up from the floors."""
    f = df.select(key, part, F.col(x).alias("x")).withColumn("f", F.floor("x")).withColumn("cost", F.round(1 - 2 * (F.col("x") - F.col("f")), 9))
    total = f.groupBy(key).agg((F.rint(F.round(F.sum("x"), 6)).cast("bigint") - F.sum("f")).alias("need"))
    w = Window.partitionBy(key).orderBy("cost", part)
    return f.join(total, key).select(key, part, (F.col("f") + (F.row_number().over(w) <= F.col("need")).cast("int")).cast("bigint").alias("n"))


def reconcile(df: DataFrame, key: str, pred: str, true: str, betas: Sequence[float]) -> DataFrame:
    """Mean error after sharing a part beta of each key's missing total among its classes in proportion to the prediction."""
    t = df.groupBy(key).agg(F.sum(true).alias("_t"), F.sum(pred).alias("_s"))
    share = F.when(F.col("_s") > 0, F.col(pred) / F.col("_s")).otherwise(0.25)
    each = df.join(t, key).withColumn("beta", F.explode(F.lit([float(b) for b in betas])))
    est = F.col(pred) + F.col("beta") * (F.col("_t") - F.col("_s")) * share
    return each.groupBy("beta").agg(F.round(F.avg(F.abs(est - F.col(true))), 6).alias("mae"))
