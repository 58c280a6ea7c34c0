"""Spatial and one-to-one joins of boxes (JON-04..12).

Pairs are formed by an equi-join on the image (and class, side …) with the overlap as residual condition, so the optimiser picks a
hash or sort-merge join and an image's boxes never leave their partition.  :func:`theta_join` can add a grid cell to the key
for images with very many boxes.  The order-dependent matches run per image in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grovekit.functions.boxes import CORNERS, Box, box, intersection, iou


def _right(b: DataFrame, keys: Sequence[str], ident: str, extra: Sequence[str] = ()) -> DataFrame:
    return b.select(*keys, ident, *[F.col(c).alias(f"b_{c}") for c in (*CORNERS, *extra)])


def theta_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str, least: float, eps: float = 1e-9, cell: float | None = None, how: str = "inner", extra: Sequence[str] = ()) -> DataFrame:
    """All pairs with equal keys and IoU of at least ``least`` (> 0), with their ``iou``.

    ``cell``: edge of grid cells; each box is listed under the cells it covers and a pair is kept in the first common one, which
    bounds the pairs looked at for crowded images.
    """
    left, right = a, _right(b, keys, b_id, extra)
    v = iou(box(), box("b_"), eps)
    if cell is None:
        pairs = left.join(right, list(keys), how)
        if how == "inner":
            return pairs.withColumn("iou", v).where(F.col("iou") >= least)
        hit = v >= least
        r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        cond = hit
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_{k}"))
        return left.join(r, cond, how).drop(*[f"_{k}" for k in keys]).withColumn("iou", F.when(F.col(b_id).isNotNull(), v))

    def cells(x: Box, name: str) -> list[Column]:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(lo / cell).cast("int"), F.floor(hi / cell).cast("int")))
        return [span(x.x1, x.x2).alias("_gx"), span(x.y1, x.y2).alias("_gy")]

    lg = left.select("*", cells(box(), "")[0]).select("*", cells(box(), "")[1])
    rg = right.select("*", cells(box("b_"), "")[0]).select("*", cells(box("b_"), "")[1])
    first = (F.col("_gx") == F.floor(F.greatest("x1", "b_x1") / cell)) & (F.col("_gy") == F.floor(F.greatest("y1", "b_y1") / cell))
    return lg.join(rg, [*keys, "_gx", "_gy"]).where(first).drop("_gx", "_gy").withColumn("iou", v).where(F.col("iou") >= least)


def nearest_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str, least: float) -> DataFrame:
    """Each left row with the one right row of largest IoU, at least ``least``; of equal ones the smallest id."""
    pairs = theta_join(a, b, keys, a_id, b_id, least)
    w = Window.partitionBy(*keys, a_id).orderBy(F.desc("iou"), b_id)
    return pairs.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def contained(a: DataFrame, b: DataFrame, keys: Sequence[str], a_id: str, b_id: str) -> DataFrame:
    """Pairs where the centre of the left box lies inside the right one, with their IoU."""
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    inside = cx.between(F.col("b_x1"), F.col("b_x2")) & cy.between(F.col("b_y1"), F.col("b_y2"))
    return a.join(_right(b, keys, b_id), list(keys)).where(inside).withColumn("iou", iou(box(), box("b_")))


def overlap_area(a: Box, b: Box) -> Column:
    return intersection(a, b)


def iou_matrix(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> np.ndarray:
    """IoU of every row of ``a`` with every row of ``b`` (corners)."""
    lo = np.maximum(a[:, None, :2], b[None, :, :2])
    hi = np.minimum(a[:, None, 2:], b[None, :, 2:])
    inter = np.clip(hi - lo, 0, None).prod(axis=2)
    size = lambda x: np.clip(x[:, 2:4] - x[:, :2], 0, None).prod(axis=1)
    return inter / np.maximum(size(a)[:, None] + size(b)[None, :] - inter, eps)


def greedy(ious: np.ndarray, least: float) -> np.ndarray:
    """Rows in order each take their best column still free with at least ``least``; of equal ones the last; -1: none."""
    out = np.full(len(ious), -1)
    free = np.ones(ious.shape[1], dtype=bool)
    for i, row in enumerate(ious):
        open_ = np.flatnonzero(free & (row >= least))
        if len(open_):
            best = row[open_].max()
            j = open_[np.flatnonzero(row[open_] == best)[-1]]
            out[i], free[j] = j, False
    return out


def assignment(weight: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one assignment of largest total weight (-1: none, for more rows than columns).

    Shortest augmenting paths with potentials, cubic in the smaller side.
    """
    n, m = weight.shape
    if n == 0 or m == 0:
        return np.full(n, -1)
    if n > m:
        back = assignment(weight.T)
        out = np.full(n, -1)
        out[back[back >= 0]] = np.flatnonzero(back >= 0)
        return out
    cost = weight.max() - weight
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, seen, came = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            seen[j0] = True
            row = owner[j0]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~seen[1:] & (slack < least[1:])
            least[1:][better] = slack[better]
            came[1:][better] = j0
            j1 = 1 + int(np.argmin(np.where(seen[1:], np.inf, least[1:])))
            delta = least[j1]
            u[owner[seen]] += delta
            v[seen] -= delta
            least[~seen] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[came[j0]]
            j0 = came[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def _packed(df: DataFrame, keys: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """One row per key with an ordered array of structs: an image's boxes, bounded by the image."""
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))


def _corners(items) -> np.ndarray:
    return np.array([[r[c] for c in CORNERS] for r in items], dtype=float).reshape(-1, 4)


def match_one_to_one(pred: DataFrame, truth: DataFrame, keys: Sequence[str], least: float | Sequence[float] = 0.5, method: str = "greedy", cap: int | None = None) -> DataFrame:
    """(keys, threshold, det_id, gt_id, iou): predictions (keys, det_id, score, corners) matched to truths (keys, gt_id, corners).

    ``greedy``: by falling score (then det_id), each takes the best free truth of at least the threshold; ``optimal``: the
    one-to-one pairing of largest total IoU, of which pairs below the threshold are dropped afterwards.  All thresholds come
    from one pass.  ``cap``: only that many best predictions of a key take part.  Unmatched rows are left out.
    """
    cuts = [least] if isinstance(least, int | float) else list(least)
    if method == "greedy" and cap is None:
        return _match_greedy(pred, truth, keys, cuts)
    p = _packed(pred.withColumn("_neg", -F.col("score")), keys, ["_neg", "det_id", *CORNERS], "p")
    t = _packed(truth, keys, ["gt_id", *CORNERS], "t")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema if f.name in keys)

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                ps, ts = list(r["p"])[:cap], list(r["t"])
                m = iou_matrix(_corners(ps), _corners(ts))
                best = assignment(m) if method == "optimal" else None
                for cut in cuts:
                    to = greedy(m, cut) if best is None else np.where((best >= 0) & (m[np.arange(len(m)), best] >= cut), best, -1)
                    rows += [(*[r[k] for k in keys], cut, ps[i]["det_id"], ts[j]["gt_id"], float(m[i, j])) for i, j in enumerate(to) if j >= 0]
            yield pd.DataFrame(rows, columns=[*keys, "threshold", "det_id", "gt_id", "iou"])

    return p.join(t, list(keys)).mapInPandas(run, f"{kinds}, threshold double, det_id bigint, gt_id bigint, iou double")


def _match_greedy(pred: DataFrame, truth: DataFrame, keys: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """Greedy matches from the pairs of an equi-join that reach the least threshold; others never match nor hinder a match.

    A key's pairs stream by in the order in which they are offered: predictions by falling score, each one's truths by falling
    IoU.  A pair is taken if both are free.
    """
    p = pred.select(*keys, (-F.col("score")).alias("_neg"), "det_id", *CORNERS, F.monotonically_increasing_id().alias("_p"))
    t = _right(truth.withColumn("_t", F.monotonically_increasing_id()), keys, "gt_id", ["_t"])
    pairs = p.join(t, list(keys)).withColumn("iou", iou(box(), box("b_"))).where((F.col("iou") >= min(cuts)) & ~F.isnan("iou"))
    offered = [*keys, "_neg", "det_id", *CORNERS, "_p", F.desc("iou"), F.desc("gt_id"), *[F.desc(f"b_{c}") for c in CORNERS], F.desc("b__t")]
    pairs = pairs.repartition(*keys).sortWithinPartitions(*offered).select(*keys, "_p", "b__t", "det_id", "gt_id", "iou")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name in keys)

    def run(batches):
        last, state = None, []
        for pdf in batches:
            if not len(pdf):
                continue
            key = [pdf[k].to_numpy() for k in keys]
            fresh = np.r_[tuple(k[0] for k in key) != last, np.any([k[1:] != k[:-1] for k in key], axis=0)]
            last = tuple(k[-1] for k in key)
            at, cut_of = [], []
            for i, (new, a, b, v) in enumerate(zip(fresh.tolist(), pdf["_p"].tolist(), pdf["b__t"].tolist(), pdf["iou"].tolist(), strict=True)):
                if new:
                    state = [(c, set(), set()) for c in cuts]
                for c, used, taken in state:
                    if v >= c and a not in used and b not in taken:
                        used.add(a)
                        taken.add(b)
                        at.append(i)
                        cut_of.append(c)
            out = pdf.iloc[at]
            yield out[list(keys)].assign(threshold=np.array(cut_of, dtype=float), det_id=out["det_id"], gt_id=out["gt_id"], iou=out["iou"])

    return pairs.mapInPandas(run, f"{kinds}, threshold double, det_id bigint, gt_id bigint, iou double")


def group_weight(members: DataFrame, others: DataFrame, keys: Sequence[str], group: str, other_group: str, m_id: str, o_id: str) -> DataFrame:
    """(group, other_group, weight): largest IoU of any member with any member of the other group in the same place."""
    pairs = theta_join(members, others, keys, m_id, o_id, 1e-12, extra=[other_group])
    return pairs.groupBy(*[k for k in keys if k == "tree"], group, F.col(f"b_{other_group}").alias(other_group)).agg(F.max("iou").alias("weight"))
