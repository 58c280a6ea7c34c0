"""Suppressing and fusing overlapping boxes of an image (GRP-01..05, 18, 19).

Order is always score descending, then the row's id.  ``rows`` are dict-like with x1..y2, score, cls and, where sources matter,
model; all functions are pure and run per image through :func:`grovekit.operators.grouped.per_group`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from grovekit.operators.matching import iou_matrix

OUT = "x1 double, y1 double, x2 double, y2 double, score double, cls int, support int"


def corners(rows: Sequence) -> np.ndarray:
    return np.array([[r["x1"], r["y1"], r["x2"], r["y2"]] for r in rows], dtype=float).reshape(-1, 4)


def by_score(rows: Sequence, tie: str = "det_id") -> list:
    return sorted(rows, key=lambda r: (-r["score"], r[tie]))


def suppress(rows: Sequence, cut: float, by_class: bool = True, tie: str = "det_id") -> list:
    """Rows kept by greedy suppression: a row goes if a better kept one overlaps it by at least ``cut``."""
    rows = by_score(rows, tie)
    ious = iou_matrix(corners(rows), corners(rows))
    kept: list[int] = []
    for i, r in enumerate(rows):
        if all(ious[i, j] < cut or (by_class and rows[j]["cls"] != r["cls"]) for j in kept):
            kept.append(i)
    return [rows[i] for i in kept]


def fuse_running(rows: Sequence, cut: float, models: int, classes: int, weights: Sequence[float] | None = None, tie: str = "det_id") -> list[tuple]:
    """Fusion with running centroids: a row joins the group of best overlap (at least ``cut``), else opens one.

    A centroid is the score- and weight-weighted mean of its members; classes are voted softly.  Score: mean score times
    min(support, models) / models, where support counts different models; with ``weights``, the weighted scores' sum over the
    weights present, times support / models.
    """
    weigh = (lambda r: weights[r["model"]]) if weights else (lambda r: 1.0)
    groups: list[dict] = []
    for r in by_score(rows, tie):
        b, w = corners([r])[0], r["score"] * weigh(r)
        best, at = cut, None
        if groups:
            v = iou_matrix(b[None], np.array([g["box"] for g in groups]))[0]
            k = int(np.argmax(v))
            if v[k] >= best:
                at = groups[k]
        if at is None:
            at = {"sum": np.zeros(4), "w": 0.0, "members": [], "votes": np.zeros(classes)}
            groups.append(at)
        at["sum"] += w * b
        at["w"] += w
        at["votes"][r["cls"]] += w
        at["members"].append(r)
        at["box"] = at["sum"] / at["w"] if at["w"] > 0 else b
    out = []
    for g in groups:
        ms = g["members"]
        seen = {m["model"] for m in ms}
        if weights:
            score = sum(m["score"] * weigh(m) for m in ms) / max(sum(weights[k] for k in seen), 1e-9) * len(seen) / models
        else:
            score = sum(m["score"] for m in ms) / len(ms) * min(len(seen), models) / models
        out.append((*map(float, g["box"]), float(score), int(np.argmax(g["votes"])), len(seen)))
    return out


def fuse_anchored(rows: Sequence, cut: float, models: int, tie: str = "det_id", rule: str = "mean") -> list[tuple]:
    """Fusion with fixed anchors: a row joins the first group of its class whose first member it overlaps by at least ``cut``.

    One vote per model: its best row.  ``rule``: mean (times support / models), max, or the votes' noisy or.
    """
    rows = by_score(rows, tie)
    near = iou_matrix(corners(rows), corners(rows)) >= cut
    members: dict[int, list[int]] = {}
    for i, r in enumerate(rows):
        joined = next((a for a in members if near[i, a] and rows[a]["cls"] == r["cls"]), i)
        members.setdefault(joined, []).append(i)
    groups = [[rows[i] for i in m] for m in members.values()]
    out = []
    for g in groups:
        best: dict = {}
        for r in g:
            best.setdefault(r["model"], r)
        votes = list(best.values())
        w = np.array([v["score"] for v in votes])
        box = corners(votes) * w[:, None]
        box = box.sum(0) / w.sum() if w.sum() > 0 else corners(g)[0]
        score = {"mean": w.mean() * len(votes) / models, "max": w.max(), "noisy_or": 1 - np.prod(1 - np.minimum(w, 0.999999))}[rule]
        out.append((*map(float, box), float(score), int(g[0]["cls"]), len(votes)))
    return out


def fuse_two_stage(rows: Sequence, inner: float, outer: float, models: int, classes: int, agnostic: Sequence[int] = (), tie: str = "det_id") -> list[tuple]:
    """Collapse within each source first, then fuse sources with at most one proposal of a source in a cluster.

    Sources in ``agnostic`` support a box but give no evidence of its class.
    """
    first = []
    for m in sorted({r["model"] for r in rows}):
        for i, (x1, y1, x2, y2, s, c, _) in enumerate(fuse_running([r for r in rows if r["model"] == m], inner, 1, classes, tie=tie)):
            first.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "score": s, "cls": c, "model": m, "k": i})
    groups: list[dict] = []
    for r in sorted(first, key=lambda r: (-r["score"], r["model"], r["k"])):
        fit = [(float(iou_matrix(corners([r]), g["box"][None])[0, 0]), -i) for i, g in enumerate(groups) if r["model"] not in g["from"]]
        best = max(fit, default=(0.0, 0))
        if best[0] >= outer:
            g = groups[-best[1]]
        else:
            g = {"from": set(), "rows": [], "box": None}
            groups.append(g)
        g["from"].add(r["model"])
        g["rows"].append(r)
        w = np.array([max(x["score"], 1e-9) for x in g["rows"]])
        g["box"] = (corners(g["rows"]) * w[:, None]).sum(0) / w.sum()
    out = []
    for g in groups:
        votes = np.zeros(classes)
        for r in g["rows"]:
            if r["model"] not in agnostic:
                votes[r["cls"]] += r["score"]
        out.append((*map(float, g["box"]), float(sum(r["score"] for r in g["rows"]) / models), int(np.argmax(votes)) if votes.any() else -1, len(g["from"])))
    return out


def merge_twins(rows: Sequence, twin: float, cut: float, classes: int, tie: str = "det_id") -> list[tuple]:
    """Boxes of different classes that all but coincide (at least ``twin``) become one with shared class votes; then suppression."""
    rows, used, merged = by_score(rows, tie), set(), []
    ious = iou_matrix(corners(rows), corners(rows))
    for i, r in enumerate(rows):
        if i in used:
            continue
        group = [i] + [j for j in range(i + 1, len(rows)) if j not in used and rows[j]["cls"] != r["cls"] and ious[i, j] >= twin]
        used.update(group)
        votes = np.zeros(classes)
        for j in group:
            votes[rows[j]["cls"]] += rows[j]["score"]
        merged.append({"x1": r["x1"], "y1": r["y1"], "x2": r["x2"], "y2": r["y2"], "score": r["score"], "cls": int(np.argmax(votes)), "k": len(merged), "support": len(group)})
    return [(r["x1"], r["y1"], r["x2"], r["y2"], r["score"], r["cls"], r["support"]) for r in suppress(merged, cut, by_class=False, tie="k")]


def collapse_classes(rows: Sequence, cut: float, tie: str = "det_id") -> list[tuple]:
    """One box for each place regardless of class, keeping for every class the best score seen there: (det_id, cls, score)."""
    rows = by_score(rows, tie)
    near = iou_matrix(corners(rows), corners(rows)) >= cut
    members: dict[int, list[int]] = {}
    for i in range(len(rows)):
        members.setdefault(next((a for a in members if near[i, a]), i), []).append(i)
    groups = [[rows[i] for i in m] for m in members.values()]
    out = []
    for g in groups:
        best: dict[int, float] = {}
        for r in g:
            best[r["cls"]] = max(best.get(r["cls"], 0.0), r["score"])
        out += [(g[0][tie], int(c), float(s)) for c, s in sorted(best.items())]
    return out
