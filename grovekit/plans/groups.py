"""Queries of the order-dependent operators and of calibration grids (GRP)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from grovekit.functions import vectors as V
from grovekit.operators import aggregates as A
from grovekit.operators import calibration as C
from grovekit.operators import fusion, linking, models
from grovekit.operators.components import min_label
from grovekit.operators.grouped import per_batch, per_group
from grovekit.plans.aggregates import PT_SQL, TAU_SQL, TAUS, pred_true
from grovekit.plans.registry import Registry
from grovekit.plans.roles import P_SQL, det, gt, iou_sql, probs, sql
from grovekit.scale import Workspace, read


def N() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))

FIELDS = ["det_id", "x1", "y1", "x2", "y2", "score", "cls", "model"]


def _r(c, n: int = 6):
    return F.round(c, n)


def register(reg: Registry) -> None:
    q = reg.query

    def boxes(s, d):
        return det(s, d).select("stem", *FIELDS)

    def tree_boxes(s, d):
        return det(s, d).where("score >= 0.3").select("tree", "side", *FIELDS)

    nms_sql = """, r AS (SELECT *, row_number() OVER (PARTITION BY stem, cls ORDER BY score DESC, det_id) AS k FROM det),
      s AS (SELECT stem, cls, CAST(1 AS BIGINT) AS k, [det_id] AS kept FROM r WHERE k = 1
        UNION ALL SELECT s.stem, s.cls, r.k, CASE WHEN EXISTS (SELECT 1 FROM r b WHERE b.stem=s.stem AND b.cls=s.cls AND list_contains(s.kept, b.det_id) AND {iou} >= 0.3) THEN kept ELSE list_append(kept, r.det_id) END FROM s JOIN r ON r.stem=s.stem AND r.cls=s.cls AND r.k=s.k+1)
      SELECT stem, cls, unnest(kept) AS det_id FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY stem, cls ORDER BY k DESC)=1)"""

    @q("grp_01_nms", sql(nms_sql.replace("{iou}", iou_sql("r", "b"))))
    def grp_01(s, d):
        return per_group(boxes(s, d), ["stem", "cls"], ["det_id"], [f for f in FIELDS if f != "cls"], lambda rows: [(r["det_id"],) for r in fusion.suppress(rows, 0.3, by_class=False)], "det_id bigint")

    @q("grp_01_nms_agnostic")
    def grp_01a(s, d):
        return per_group(boxes(s, d), ["stem"], ["det_id"], FIELDS, lambda rows: [(r["det_id"],) for r in fusion.suppress(rows, 0.3, by_class=False)], "det_id bigint")

    @q("grp_02_wbf_running")
    def grp_02(s, d):
        return per_group(boxes(s, d), ["stem"], ["det_id"], FIELDS, lambda rows: fusion.fuse_running(rows, 0.5, 3, 4), fusion.OUT)

    @q("grp_02_wbf_weighted")
    def grp_02w(s, d):
        return per_group(boxes(s, d), ["stem"], ["det_id"], FIELDS, lambda rows: fusion.fuse_running(rows, 0.5, 3, 4, [1.0, 0.8, 0.6]), fusion.OUT)

    @q("grp_03_wbf_anchor")
    def grp_03(s, d):
        return per_group(boxes(s, d), ["stem"], ["det_id"], FIELDS, lambda rows: fusion.fuse_anchored(rows, 0.5, 3), fusion.OUT)

    @q("grp_04_two_stage")
    def grp_04(s, d):
        return per_group(boxes(s, d), ["stem"], ["det_id"], FIELDS, lambda rows: fusion.fuse_two_stage(rows, 0.6, 0.5, 3, 4, agnostic=(2,)), fusion.OUT)

    @q("grp_05_twins")
    def grp_05(s, d):
        return per_group(boxes(s, d), ["stem"], ["det_id"], FIELDS, lambda rows: fusion.merge_twins(rows, 0.9, 0.6, 4), fusion.OUT)

    def link(fn):
        def run(rows):
            sides, w = linking.view_weights(rows)
            return [(r["det_id"], rows[g]["det_id"]) for r, g in zip(rows, fn(sides, w), strict=True)]
        return run

    def linked(s, d, fn):
        return per_group(tree_boxes(s, d), ["tree"], ["side", "det_id"], ["side", *FIELDS], link(fn), "det_id bigint, cluster bigint")

    def dense(c, start, n):
        """Chunks of trees with their nodes' rows, sides and pair weights as tables."""
        cy, h = (c["y1"] + c["y2"]) / 2, c["y2"] - c["y1"]
        for trees, at, ok in linking.dense_trees(start, n):
            yield trees, at, ok, c["side"][at], linking.dense_weights(c["side"][at], cy[at], h[at], c["cls"][at], ok)

    @q("grp_06_union_find")
    def grp_06(s, d):
        return linked(s, d, lambda sides, w: linking.union_find(sides, linking.weight_edges(w), linking.size_cap(4), 0.3))

    @q("grp_06_stop_at_count")
    def grp_06s(s, d):
        return linked(s, d, lambda sides, w: linking.union_find(sides, linking.weight_edges(w), 3, stop_at=max(1, len(sides) // 2)))

    @q("grp_07_assignment_grid")
    def grp_07(s, d):
        def run(rows):
            sides, w = linking.view_weights(rows)
            return [(c, r["det_id"], rows[g]["det_id"]) for c, label in linking.assignment_grid(sides, w, [0.2, 0.4, 0.6, 0.8], 3) for r, g in zip(rows, label, strict=True)]
        return per_group(tree_boxes(s, d), ["tree"], ["side", "det_id"], ["side", *FIELDS], run, "cut double, det_id bigint, cluster bigint")

    @q("grp_08_agglomerative")
    def grp_08(s, d):
        def run(c, start, n):
            group, cluster = np.repeat(np.arange(len(n)), n), np.empty(n.sum(), dtype=np.int64)
            for _, at, ok, side, w in dense(c, start, n):
                label = linking.agglomerate_many(side, w, ok, 0.4, 3)
                cluster[at[ok]] = np.take_along_axis(at, label, axis=1)[ok]
            return group, [c["det_id"], c["det_id"][cluster]]
        return per_batch(tree_boxes(s, d), ["tree"], ["side", "det_id"], ["side", *FIELDS], run, "det_id bigint, cluster bigint")

    def gain(w):
        return np.where(w > 0, np.log(np.clip(w, 1e-6, 1 - 1e-6) / (1 - np.clip(w, 1e-6, 1 - 1e-6))), -20.0)

    def linked_checked(s, d, fn):
        def run(rows):
            sides, w = linking.view_weights(rows)
            return [(r["det_id"], rows[g]["det_id"], x) for r, g, x in zip(rows, *fn(sides, gain(w)), strict=True)]
        return per_group(tree_boxes(s, d), ["tree"], ["side", "det_id"], ["side", *FIELDS], run, "det_id bigint, cluster bigint, exact boolean")

    @q("grp_09_clique_partition")
    def grp_09(s, d):
        return linked_checked(s, d, lambda sides, g: linking.cliques_checked(sides, g, 3))

    @q("grp_10_set_partition")
    def grp_10(s, d):
        return linked_checked(s, d, lambda sides, g: linking.sets_checked(sides, g, 4))

    @q("grp_11_components", "WITH e AS (SELECT DISTINCT tree_id, least(side_i*1000000+i, side_j*1000000+j) AS a, greatest(side_i*1000000+i, side_j*1000000+j) AS b FROM edges WHERE i IS NOT NULL AND j IS NOT NULL AND score >= 0.9), sym AS (SELECT tree_id, a, b FROM e UNION SELECT tree_id, b, a FROM e), seed AS (SELECT * FROM sym) SELECT tree_id, a AS node, min(w) AS label FROM (WITH RECURSIVE reach AS (SELECT tree_id, a, b AS w FROM seed UNION SELECT tree_id, a, a FROM seed UNION SELECT r.tree_id, r.a, s.b FROM reach r JOIN seed s ON s.tree_id=r.tree_id AND s.a=r.w) SELECT * FROM reach) GROUP BY ALL")
    def grp_11(s, d):
        e = read(s, d, "edges").where("i is not null and j is not null and score >= 0.9")
        node = lambda a, b: F.col(a).cast("bigint") * 1000000 + F.col(b)
        return min_label(e.select("tree_id", node("side_i", "i").alias("a"), node("side_j", "j").alias("b")), ["tree_id"], Workspace(s, "cc"))

    proj = sql(PT_SQL + """, m AS (SELECT tree, cls, x, floor(x) AS f, x-floor(x) AS r FROM (SELECT tree, cls, pred*1.1+0.3 AS x FROM pt)), t AS (SELECT tree, CAST(round_even(round(sum(x),6),0) AS BIGINT) - CAST(sum(f) AS BIGINT) AS need FROM m GROUP BY tree)
      SELECT tree, cls, CAST(f + CAST(row_number() OVER (PARTITION BY tree ORDER BY round(1-2*r,9), cls) <= need AS INT) AS BIGINT) AS n FROM m JOIN t USING (tree)""")
    @q("grp_12_integer_projection", proj)
    def grp_12(s, d):
        x = pred_true(s, d).select("tree", "cls", (F.col("pred") * 1.1 + 0.3).alias("x"))
        return C.project_integers(x, "tree", "cls", "x")

    @q("grp_13_quota_assignment")
    def grp_13(s, d):
        rows = probs(det(s, d)).where("score >= 0.3").select("tree", "stem", "det_id", "cls", "p")

        def run(g):
            quota = np.bincount([min(r["cls"] + (i % 7 == 0), 3) for i, r in enumerate(g)], minlength=4)
            return [(r["stem"], r["det_id"], int(c)) for r, c in zip(g, linking.quota_assignment(np.array([list(r["p"]) for r in g]), quota), strict=True)]
        return per_group(rows, ["tree"], ["stem", "det_id"], ["cls", "p"], run, "stem bigint, det_id bigint, quota_cls int")

    @q("grp_14_monotone")
    def grp_14(s, d):
        rows = probs(det(s, d)).where("score >= 0.5").select("stem", "y1", "det_id", "p")
        return per_group(rows, ["stem"], ["y1", "det_id"], ["p"], lambda g: [(r["det_id"], c) for r, c in zip(g, linking.monotone_classes(np.array([list(r["p"]) for r in g]), 0.9), strict=True)], "det_id bigint, mono_cls int")

    ords = f""", h AS (SELECT cls, CAST(floor((p[2]+2*p[3]+3*p[4])*20) AS INTEGER) AS b, count(*) AS n FROM (SELECT cls, {P_SQL} AS p FROM det) GROUP BY ALL), g AS (SELECT CAST(k*5 AS INTEGER) AS c FROM range(1,12) r(k)),
      tr AS (SELECT a.c AS a, b.c AS b, c.c AS c FROM g a, g b, g c WHERE a.c < b.c AND b.c < c.c)
      SELECT tr.a, tr.b, tr.c, CAST(sum(n) FILTER (cls = CAST(h.b>=tr.a AS INT)+CAST(h.b>=tr.b AS INT)+CAST(h.b>=tr.c AS INT)) AS BIGINT) AS hits FROM tr, h GROUP BY ALL ORDER BY hits DESC, a, b, c LIMIT 1"""
    @q("grp_15_threshold_triple", sql(ords))
    def grp_15(s, d):
        g = probs(det(s, d)).select("cls", F.floor(V.expectation(F.col("p")) * 20).cast("int").alias("b"))
        return C.best_cut_triple(g, "b", "cls", [k * 5 for k in range(1, 12)])

    @q("grp_15_threshold_triple_full")
    def grp_15f(s, d):
        g = probs(det(s, d)).select("cls", F.floor(V.expectation(F.col("p")) * 20).cast("int").alias("b"))
        return C.best_cut_triple(g, "b", "cls", range(2, 60))  # 0.10 to 2.95 in steps of 0.05

    cal = sql(f""", n AS (SELECT tree, k AS cls, tau, count(*) FILTER (d.cls=k AND score >= tau) AS n FROM det d, range(4) r(k), {TAU_SQL} GROUP BY ALL), y AS (SELECT tree, k AS cls, count(*) FILTER (g.cls=k) AS y FROM gt g, range(4) r(k) GROUP BY ALL),
      ks AS (SELECT CAST(x AS DOUBLE)/100 AS k FROM range(20,301) r(x)), hist AS (SELECT cls, tau, n, y, count(*) AS w FROM y JOIN n USING (tree, cls) GROUP BY ALL),
      m AS (SELECT cls, tau, k, sum(w*abs(round_even(k*n,0)-y))/sum(w) AS mae FROM hist, ks GROUP BY ALL) SELECT CAST(cls AS INTEGER) AS cls, tau, k, round(mae,6) AS mae FROM m QUALIFY row_number() OVER (PARTITION BY cls ORDER BY round(mae,9), tau, k)=1""")

    def cube(s, d):
        n = det(s, d).groupBy("tree").agg(*[F.count_if((F.col("cls") == k) & (F.col("score") >= t)).alias(f"n_{k}_{i}") for k in range(4) for i, t in enumerate(TAUS)])
        y = A.class_counts(gt(s, d), ["tree"], "cls", 4).withColumnRenamed("n", "y")
        flat = F.explode(F.array(*[F.struct(F.lit(k).alias("cls"), F.lit(t).alias("tau"), F.col(f"n_{k}_{i}").alias("n")) for k in range(4) for i, t in enumerate(TAUS)]))
        return y.join(n.select("tree", flat.alias("_c")).select("tree", "_c.*"), ["tree", "cls"])

    @q("grp_16_calibration", cal)
    def grp_16(s, d):
        return C.fit_coefficient(cube(s, d), ["cls"], [k / 100 for k in range(20, 301)])

    @q("grp_16_calibration_global", cal.replace("CAST(cls AS INTEGER) AS cls, tau", "tau").replace("SELECT cls, tau, k, sum", "SELECT tau, k, sum").replace("PARTITION BY cls ORDER", "ORDER"))
    def grp_16g(s, d):
        return C.fit_coefficient(cube(s, d), [], [k / 100 for k in range(20, 301)])

    aff = sql(PT_SQL + """, hh AS (SELECT cls, pred, true_, count(*) AS w FROM pt GROUP BY ALL), ga AS (SELECT CAST(x AS DOUBLE)/20 AS a FROM range(16,25) r(x)), gb AS (SELECT CAST(x AS DOUBLE)/4 AS b FROM range(-6,7) r(x)),
      m AS (SELECT cls, a, b, sum(w*abs(greatest(round_even(a*pred+b,0),0)-true_))/sum(w) AS mae FROM hh, ga, gb GROUP BY ALL) SELECT cls, a, b, round(mae,6) AS mae FROM m QUALIFY row_number() OVER (PARTITION BY cls ORDER BY round(mae,9), abs(a-1), abs(b), a, b)=1""")
    @q("grp_17_affine", aff)
    def grp_17(s, d):
        return C.fit_affine(pred_true(s, d), "cls", "pred", "true", [k / 20 for k in range(16, 25)], [k / 4 for k in range(-6, 7)])

    @q("grp_17_affine_full")
    def grp_17f(s, d):
        return C.fit_affine(pred_true(s, d), "cls", "pred", "true", [k / 40 for k in range(32, 49)], [k / 20 for k in range(-30, 31)])

    @q("grp_17_forward_blend")
    def grp_17b(s, d):
        wide = A.class_counts(gt(s, d), ["tree"], "cls", 4).withColumnRenamed("n", "y")
        for m in range(3):
            c = A.class_counts(det(s, d).where(f"model = {m}"), ["tree"], "cls", 4).select("tree", "cls", (F.col("n") * 1.3).alias(f"m{m}"))
            wide = wide.join(c, ["tree", "cls"], "left").withColumn(f"m{m}", F.coalesce(f"m{m}", F.lit(0.0)))
        return C.forward_blend(wide, ["m0", "m1", "m2"], "y", 4, [k / 20 for k in range(2, 11)])

    @q("grp_18_propagation", sql("SELECT stem, det_id, round(0.6*score + 0.4*pow(avg(score) OVER w, 0.5)*pow(max(score) OVER w, 1.0),6) AS score FROM det WINDOW w AS (PARTITION BY tree, cls)"))
    def grp_18(s, d):
        g = det(s, d).groupBy("tree", "cls").agg(F.avg("score").alias("obj"), F.max("score").alias("best"))
        v = 0.6 * F.col("score") + 0.4 * F.pow("obj", F.lit(0.5)) * F.pow("best", F.lit(1.0))
        return det(s, d).join(g, ["tree", "cls"]).select("stem", "det_id", _r(v).alias("score"))

    @q("grp_19_collapse")
    def grp_19(s, d):
        return per_group(boxes(s, d), ["stem"], ["det_id"], FIELDS, lambda rows: fusion.collapse_classes(rows, 0.5), "det_id bigint, cls int, score double")

    @q("grp_19_hypotheses", sql(f", pv AS (SELECT stem, det_id, {P_SQL} AS p FROM det), u AS (SELECT stem, det_id, unnest(range(4)) AS k, unnest(p) AS v FROM pv) SELECT stem, det_id, CAST(k AS INTEGER) AS cls, round(v,6) AS score FROM u QUALIFY row_number() OVER (PARTITION BY stem, det_id ORDER BY v DESC, k) <= 2"))
    def grp_19h(s, d):
        ranked = F.slice(F.array_sort(F.transform("p", lambda x, i: F.struct((-x).alias("neg"), i.alias("cls")))), 1, 2)
        return probs(det(s, d)).select("stem", "det_id", F.explode(ranked).alias("h")).select("stem", "det_id", F.col("h.cls").alias("cls"), _r(-F.col("h.neg")).alias("score"))

    rec = sql(PT_SQL + ", t AS (SELECT tree, sum(true_) AS total, sum(pred) AS s FROM pt GROUP BY tree) SELECT beta, round(avg(abs(pred + beta*(total-s)*CASE WHEN s>0 THEN CAST(pred AS DOUBLE)/s ELSE 0.25 END - true_)),6) AS mae FROM pt JOIN t USING (tree), (SELECT CAST(x AS DOUBLE)/4 AS beta FROM range(0,5) r(x)) GROUP BY beta")
    @q("grp_20_reconciliation", rec)
    def grp_20(s, d):
        return C.reconcile(pred_true(s, d), "tree", "pred", "true", [k / 4 for k in range(5)])

    @q("grp_21_z_buffer", sql("SELECT CAST(floor(x1*0.1) AS INTEGER) AS u, CAST(floor(y1*0.1) AS INTEGER) AS v, min(score) AS z FROM det GROUP BY ALL"))
    def grp_21(s, d):
        return det(s, d).groupBy(F.floor(F.col("x1") * 0.1).cast("int").alias("u"), F.floor(F.col("y1") * 0.1).cast("int").alias("v")).agg(F.min("score").alias("z"))

    bias = sql(f""", pv AS (SELECT cls, {P_SQL} AS p FROM det), b AS (SELECT CAST(x AS DOUBLE)/10 AS b1, CAST(y AS DOUBLE)/10 AS b2 FROM range(-2,3) r(x), range(-2,3) t(y)),
      s AS (SELECT b1, b2, (cls+1)%4 AS t, [ln(greatest(p[1],1e-9)), ln(greatest(p[2],1e-9))+b1, ln(greatest(p[3],1e-9))+b2, ln(greatest(p[4],1e-9))] AS z FROM pv, b)
      SELECT b1, b2, count(*) FILTER (list_position(z, list_max(z))-1 = t) AS hits FROM s GROUP BY ALL""")
    @q("grp_22_bias_grid", bias)
    def grp_22(s, d):
        grid = F.explode(F.array(*[F.struct(F.lit(x / 10).alias("b1"), F.lit(y / 10).alias("b2")) for x in range(-2, 3) for y in range(-2, 3)]))
        lg = F.transform("p", lambda x: F.ln(F.greatest(x, F.lit(1e-9))))
        z = F.array(F.get(lg, F.lit(0)), F.get(lg, F.lit(1)) + F.col("g.b1"), F.get(lg, F.lit(2)) + F.col("g.b2"), F.get(lg, F.lit(3)))
        return probs(det(s, d)).withColumn("g", grid).groupBy("g.b1", "g.b2").agg(F.count_if(V.argmax(z) == (F.col("cls") + 1) % 4).alias("hits"))

    @q("grp_23_policy")
    def grp_23(s, d):
        """Which of two linkers a tree gets: both link every tree; on the trees of four folds a logistic model learns from a tree's
        features where agglomeration makes the better pairs (by F1 against the known bunches); it decides for all trees."""
        truth = gt(s, d).select("stem", F.col("gt_id").alias("det_id"), "bunch")
        rows = tree_boxes(s, d).withColumn("stem", F.col("tree") * 4 + F.col("side")).join(truth, ["stem", "det_id"], "left")

        def run(c, start, n):
            known, out = ~pd.isna(c["bunch"]), np.empty((5, len(n)))
            for trees, at, ok, side, w in dense(c, start, n):
                upper = np.triu(np.ones(w.shape[1:], dtype=bool), 1)
                both = known[at] & ok
                judged = upper & both[:, :, None] & both[:, None, :] & (side[:, :, None] != side[:, None, :])
                same = judged & (c["bunch"][at][:, :, None] == c["bunch"][at][:, None, :])
                pairs, size = np.maximum(n[trees] * (n[trees] - 1) / 2, 1), n[trees]
                out[:3, trees] = size, (w * upper).sum(axis=(1, 2)) / pairs, ((w > 0.4) & upper).sum(axis=(1, 2)) / pairs
                for k, label in ((3, linking.union_find_many(side, w, ok, 0.3, 3)), (4, linking.agglomerate_many(side, w, ok, 0.4, 3))):
                    made = judged & (label[:, :, None] == label[:, None, :])
                    hit, either = (made & same).sum(axis=(1, 2)), made.sum(axis=(1, 2)) + same.sum(axis=(1, 2))
                    out[k, trees] = np.divide(2.0 * hit, either, out=np.zeros(len(trees)), where=either > 0)
            return np.arange(len(n)), list(out)

        cols = ["n", "mean_weight", "close_share"]
        seen = Workspace(s, "policy").save(per_batch(rows, ["tree"], ["side", "det_id"], ["side", "bunch", *FIELDS], run, "n double, mean_weight double, close_share double, f_union double, f_agglo double").withColumn("better", (F.col("f_agglo") > F.col("f_union")).cast("int")), "seen")
        b, w = models.logistic(seen.where("tree % 5 <> 0 and f_union <> f_agglo"), cols, "better")
        p = models.predict(cols, b, w)
        return seen.select("tree", F.when(p > 0, "agglomerative").otherwise("union_find").alias("linker"), _r(F.when(p > 0, F.col("f_agglo")).otherwise(F.col("f_union"))).alias("f1"), _r(F.col("f_union")).alias("f_union"), _r(F.col("f_agglo")).alias("f_agglo"))

    fuse = sql(f""", pv AS (SELECT stem, det_id, {P_SQL} AS p, {P_SQL.replace('cls = k', '(cls+1)%4 = k')} AS r FROM det),
      z AS (SELECT stem, det_id, [ln(greatest(p[i],1e-9)) + 0.5*(ln(greatest(r[i],1e-9)) - ln([0.4,0.3,0.2,0.1][i])) FOR i IN range(1,5)] AS z FROM pv)
      SELECT stem, det_id, [round(exp(x-list_max(z))/list_sum([exp(y-list_max(z)) FOR y IN z]),6) FOR x IN z] AS f FROM z""")
    @q("grp_24_opinion_fusion", fuse)
    def grp_24(s, d):
        r = V.soft_one_hot((F.col("cls") + 1) % 4, F.col("score"), 4)
        f = V.fuse_opinions(F.col("p"), r, [0.4, 0.3, 0.2, 0.1], 0.5)
        return probs(det(s, d)).select("stem", "det_id", F.transform(f, lambda x: F.round(x, 6)).alias("f"))
