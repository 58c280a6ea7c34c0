"""Queries of aggregations (AGG)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from grovekit.operators import aggregates as A
from grovekit.operators import matching
from grovekit.plans.joins import greedy_sql
from grovekit.plans.registry import Registry
from grovekit.plans.roles import P_SQL, det, gt, iou_sql, probs, sql
from grovekit.scale import read


def N() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))

TAUS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
TAU_SQL = "(SELECT CAST(t AS DOUBLE)/10 AS tau FROM range(1,10) r(t))"
IOU_GRID = [0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95]


def _r(c, n: int = 6):
    return F.round(c, n)


def matched(s, d, least=0.5, keys=("stem",)):
    return matching.match_one_to_one(det(s, d), gt(s, d), list(keys), least)


def pred_true(s, d):
    """(tree, cls, pred, true), zero-filled."""
    p = A.class_counts(det(s, d).where("score >= 0.4"), ["tree"], "cls", 4).withColumnRenamed("n", "pred")
    t = A.class_counts(gt(s, d), ["tree"], "cls", 4).withColumnRenamed("n", "true")
    return t.join(p, ["tree", "cls"], "left").select("tree", "cls", F.coalesce("pred", F.lit(0)).alias("pred"), "true")


PT_SQL = """, pt AS (SELECT tree, cls, coalesce(p.n,0) AS pred, coalesce(t.n,0) AS true_ FROM (SELECT tree, CAST(k AS INTEGER) AS cls FROM (SELECT DISTINCT tree FROM gt), range(4) r(k))
  LEFT JOIN (SELECT tree, cls, count(*) AS n FROM det WHERE score >= 0.4 GROUP BY ALL) p USING (tree, cls) LEFT JOIN (SELECT tree, cls, count(*) AS n FROM gt GROUP BY ALL) t USING (tree, cls))"""
AP_SQL = """, fl AS (SELECT d.cls, d.score, d.det_id, d.stem, CAST(f.det_id IS NOT NULL AS INT) AS tp FROM det d LEFT JOIN fin f ON f.stem=d.stem AND f.det_id=d.det_id),
 cum AS (SELECT cls, sum(tp) OVER w AS ctp, row_number() OVER w AS k FROM fl WINDOW w AS (PARTITION BY cls ORDER BY score DESC, stem*10000000000000+det_id)),
 tot AS (SELECT cls, count(*) AS n_true FROM gt GROUP BY cls),
 pr AS (SELECT cls, k, ctp/n_true AS recall, ctp/k AS prec FROM cum JOIN tot USING (cls)),
 env AS (SELECT cls, k, recall, max(prec) OVER (PARTITION BY cls ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM pr),
 steps AS (SELECT cls, t, (SELECT e.env FROM env e WHERE e.cls = tot.cls AND e.recall >= t/100.0 - 1e-11 ORDER BY k LIMIT 1) AS p FROM tot, range(0,101) r(t))"""
CLS_GREEDY = greedy_sql("").replace("a.stem = b.stem", "a.stem = b.stem AND a.cls = b.cls")


def register(reg: Registry) -> None:
    q = reg.query

    @q("agg_01_class_counts", sql("SELECT t.tree, CAST(k AS INTEGER) AS cls, count(d.cls) AS n FROM (SELECT DISTINCT tree FROM det) t CROSS JOIN range(4) r(k) LEFT JOIN det d ON d.tree=t.tree AND d.cls=k GROUP BY ALL"))
    def agg_01(s, d):
        return A.class_counts(det(s, d), ["tree"], "cls", 4)

    @q("agg_02_threshold_cube", sql(f"SELECT tree, cls, tau, count(*) FILTER (score >= tau) AS n FROM det, {TAU_SQL} GROUP BY ALL"))
    def agg_02(s, d):
        return A.threshold_cube(det(s, d), ["tree", "cls"], "score", TAUS)

    f67 = []
    for k in range(4):
        f67.append(f"""sum(n) FILTER (cls={k}) AS c{k}_sum, max(n) FILTER (cls={k}) AS c{k}_max, sum(n) FILTER (cls={k})/4.0 AS c{k}_mean, round(stddev_pop(n) FILTER (cls={k}),6) AS c{k}_std, min(n) FILTER (cls={k}) AS c{k}_min,
          round(stddev_pop(n) FILTER (cls={k})/greatest(avg(n) FILTER (cls={k}),1e-9),6) AS c{k}_cv, count(*) FILTER (cls={k} AND n>0) AS c{k}_sides, round(1-stddev_pop(n) FILTER (cls={k})/greatest(max(n) FILTER (cls={k}),1),6) AS c{k}_steady,
          round(sum(s) FILTER (cls={k}),6) AS c{k}_conf_sum, round(sum(s) FILTER (cls={k})/greatest(sum(n) FILTER (cls={k}),1),6) AS c{k}_conf_mean, round(max(m) FILTER (cls={k}),6) AS c{k}_conf_max, sum(n5) FILTER (cls={k}) AS c{k}_n5, sum(n6) FILTER (cls={k}) AS c{k}_n6,
          round(CASE WHEN sum(n) FILTER (cls={k}) > 0 THEN sum(cy) FILTER (cls={k})/sum(n) FILTER (cls={k}) ELSE 0.5 END,6) AS c{k}_cy, round(sum(ar) FILTER (cls={k})/greatest(sum(n) FILTER (cls={k}),1),6) AS c{k}_area""")
    tail = "4 AS n_sides, sum(n) AS total, " + ", ".join(f"round(sum(n) FILTER (cls={k})/greatest(sum(n),1),6) AS share_{k}" for k in range(4)) + ", round(sum(n) FILTER (cls=3)/greatest(sum(n) FILTER (cls>=2),1),6) AS late_share"
    feats = f""", cell AS (SELECT t.tree AS tree, k AS cls, sd AS side, count(d.cls) AS n, coalesce(sum(score),0) AS s, coalesce(max(score),0) AS m, count(*) FILTER (score>=0.5) AS n5, count(*) FILTER (score>=0.6) AS n6, coalesce(sum((y1+y2)/2/900),0) AS cy, coalesce(sum((x2-x1)*(y2-y1)),0) AS ar
      FROM (SELECT DISTINCT tree FROM det) t CROSS JOIN range(4) r(k) CROSS JOIN range(4) u(sd) LEFT JOIN det d ON d.tree=t.tree AND d.cls=k AND d.side=sd GROUP BY ALL) SELECT tree, {', '.join(f67)}, {tail} FROM cell GROUP BY tree"""
    num = lambda body: "WITH z AS (" + body + ") SELECT tree, COLUMNS(* EXCLUDE (tree))::DOUBLE FROM z"

    @q("agg_03_tree_features", num(sql(feats)))
    def agg_03(s, d):
        b = det(s, d).withColumn("cy", (F.col("y1") + F.col("y2")) / 2 / 900).withColumn("area", (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
        f = A.tree_features(b, "tree", 4, 4)
        return f.select("tree", *[_r(F.col(c)).alias(c) for c in f.columns if c != "tree"])

    @q("agg_04_summary", sql("SELECT tree, round(sum(score),6) AS s_sum, round(avg(score),6) AS s_mean, round(stddev_pop(score),6) AS s_std, min(score) AS s_min, round(quantile_cont(score,0.25),6) AS s_q25, round(quantile_cont(score,0.5),6) AS s_median, round(quantile_cont(score,0.75),6) AS s_q75, max(score) AS s_max FROM det GROUP BY tree"))
    def agg_04(s, d):
        g = det(s, d).groupBy("tree").agg(*A.summary(F.col("score"), "s"))
        return g.select("tree", *[(F.col(c) if c in ("s_min", "s_max") else _r(F.col(c))).alias(c) for c in g.columns if c != "tree"])

    @q("agg_05_multi_threshold", sql("SELECT tree, " + ", ".join(f"count(*) FILTER (score >= {t}) AS hard_{int(t*10)}, round(coalesce(sum(score) FILTER (score >= {t}),0),6) AS soft_{int(t*10)}" for t in TAUS) + " FROM det GROUP BY tree"))
    def agg_05(s, d):
        c = F.col("score")
        return det(s, d).groupBy("tree").agg(*[a for t in TAUS for a in (F.count_if(c >= t).alias(f"hard_{int(t * 10)}"), _r(F.coalesce(F.sum(F.when(c >= t, c)), F.lit(0.0))).alias(f"soft_{int(t * 10)}"))])

    @q("agg_06_robust_scale", sql(", m AS (SELECT side, cls, median(x1) AS c, count(*) AS n FROM det GROUP BY ALL HAVING count(*) >= 20) SELECT side, cls, c AS center, n, round(greatest(1.4826*median(abs(x1-c)),5),6) AS scale FROM det JOIN m USING (side, cls) GROUP BY ALL"))
    def agg_06(s, d):
        return A.robust_scale(det(s, d), ["side", "cls"], "x1", 5.0, 20).withColumn("scale", _r(F.col("scale")))

    @q("agg_07_weighted_vector", sql(f", pv AS (SELECT tree, score, {P_SQL} AS p FROM det WHERE score > 0) SELECT tree, [round(sum(score*p[1])/sum(score),6), round(sum(score*p[2])/sum(score),6), round(sum(score*p[3])/sum(score),6), round(sum(score*p[4])/sum(score),6)] AS p FROM pv GROUP BY tree"))
    def agg_07(s, d):
        v = A.weighted_vector(probs(det(s, d)).where("score > 0"), ["tree"], "p", "score", "p")
        return v.select("tree", F.transform("p", lambda x: F.round(x, 6)).alias("p"))

    @q("agg_08_pools", sql(f", pv AS (SELECT tree, det_id, score, {P_SQL} AS p FROM det WHERE score > 0 AND score < 1) SELECT tree, arg_max(det_id, (score, det_id)) AS top_member, round(exp(avg(ln(p[1]))),6) AS geo0, round(median(p[1]),6) AS med0, round(max(p[1]),6) AS max0, round(CASE WHEN count(*)>=3 THEN (sum(p[1]) - arg_min(p[1],(score,det_id)))/(count(*)-1) ELSE avg(p[1]) END,6) AS robust0 FROM pv GROUP BY tree"))
    def agg_08(s, d):
        df = probs(det(s, d)).where("score > 0 and score < 1").withColumn("p0", F.get("p", F.lit(0)))
        low = F.min_by("p0", F.struct("score", "det_id"))
        return df.groupBy("tree").agg(F.max_by("det_id", F.struct("score", "det_id")).alias("top_member"), _r(F.exp(F.avg(F.ln("p0")))).alias("geo0"), _r(F.median("p0")).alias("med0"), _r(F.max("p0")).alias("max0"),
                                      _r(F.when(N() >= 3, (F.sum("p0") - low) / (N() - 1)).otherwise(F.avg("p0"))).alias("robust0"))

    @q("agg_09_noisy_or", sql("SELECT tree, cls, round(1-exp(sum(ln(1-least(score,0.999999)))),6) AS v FROM det GROUP BY ALL"))
    def agg_09(s, d):
        return det(s, d).groupBy("tree", "cls").agg(_r(A.noisy_or(F.col("score"))).alias("v"))

    @q("agg_10_quality_weights", sql("""SELECT tree, round(sum(score*cls)/greatest(sum(score),1e-9),6) AS by_conf, round(sum(score*sqrt((x2-x1)*(y2-y1))*cls)/greatest(sum(score*sqrt((x2-x1)*(y2-y1))),1e-9),6) AS by_area,
      round(sum(score*sqrt((x2-x1)*(y2-y1))*(0.5+e)*cls)/greatest(sum(score*sqrt((x2-x1)*(y2-y1))*(0.5+e)),1e-9),6) AS by_edge FROM (SELECT *, greatest(least(x1, y1, 1300-x2, 900-y2), 0)/450 AS e FROM det) GROUP BY tree"""))
    def agg_10(s, d):
        w1 = F.col("score")
        w2 = w1 * F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))
        edge = F.greatest(F.least(F.col("x1"), F.col("y1"), 1300 - F.col("x2"), 900 - F.col("y2")), F.lit(0.0)) / 450  # distance from the image's edge
        mean = lambda w: F.sum(w * F.col("cls")) / F.greatest(F.sum(w), F.lit(1e-9))
        return det(s, d).groupBy("tree").agg(_r(mean(w1)).alias("by_conf"), _r(mean(w2)).alias("by_area"), _r(mean(w2 * (0.5 + edge))).alias("by_edge"))

    rules = """, x AS (SELECT g.tree, g.bunch, g.cls AS t, f.stem, f.det_id, d.score, d.score*sqrt((d.x2-d.x1)*(d.y2-d.y1)) AS w, [CASE WHEN d.cls = k THEN d.score ELSE (1 - d.score) / 3 END FOR k IN range(4)] AS p FROM fin f JOIN gt g ON g.stem=f.stem AND g.gt_id=f.gt_id JOIN det d ON d.stem=f.stem AND d.det_id=f.det_id),
      v AS (SELECT *, list_position(p, list_max(p)) - 1 AS c, round(p[2]+2*p[3]+3*p[4], 9) AS o FROM x),
      y AS (SELECT tree, bunch, t, avg(CAST(c=t AS INT)) AS r0, avg(CAST(CAST(o>0.5 AS INT)+CAST(o>1.5 AS INT)+CAST(o>2.5 AS INT)=t AS INT)) AS r0cal, CAST(arg_max(c,(score,stem,det_id))=t AS INT) AS r1,
        [round(avg(p[1]),9),round(avg(p[2]),9),round(avg(p[3]),9),round(avg(p[4]),9)] AS m, [round(sum(w*p[1])/sum(w),9),round(sum(w*p[2])/sum(w),9),round(sum(w*p[3])/sum(w),9),round(sum(w*p[4])/sum(w),9)] AS q FROM v GROUP BY tree, bunch, t),
      z AS (SELECT *, CAST(list_position(m, list_max(m))-1=t AS INT) AS r2, CAST(list_position(q, list_max(q))-1=t AS INT) AS r3, round(q[2]+2*q[3]+3*q[4],8) AS o FROM y)"""
    @q("agg_11_decision_rules", greedy_sql(rules + " SELECT t AS cls, count(*) AS n, round(avg(r0),6) AS r0, round(avg(r0cal),6) AS r0cal, round(avg(r1),6) AS r1, round(avg(r2),6) AS r2, round(avg(r3),6) AS r3, round(avg(CAST(CAST(o>0.5 AS INT)+CAST(o>1.5 AS INT)+CAST(o>2.5 AS INT)=t AS INT)),6) AS r4 FROM z GROUP BY t"))
    def agg_11(s, d):
        """Rules by which an entity's views decide its class: one view on average by its likeliest class (r0) or its ordinal score
        (r0cal), the surest view (r1), mean (r2) and weighted mean probabilities (r3), weighted ordinal score (r4)."""
        m = matched(s, d).select("stem", "det_id", "gt_id").join(gt(s, d).select("stem", "gt_id", "tree", "bunch", F.col("cls").alias("t")), ["stem", "gt_id"])
        v = m.join(probs(det(s, d)).select("stem", "det_id", "score", "p", (F.col("score") * F.sqrt((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")))).alias("w")), ["stem", "det_id"])
        top = lambda p: F.array_position(p, F.array_max(p)) - 1
        ordinal = lambda p, n: sum((k * F.get(p, F.lit(k)) for k in (2, 3)), F.get(p, F.lit(1))) if n is None else _r(sum((k * F.get(p, F.lit(k)) for k in (2, 3)), F.get(p, F.lit(1))), n)
        cut = lambda o: sum(((o > c).cast("int") for c in (1.5, 2.5)), (o > 0.5).cast("int"))
        right = lambda c: (c == F.col("t")).cast("int")
        v = v.select("tree", "bunch", "t", "stem", "det_id", "score", "w", "p", top(F.col("p")).alias("c"), ordinal(F.col("p"), 9).alias("o"))
        each = lambda w: F.array(*[_r(F.sum(w * F.get("p", F.lit(k))) / F.sum(w), 9) for k in range(4)])
        y = v.groupBy("tree", "bunch", "t").agg(F.avg(right(F.col("c"))).alias("r0"), F.avg(right(cut(F.col("o")))).alias("r0cal"), F.max_by("c", F.struct("score", "stem", "det_id")).alias("c1"), each(F.lit(1.0)).alias("m"), each(F.col("w")).alias("q"))
        z = y.select("t", "r0", "r0cal", right(F.col("c1")).alias("r1"), right(top(F.col("m"))).alias("r2"), right(top(F.col("q"))).alias("r3"), right(cut(ordinal(F.col("q"), 8))).alias("r4"))
        return z.groupBy(F.col("t").alias("cls")).agg(N().alias("n"), *[_r(F.avg(k)).alias(k) for k in ("r0", "r0cal", "r1", "r2", "r3", "r4")])

    err = "count(*) AS n, round(avg(abs(pred-true_)),6) AS mae, round(sqrt(avg((pred-true_)*(pred-true_))),6) AS rmse, round(avg(pred-true_),6) AS bias, round(avg(CAST(pred=true_ AS INT)),6) AS exact, round(avg(CAST(abs(pred-true_)<=1 AS INT)),6) AS within_one"
    @q("agg_12_count_error", sql(PT_SQL + f" SELECT cls, {err} FROM pt GROUP BY GROUPING SETS ((cls), ())"))
    def agg_12(s, d):
        e = A.count_errors(pred_true(s, d), "cls", "pred", "true")
        return e.select("cls", "n", *[_r(F.col(c)).alias(c) for c in ("mae", "rmse", "bias", "exact", "within_one")])

    @q("agg_12_joint", sql(PT_SQL + " SELECT count(*) AS n, round(avg(CAST(a AS INT)),6) AS joint, round(avg(CAST(t<=1 AS INT)),6) AS total FROM (SELECT bool_and(abs(pred-true_)<=1) AS a, abs(sum(pred-true_)) AS t FROM pt GROUP BY tree)"))
    def agg_12j(s, d):
        return A.joint_within_one(pred_true(s, d), "tree", "pred", "true").select("n", _r(F.col("joint")).alias("joint"), _r(F.col("total")).alias("total"))

    conf = """, cf AS (SELECT coalesce(d.cls,4) AS pred_cls, coalesce(g.cls,4) AS gt_cls, count(*) AS n FROM det d LEFT JOIN fin f ON f.stem=d.stem AND f.det_id=d.det_id FULL JOIN gt g ON g.stem=f.stem AND g.gt_id=f.gt_id GROUP BY ALL)"""
    @q("agg_13_confusion", greedy_sql(conf + " SELECT * FROM cf"))
    def agg_13(s, d):
        return A.confusion(det(s, d), gt(s, d), matched(s, d), ["stem"], 4)

    @q("agg_14_prf", greedy_sql(conf + """ SELECT CAST(k AS INTEGER) AS cls, CAST(tp AS BIGINT) AS tp, CAST(np AS BIGINT) AS n_pred, CAST(nt AS BIGINT) AS n_true, round(tp/greatest(np,1),6) AS precision, round(tp/greatest(nt,1),6) AS recall, round(2*tp/greatest(np+nt,1),6) AS f1
      FROM (SELECT k, sum(n) FILTER (pred_cls=k AND gt_cls=k) AS tp, sum(n) FILTER (pred_cls=k) AS np, sum(n) FILTER (gt_cls=k) AS nt FROM cf, range(4) r(k) GROUP BY k)"""))
    def agg_14(s, d):
        c = A.class_scores(A.confusion(det(s, d), gt(s, d), matched(s, d), ["stem"], 4), 4)
        return c.select("cls", "tp", "n_pred", "n_true", *[_r(F.col(k)).alias(k) for k in ("precision", "recall", "f1")])

    @q("agg_14_summary", greedy_sql(conf + """, k AS (SELECT k, sum(n) FILTER (pred_cls=k AND gt_cls=k) AS tp, sum(n) FILTER (pred_cls=k) AS np, sum(n) FILTER (gt_cls=k) AS nt, sum(n) FILTER (pred_cls=k AND gt_cls<4) AS mp, sum(n) FILTER (gt_cls=k AND pred_cls<4) AS mt FROM cf, range(4) r(k) GROUP BY k)
      SELECT round(avg(tp/greatest(np,1)),6) AS macro_precision, round(avg(tp/greatest(nt,1)),6) AS macro_recall, round(avg(2*tp/greatest(mp+mt,1)),6) AS macro_f1, round(2*sum(tp)/greatest(sum(np)+sum(nt),1),6) AS micro_f1, round(avg(2*tp/greatest(np+nt,1)),6) AS end_to_end_f1 FROM k"""))
    def agg_14s(s, d):
        """Macro F1 of matched boxes, micro F1, and macro F1 end to end, with what was missed or invented."""
        c = A.confusion(det(s, d), gt(s, d), matched(s, d), ["stem"], 4).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
        pk, tk = F.col("pred_cls") == F.col("k"), F.col("gt_cls") == F.col("k")
        n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
        each = c.groupBy("k").agg(n(pk & tk).alias("tp"), n(pk).alias("np"), n(tk).alias("nt"), n(pk & (F.col("gt_cls") < 4)).alias("mp"), n(tk & (F.col("pred_cls") < 4)).alias("mt"))
        f1 = lambda a, b: 2 * F.col("tp") / F.greatest(F.col(a) + F.col(b), F.lit(1))
        ratio = lambda b: F.col("tp") / F.greatest(F.col(b), F.lit(1))
        return each.agg(_r(F.avg(ratio("np"))).alias("macro_precision"), _r(F.avg(ratio("nt"))).alias("macro_recall"), _r(F.avg(f1("mp", "mt"))).alias("macro_f1"), _r(2 * F.sum("tp") / F.greatest(F.sum("np") + F.sum("nt"), F.lit(1))).alias("micro_f1"), _r(F.avg(f1("np", "nt"))).alias("end_to_end_f1"))

    def flagged(s, d, least=0.5):
        m = matching.match_one_to_one(det(s, d), gt(s, d), ["stem", "cls"], least).select("stem", "cls", "det_id", "threshold")
        return det(s, d).join(m, ["stem", "cls", "det_id"], "left").select("cls", "score", F.struct("stem", "det_id").alias("tie"), F.col("threshold").isNotNull().alias("tp"))

    def totals(s, d):
        return gt(s, d).groupBy("cls").agg(N().alias("n_true"))

    @q("agg_15_ap_coco", CLS_GREEDY + AP_SQL + " SELECT cls, round(sum(coalesce(p,0))/101,6) AS ap FROM steps GROUP BY cls")
    def agg_15(s, d):
        return A.average_precision(flagged(s, d), totals(s, d), ["cls"]).withColumn("ap", _r(F.col("ap")))

    @q("agg_15_ap_raw", CLS_GREEDY + AP_SQL + " SELECT cls, round(sum(coalesce(p,0))/101,6) AS ap FROM (SELECT tot.cls, t, (SELECT max(prec) FROM pr WHERE pr.cls=tot.cls AND pr.recall >= t/100.0-1e-11) AS p FROM tot, range(0,101) r(t)) GROUP BY cls")
    def agg_15r(s, d):
        return A.average_precision(flagged(s, d), totals(s, d), ["cls"], "raw").withColumn("ap", _r(F.col("ap")))

    @q("agg_15_ap_interp")
    def agg_15i(s, d):
        return A.average_precision(flagged(s, d), totals(s, d), ["cls"], "interp").withColumn("ap", _r(F.col("ap")))

    @q("agg_16_map_grid")
    def agg_16(s, d):
        m = matching.match_one_to_one(det(s, d), gt(s, d), ["stem", "cls"], IOU_GRID).groupBy("stem", "cls", "det_id").agg(F.collect_set("threshold").alias("at"))
        tp = F.transform(F.lit(IOU_GRID), lambda x: F.array_contains("at", x))
        fl = det(s, d).join(m, ["stem", "cls", "det_id"], "left").select("cls", "score", F.struct("stem", "det_id").alias("tie"), tp.alias("tp"))
        tot = totals(s, d).withColumn("threshold", F.explode(F.lit(IOU_GRID)))
        ap = A.average_precision(fl, tot, ["cls"], grid=IOU_GRID)
        return ap.agg(_r(F.avg(F.when(F.col("threshold") == 0.5, F.col("ap")))).alias("map50"), _r(F.avg("ap")).alias("map50_95"))

    @q("agg_17_agnostic", greedy_sql(AP_SQL.replace("SELECT d.cls,", "SELECT 0 AS cls,").replace("SELECT cls, count(*) AS n_true FROM gt GROUP BY cls", "SELECT 0 AS cls, count(*) AS n_true FROM gt") + " SELECT round(sum(coalesce(p,0))/101,6) AS ap FROM steps"))
    def agg_17(s, d):
        m = matched(s, d).select("stem", "det_id", "threshold")
        fl = det(s, d).join(m, ["stem", "det_id"], "left").select(F.lit(0).alias("all"), "score", F.struct("stem", "det_id").alias("tie"), F.col("threshold").isNotNull().alias("tp"))
        return A.average_precision(fl, gt(s, d).agg(F.lit(0).alias("all"), N().alias("n_true")), ["all"]).select(_r(F.col("ap")).alias("ap"))

    @q("agg_18_percentile_ci", sql("SELECT cls, round(quantile_cont(score,0.025),6) AS lo, round(quantile_cont(score,0.975),6) AS hi, round(avg(CAST(score>0.5 AS INT)),6) AS p_above, quantile_cont(score,0.025) > 0 AS significant FROM det GROUP BY cls"))
    def agg_18(s, d):
        ci = F.percentile("score", F.array(F.lit(0.025), F.lit(0.975)))
        return det(s, d).groupBy("cls").agg(_r(ci[0]).alias("lo"), _r(ci[1]).alias("hi"), _r(F.avg((F.col("score") > 0.5).cast("int"))).alias("p_above"), (ci[0] > 0).alias("significant"))

    @q("agg_19_sample_stats", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice),4) AS mean, round(coalesce(stddev_samp(o_totalprice),0),4) AS std, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY ALL")
    def agg_19(s, d):
        c = "o_totalprice"
        return read(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(N().alias("n"), _r(F.avg(c), 4).alias("mean"), _r(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4).alias("std"), F.min(c).alias("least"), F.max(c).alias("most"))

    cov = """, e AS (SELECT g.tree, g.bunch, count(*) AS n, count(f.gt_id) AS k FROM gt g LEFT JOIN fin f ON f.stem=g.stem AND f.gt_id=g.gt_id GROUP BY ALL),
      c AS (SELECT d.tree, d.cls, max(cnt) AS most FROM (SELECT DISTINCT tree, cls FROM det) d LEFT JOIN (SELECT d.tree, d.cls, g.bunch, count(*) AS cnt FROM fin f JOIN det d ON d.stem=f.stem AND d.det_id=f.det_id JOIN gt g ON g.stem=f.stem AND g.gt_id=f.gt_id GROUP BY ALL) x USING (tree, cls) GROUP BY ALL)
      SELECT count(*) AS entities, count(*) FILTER (k>0) AS detected, CAST(sum(n) AS BIGINT) AS boxes, CAST(sum(k) AS BIGINT) AS boxes_found, round(count(*) FILTER (k>=2)/count(*),6) AS of_all, round(count(*) FILTER (k>=2)/greatest(count(*) FILTER (k>0),1),6) AS of_detected,
        (SELECT round(avg(CAST(coalesce(most,0) < 2 AS INT)),6) FROM c) AS false_share FROM e"""
    @q("agg_20_coverage", greedy_sql(cov))
    def agg_20(s, d):
        """Entities seen in at least two boxes, as a share of all entities and of the detected ones; groups of a tree's detections of
        one class of which no two are boxes of one entity, as a share of all groups."""
        m = matched(s, d).select("stem", "det_id", "gt_id")
        g = gt(s, d).select("stem", "tree", "gt_id", "bunch").join(m, ["stem", "gt_id"], "left")
        e = g.groupBy("tree", "bunch").agg(N().alias("n"), F.count("det_id").alias("k"))
        hit = g.where("det_id is not null").join(det(s, d).select("stem", "det_id", "cls"), ["stem", "det_id"]).groupBy("tree", "cls", "bunch").agg(N().alias("c")).groupBy("tree", "cls").agg(F.max("c").alias("most"))
        wrong = det(s, d).select("tree", "cls").distinct().join(hit, ["tree", "cls"], "left").agg(_r(F.avg((F.coalesce("most", F.lit(0)) < 2).cast("int"))).alias("false_share"))
        twice = F.count_if(F.col("k") >= 2)
        one = e.agg(N().alias("entities"), F.count_if(F.col("k") > 0).alias("detected"), F.sum("n").alias("boxes"), F.sum("k").alias("boxes_found"), _r(twice / N()).alias("of_all"), _r(twice / F.greatest(F.count_if(F.col("k") > 0), F.lit(1))).alias("of_detected"))
        return one.crossJoin(wrong)  # one row each

    @q("agg_21_link_prf", sql('SELECT "both", made, "real", round("both"/greatest(made,1),6) AS precision, round("both"/greatest("real",1),6) AS recall, round(2*"both"/greatest(made+"real",1),6) AS f1 FROM (SELECT CAST(count(*) FILTER (a.cls=b.cls AND a.bunch=b.bunch) AS DOUBLE) AS "both", CAST(count(*) FILTER (a.cls=b.cls) AS DOUBLE) AS made, CAST(count(*) FILTER (a.bunch=b.bunch) AS DOUBLE) AS "real" FROM gt a JOIN gt b ON a.tree=b.tree AND a.side<b.side)'))
    def agg_21(s, d):
        r = A.link_scores(gt(s, d), ["tree"], "gt_id", "side", "cls", "bunch")
        return r.select("both", "made", "real", *[_r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])

    @q("agg_22_ari_nmi", sql(""", c AS (SELECT cls, bunch, count(*) AS n FROM gt GROUP BY ALL), t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM gt),
      a AS (SELECT sum(n*(n-1)/2) AS s, -sum(n/t*ln(n/t)) AS h FROM (SELECT count(*) AS n FROM gt GROUP BY cls), t), b AS (SELECT sum(n*(n-1)/2) AS s, -sum(n/t*ln(n/t)) AS h FROM (SELECT count(*) AS n FROM gt GROUP BY bunch), t),
      j AS (SELECT sum(n*(n-1)/2) AS s, -sum(n/t*ln(n/t)) AS h FROM c, t)
      SELECT round((j.s - a.s*b.s/(t*(t-1)/2))/((a.s+b.s)/2 - a.s*b.s/(t*(t-1)/2)),6) AS ari, round((a.h+b.h-j.h)/((a.h+b.h)/2),6) AS nmi FROM j, a, b, t"""))
    def agg_22(s, d):
        return A.contingency_scores(gt(s, d), "cls", "bunch").select(_r(F.col("ari")).alias("ari"), _r(F.col("nmi")).alias("nmi"))

    rank = "(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1)/2.0)"
    @q("agg_23_spearman", f"SELECT count(*) AS n, round(corr(a,b),6) AS rho FROM (SELECT {rank.format(c='o_totalprice')} AS a, {rank.format(c='o_custkey')} AS b FROM orders)")
    def agg_23(s, d):
        return A.spearman(read(s, d, "orders"), "o_totalprice", "o_custkey").select("n", _r(F.col("rho")).alias("rho"))

    @q("agg_23_auc", sql(f"SELECT round((sum(r*y)-sum(y)*(sum(y)+1)/2)/(sum(y)*sum(1-y)),6) AS auc FROM (SELECT {rank.format(c='score')} AS r, CAST(cls=1 AS INT) AS y FROM det)"))
    def agg_23a(s, d):
        return A.auc(det(s, d), "score", F.col("cls") == 1).select(_r(F.col("auc")).alias("auc"))

    @q("agg_23_kruskal", sql(f", r AS (SELECT cls, {rank.format(c='score')} AS r FROM det), g AS (SELECT count(*) AS n, sum(r) AS s FROM r GROUP BY cls), t AS (SELECT sum(n*n*n-n) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM det GROUP BY score)) SELECT CAST(groups AS BIGINT) AS groups, round((12/(n*(n+1))*qq-3*(n+1))/(1-ties/(n*n*n-n)),5) AS h FROM (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(s*s/n) AS qq, count(*) AS groups FROM g), t"))
    def agg_23k(s, d):
        return A.kruskal(det(s, d), "score", "cls").select("groups", _r(F.col("h"), 5).alias("h"))

    bn = "SELECT tree_id, bunch_id, count(DISTINCT box_id) AS n, count(DISTINCT side_index) AS k FROM gt_boxes WHERE bunch_id IS NOT NULL AND trim(bunch_id) <> '' AND NOT starts_with(bunch_id,'-') GROUP BY ALL"

    def bunches(s, d):
        b = read(s, d, "gt_boxes").where(F.col("bunch_id").isNotNull() & (F.trim("bunch_id") != "") & ~F.col("bunch_id").startswith("-"))
        return b.groupBy("tree_id", "bunch_id").agg(F.countDistinct("box_id").alias("n"), F.countDistinct("side_index").alias("k"), F.collect_set("side_index").alias("sides"))

    @q("agg_24_duplication", f"WITH b AS ({bn}) SELECT tree_id, round(sum(n)/count(*),6) AS factor FROM b GROUP BY tree_id UNION ALL SELECT NULL, round(sum(n)/count(*),6) FROM b")
    def agg_24(s, d):
        return bunches(s, d).groupingSets([["tree_id"], []], "tree_id").agg(_r(F.sum("n") / N()).alias("factor"))

    @q("agg_24_histogram", f"WITH b AS ({bn}) SELECT least(k,4) AS views, count(*) AS n FROM b GROUP BY 1")
    def agg_24h(s, d):
        return bunches(s, d).groupBy(F.least("k", F.lit(4)).alias("views")).agg(N().alias("n"))

    @q("agg_25_label_noise", "SELECT count(*) AS n, CAST(sum(CAST(c>1 AS INT)) AS BIGINT) AS disagreeing, max(spread) AS most_spread FROM (SELECT tree_id, bunch_id, count(DISTINCT cls) AS c, max(cls)-min(cls) AS spread FROM gt_boxes WHERE cls >= 0 AND bunch_id IS NOT NULL AND trim(bunch_id) <> '' AND NOT starts_with(bunch_id,'-') GROUP BY ALL)")
    def agg_25(s, d):
        b = read(s, d, "gt_boxes").where((F.col("cls") >= 0) & F.col("bunch_id").isNotNull() & (F.trim("bunch_id") != "") & ~F.col("bunch_id").startswith("-"))
        g = b.groupBy("tree_id", "bunch_id").agg(F.countDistinct("cls").alias("c"), (F.max("cls") - F.min("cls")).alias("spread"))
        return g.agg(N().alias("n"), F.count_if(F.col("c") > 1).alias("disagreeing"), F.max("spread").alias("most_spread"))

    @q("agg_26_class_share", sql("SELECT model, cls, count(*) AS n, round(count(*)/sum(count(*)) OVER (PARTITION BY model),6) AS share, round(count(*)/count(DISTINCT stem),6) AS per_image FROM det GROUP BY model, cls"))
    def agg_26(s, d):
        g = det(s, d).groupBy("model", "cls").agg(N().alias("n"), F.countDistinct("stem").alias("k"))
        return g.select("model", "cls", "n", _r(F.col("n") / F.sum("n").over(Window.partitionBy("model"))).alias("share"), _r(F.try_divide("n", "k")).alias("per_image"))

    @q("agg_27_error_parts", greedy_sql("SELECT tree, CAST(sum(missed) AS BIGINT) AS missed, CAST(sum(spurious) AS BIGINT) AS spurious, CAST(sum(wrong) AS BIGINT) AS wrong_class FROM (SELECT g.tree, CAST(f.gt_id IS NULL AS INT) AS missed, 0 AS spurious, CAST(d.cls <> g.cls AS INT) AS wrong FROM gt g LEFT JOIN fin f ON f.stem=g.stem AND f.gt_id=g.gt_id LEFT JOIN det d ON d.stem=f.stem AND d.det_id=f.det_id UNION ALL SELECT tree, 0, 1, 0 FROM det WHERE (stem, det_id) NOT IN (SELECT (stem, det_id) FROM fin)) GROUP BY tree"))
    def agg_27(s, d):
        m = matched(s, d).select("stem", "det_id", "gt_id")
        g = gt(s, d).select("stem", "tree", "gt_id", "cls").join(m, ["stem", "gt_id"], "left").join(det(s, d).select("stem", "det_id", F.col("cls").alias("pc")), ["stem", "det_id"], "left")
        part = g.select("tree", F.col("det_id").isNull().cast("int").alias("missed"), F.lit(0).alias("spurious"), F.coalesce((F.col("pc") != F.col("cls")).cast("int"), F.lit(0)).alias("wrong"))
        extra = det(s, d).join(m, ["stem", "det_id"], "left_anti").select("tree", F.lit(0), F.lit(1), F.lit(0))
        return part.union(extra).groupBy("tree").agg(F.sum("missed").alias("missed"), F.sum("spurious").alias("spurious"), F.sum("wrong").alias("wrong_class"))

    @q("agg_28_cancellation", sql(PT_SQL + " SELECT count(*) AS exact_totals, CAST(sum(CAST(a > 0 AS INT)) AS BIGINT) AS by_cancellation FROM (SELECT sum(pred-true_) AS t, sum(abs(pred-true_)) AS a FROM pt GROUP BY tree) WHERE t = 0"))
    def agg_28(s, d):
        g = pred_true(s, d).groupBy("tree").agg(F.sum(F.col("pred") - F.col("true")).alias("t"), F.sum(F.abs(F.col("pred") - F.col("true"))).alias("a"))
        return g.where("t = 0").agg(N().alias("exact_totals"), F.count_if(F.col("a") > 0).alias("by_cancellation"))

    @q("agg_29_by_views", sql(", v AS (SELECT tree, cls, count(DISTINCT side) AS nview, count(*) AS n FROM det GROUP BY ALL) SELECT nview, cls, count(*) AS groups, CAST(sum(n) AS BIGINT) AS boxes FROM v GROUP BY GROUPING SETS ((nview, cls), (nview), ())"))
    def agg_29(s, d):
        v = det(s, d).groupBy("tree", "cls").agg(F.countDistinct("side").alias("nview"), N().alias("n"))
        return v.groupingSets([["nview", "cls"], ["nview"], []], "nview", "cls").agg(N().alias("groups"), F.sum("n").alias("boxes"))

    @q("agg_30_majority", sql(", c AS (SELECT tree, cls, count(*) AS n, min(det_id) AS first FROM det GROUP BY ALL) SELECT tree, cls, n FROM c QUALIFY row_number() OVER (PARTITION BY tree ORDER BY n DESC, first) = 1"))
    def agg_30(s, d):
        c = det(s, d).groupBy("tree", "cls").agg(N().alias("n"), F.min("det_id").alias("first"))
        return c.groupBy("tree").agg(F.max_by(F.struct("cls", "n"), F.struct("n", -F.col("first"))).alias("m")).select("tree", "m.cls", "m.n")

    @q("agg_31_distinct", sql("SELECT model, count(DISTINCT tree) AS trees, count(DISTINCT stem) AS images FROM det GROUP BY model"))
    def agg_31(s, d):
        return det(s, d).groupBy("model").agg(F.countDistinct("tree").alias("trees"), F.countDistinct("stem").alias("images"))

    @q("agg_32_group_features", sql("SELECT tree, cls, count(*) AS members, round(avg(score),6) AS mean, max(score) AS most, min(score) AS least, round(stddev_pop(score),6) AS std, round(avg(x2-x1),6) AS width, CAST(bit_or(1 << side) AS INTEGER) AS side_mask FROM det GROUP BY tree, cls"))
    def agg_32(s, d):
        return det(s, d).groupBy("tree", "cls").agg(N().alias("members"), _r(F.avg("score")).alias("mean"), F.max("score").alias("most"), F.min("score").alias("least"), _r(F.stddev_pop("score")).alias("std"), _r(F.avg(F.col("x2") - F.col("x1"))).alias("width"), F.bit_or(F.expr("shiftleft(1, side)")).alias("side_mask"))

    bound = """, pair AS (SELECT a.stem, a.det_id, a.cls AS dc, b.gt_id, b.cls AS gc FROM det a JOIN gt b ON a.stem=b.stem WHERE {iou} >= 0.5)
      SELECT (SELECT count(*) FROM gt) AS n_true, count(DISTINCT stem || '/' || gt_id) AS reachable, count(DISTINCT stem || '/' || gt_id) FILTER (dc=gc) AS reachable_same_class FROM pair"""
    @q("agg_33_oracle_bounds", sql(bound.replace("{iou}", iou_sql("a", "b"))))
    def agg_33(s, d):
        p = matching.theta_join(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id", 0.5, extra=["cls"])
        hit = p.groupBy("stem", "gt_id").agg(F.bool_or(F.col("cls") == F.col("b_cls")).alias("same"))
        return gt(s, d).select("stem", "gt_id").join(hit, ["stem", "gt_id"], "left").agg(N().alias("n_true"), F.count("same").alias("reachable"), F.count_if(F.col("same")).alias("reachable_same_class"))

    @q("agg_34_agreement", sql("SELECT count(*) AS trees, CAST(sum(CAST(k=1 AS INT)) AS BIGINT) AS all_agree FROM (SELECT tree, count(DISTINCT c) AS k FROM (SELECT tree, model, arg_max(cls, (score, det_id)) AS c FROM det GROUP BY ALL) GROUP BY tree)"))
    def agg_34(s, d):
        votes = det(s, d).groupBy("tree", "model").agg(F.max_by("cls", F.struct("score", "det_id")).alias("c"))
        return votes.groupBy("tree").agg(F.size(F.collect_set("c")).alias("k")).agg(N().alias("trees"), F.count_if(F.col("k") == 1).alias("all_agree"))

    water = """, b AS (SELECT g.stem, g.gt_id, max(a.score) AS s, max(a.score) FILTER (a.cls=g.cls) AS sc FROM gt g LEFT JOIN det a ON a.stem=g.stem AND {iou} >= 0.5 GROUP BY ALL)
      SELECT CASE WHEN s IS NULL THEN '1 missing' WHEN s < 0.4 THEN '2 confidence' WHEN sc IS NULL THEN '3 class' WHEN sc < 0.4 THEN '4 class confidence' ELSE '5 found' END AS stage, count(*) AS n FROM b GROUP BY 1"""
    @q("agg_35_loss_waterfall", sql(water.replace("{iou}", iou_sql("a", "g"))))
    def agg_35(s, d):
        p = matching.theta_join(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id", 0.5, extra=["cls"])
        best = p.groupBy("stem", "gt_id").agg(F.max("score").alias("s"), F.max(F.when(F.col("cls") == F.col("b_cls"), F.col("score"))).alias("sc"))
        stage = F.when(F.col("s").isNull(), "1 missing").when(F.col("s") < 0.4, "2 confidence").when(F.col("sc").isNull(), "3 class").when(F.col("sc") < 0.4, "4 class confidence").otherwise("5 found")
        return gt(s, d).select("stem", "gt_id").join(best, ["stem", "gt_id"], "left").groupBy(stage.alias("stage")).agg(N().alias("n"))

    @q("agg_36_occupancy", sql(", o AS (SELECT g.stem, g.gt_id, count(a.det_id) AS k FROM gt g LEFT JOIN det a ON a.stem=g.stem AND (a.x1+a.x2)/2 BETWEEN g.x1 AND g.x2 AND (a.y1+a.y2)/2 BETWEEN g.y1 AND g.y2 GROUP BY ALL) SELECT k, count(*) AS n FROM o GROUP BY k"))
    def agg_36(s, d):
        k = matching.contained(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id").groupBy("stem", "gt_id").agg(N().alias("k"))
        return gt(s, d).select("stem", "gt_id").join(k, ["stem", "gt_id"], "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(N().alias("n"))

    @q("agg_37_structure", "SELECT new_split, variety, count(*) AS n_rows, count(DISTINCT tree_id) AS trees, CAST(coalesce(sum(B1),0)+coalesce(sum(B2),0)+coalesce(sum(B3),0)+coalesce(sum(B4),0) AS BIGINT) AS bunches FROM split_manifest GROUP BY ALL")
    def agg_37(s, d):
        total = sum((F.coalesce(F.sum(f"B{i}"), F.lit(0)) for i in (2, 3, 4)), F.coalesce(F.sum("B1"), F.lit(0)))
        return read(s, d, "split_manifest").groupBy("new_split", "variety").agg(N().alias("n_rows"), F.countDistinct("tree_id").alias("trees"), total.alias("bunches"))

    p38 = f", b AS (SELECT a.stem, a.det_id, a.score, coalesce(max(v),0) AS v FROM det a LEFT JOIN (SELECT a.stem, a.det_id, {iou_sql('a', 'b')} AS v FROM det a JOIN gt b ON a.stem=b.stem) x ON x.stem=a.stem AND x.det_id=a.det_id GROUP BY ALL)"
    @q("agg_38_precision_by_cut", sql(p38 + f" SELECT tau, count(*) AS n, count(*) FILTER (v >= 0.5) AS right FROM b, {TAU_SQL} WHERE score >= tau GROUP BY tau"))
    def agg_38(s, d):
        best = matching.theta_join(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id", 0.5).select("stem", "det_id").distinct().withColumn("hit", F.lit(True))
        each = det(s, d).select("stem", "det_id", "score").join(best, ["stem", "det_id"], "left").withColumn("tau", F.explode(F.filter(F.lit(TAUS), lambda t: F.col("score") >= t)))
        return each.groupBy("tau").agg(N().alias("n"), F.count_if(F.coalesce("hit", F.lit(False))).alias("right"))

    r39 = f", m AS (SELECT g.stem, g.gt_id, (g.x2-g.x1)*(g.y2-g.y1) AS area, coalesce(max({iou_sql('a', 'g')}),0) AS v FROM gt g LEFT JOIN det a ON a.stem=g.stem GROUP BY ALL)"
    @q("agg_39_many_to_one_recall", sql(r39 + " SELECT count(*) AS n, round(avg(CAST(v>=0.5 AS INT)),6) AS recall, round(median(area) FILTER (v>=0.5),4) AS hit_area, round(median(area) FILTER (v<0.5),4) AS missed_area, count(*) FILTER (area<1600 AND v<0.5) AS small_missed FROM m"))
    def agg_39(s, d):
        best = matching.theta_join(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id", 0.5).select("stem", "gt_id").distinct().withColumn("hit", F.lit(True))
        g = gt(s, d).select("stem", "gt_id", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area")).join(best, ["stem", "gt_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        return g.agg(N().alias("n"), _r(F.avg(F.col("hit").cast("int"))).alias("recall"), _r(F.median(F.when(F.col("hit"), F.col("area"))), 4).alias("hit_area"), _r(F.median(F.when(~F.col("hit"), F.col("area"))), 4).alias("missed_area"), F.count_if((F.col("area") < 1600) & ~F.col("hit")).alias("small_missed"))

    @q("agg_40_graph", "WITH e AS (SELECT * FROM edges WHERE score >= 0.05), n AS (SELECT tree_id, side_i AS side, i AS box FROM e UNION ALL SELECT tree_id, side_j, j FROM e) SELECT deg, count(*) AS nodes FROM (SELECT count(*) AS deg FROM n WHERE box IS NOT NULL GROUP BY tree_id, side, box) GROUP BY deg")
    def agg_40(s, d):
        e = read(s, d, "edges").where("score >= 0.05")
        n = e.select("tree_id", F.col("side_i").alias("side"), F.col("i").alias("box")).union(e.select("tree_id", "side_j", "j")).where("box is not null")
        return n.groupBy("tree_id", "side", "box").agg(N().alias("deg")).groupBy("deg").agg(N().alias("nodes"))

    @q("agg_41_confusion_partials", greedy_sql(", pc AS (SELECT d.tree, d.cls AS p, g.cls AS t, count(*) AS n FROM fin f JOIN det d ON d.stem=f.stem AND d.det_id=f.det_id JOIN gt g ON g.stem=f.stem AND g.gt_id=f.gt_id GROUP BY ALL) SELECT CAST(tree % 5 AS INTEGER) AS part, round(CAST(sum(n) FILTER (p=t) AS DOUBLE)/sum(n),6) AS accuracy, round(CAST(sum(n*abs(p-t)) AS DOUBLE)/sum(n),6) AS ordinal_mae FROM pc GROUP BY 1"))
    def agg_41(s, d):
        m = matched(s, d).select("stem", "det_id", "gt_id").join(det(s, d).select("stem", "tree", "det_id", F.col("cls").alias("p")), ["stem", "det_id"]).join(gt(s, d).select("stem", "gt_id", F.col("cls").alias("t")), ["stem", "gt_id"])
        part = m.groupBy("tree", "p", "t").agg(N().alias("n"))
        return part.groupBy((F.col("tree") % 5).cast("int").alias("part")).agg(_r(F.sum(F.when(F.col("p") == F.col("t"), F.col("n"))) / F.sum("n")).alias("accuracy"), _r(F.sum(F.col("n") * F.abs(F.col("p") - F.col("t"))) / F.sum("n")).alias("ordinal_mae"))
