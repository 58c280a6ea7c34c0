"""Queries of windows, sorts and set operations (WIN, SRT, SET)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from grovekit.operators import selection
from grovekit.plans.registry import Registry
from grovekit.plans.roles import det, gt, sql
from grovekit.scale import read


def N() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))



def _r(c, n: int = 6):
    return F.round(c, n)


def register(reg: Registry) -> None:
    q = reg.query
    def side():
        return Window.partitionBy("tree", "side")

    @q("win_01_rank_share", sql("SELECT stem, det_id, round((row_number() OVER (PARTITION BY tree, side ORDER BY x1, det_id)-1)/greatest(count(*) OVER (PARTITION BY tree, side)-1,1),6) AS r FROM det"))
    def win_01(s, d):
        return det(s, d).select("stem", "det_id", _r((F.row_number().over(side().orderBy("x1", "det_id")) - 1) / F.greatest(N().over(side()) - 1, F.lit(1))).alias("r"))

    @q("win_02_robust_z", sql(", m AS (SELECT *, median(y1) OVER (PARTITION BY stem) AS c FROM det) SELECT stem, det_id, round((y1-c)/greatest(1.4826*median(abs(y1-c)) OVER (PARTITION BY stem),1),6) AS z FROM m"))
    def win_02(s, d):
        w = Window.partitionBy("stem")
        m = det(s, d).withColumn("c", F.median("y1").over(w))
        return m.select("stem", "det_id", _r((F.col("y1") - F.col("c")) / F.greatest(1.4826 * F.median(F.abs(F.col("y1") - F.col("c"))).over(w), F.lit(1.0))).alias("z"))

    @q("win_03_cumulative", sql("SELECT stem, det_id, sum(CAST(line%2=0 AS INT)) OVER w AS ctp, row_number() OVER w AS k FROM det WINDOW w AS (PARTITION BY tree, cls ORDER BY score DESC, stem, det_id ROWS UNBOUNDED PRECEDING)"))
    def win_03(s, d):
        w = Window.partitionBy("tree", "cls").orderBy(F.desc("score"), "stem", "det_id")
        return det(s, d).select("stem", "det_id", F.sum((F.col("line") % 2 == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("ctp"), F.row_number().over(w).alias("k"))

    @q("win_04_envelope", sql("SELECT stem, det_id, max(y1) OVER (PARTITION BY tree, cls ORDER BY score DESC, stem, det_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM det"))
    def win_04(s, d):
        # the frame to the end, read from the end: a running maximum instead of one scan for each row
        w = Window.partitionBy("tree", "cls").orderBy(F.asc("score"), F.desc("stem"), F.desc("det_id")).rowsBetween(Window.unboundedPreceding, 0)
        return det(s, d).select("stem", "det_id", F.max("y1").over(w).alias("env"))

    @q("win_05_margin", sql(", r AS (SELECT *, row_number() OVER (PARTITION BY tree, side ORDER BY score DESC, det_id) AS k FROM det) SELECT tree, side, max(score) FILTER (k=1) AS best, max(score) FILTER (k=2) AS second, round(max(score) FILTER (k=1) - max(score) FILTER (k=2),6) AS margin FROM r GROUP BY ALL"))
    def win_05(s, d):
        r = selection.top_k(det(s, d), ["tree", "side"], [F.desc("score"), F.col("det_id")], 2, rank="k")
        at = lambda k: F.max(F.when(F.col("k") == k, F.col("score")))
        return r.groupBy("tree", "side").agg(at(1).alias("best"), at(2).alias("second"), _r(at(1) - at(2)).alias("margin"))

    @q("win_06_top_per_image", sql("SELECT stem, det_id FROM det QUALIFY row_number() OVER (PARTITION BY stem ORDER BY score DESC, det_id) <= 3"))
    def win_06(s, d):
        return selection.top_k(det(s, d), ["stem"], [F.desc("score"), F.col("det_id")], 3).select("stem", "det_id")

    @q("win_07_first_per_anchor", sql("SELECT stem, cls, det_id FROM det QUALIFY row_number() OVER (PARTITION BY stem, cls ORDER BY det_id) = 1"))
    def win_07(s, d):
        return det(s, d).groupBy("stem", "cls").agg(F.min("det_id").alias("det_id"))

    @q("win_08_neighbour_gap", sql("SELECT stem, det_id, least(y1-lag(y1) OVER w, lead(y1) OVER w - y1) AS gap FROM det WINDOW w AS (PARTITION BY stem ORDER BY y1, det_id)"))
    def win_08(s, d):
        w = Window.partitionBy("stem").orderBy("y1", "det_id")
        return det(s, d).select("stem", "det_id", F.least(F.col("y1") - F.lag("y1").over(w), F.lead("y1").over(w) - F.col("y1")).alias("gap"))

    @q("win_09_prefix_sums", sql("SELECT tree, det_id, stem, " + ", ".join(f"CAST(sum(CAST(cls={k} AS INT)) OVER w AS BIGINT) AS s{k}" for k in range(4)) + " FROM det WINDOW w AS (PARTITION BY tree ORDER BY score, stem, det_id ROWS UNBOUNDED PRECEDING)"))
    def win_09(s, d):
        w = Window.partitionBy("tree").orderBy("score", "stem", "det_id").rowsBetween(Window.unboundedPreceding, 0)
        return det(s, d).select("tree", "det_id", "stem", *[F.sum((F.col("cls") == k).cast("int")).over(w).alias(f"s{k}") for k in range(4)])

    @q("win_10_demean", sql("SELECT stem, det_id, round(score-avg(score) OVER (PARTITION BY stem),6) AS by_image, round(score-avg(score) OVER (PARTITION BY tree),6) AS by_tree FROM det"))
    def win_10(s, d):
        c = F.col("score")
        return det(s, d).select("stem", "det_id", _r(c - F.avg(c).over(Window.partitionBy("stem"))).alias("by_image"), _r(c - F.avg(c).over(Window.partitionBy("tree"))).alias("by_tree"))

    @q("win_11_quota_rank", sql(", r AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY y1 DESC, stem, det_id) AS k FROM det), qt AS (SELECT tree, " + ", ".join(f"count(*) FILTER (cls <= {k}) AS q{k}" for k in range(3)) + " FROM det GROUP BY tree) SELECT r.tree, stem, det_id, CAST(CASE WHEN k <= q0 THEN 0 WHEN k <= q1 THEN 1 WHEN k <= q2 THEN 2 ELSE 3 END AS INTEGER) AS quota_cls FROM r JOIN qt USING (tree)"))
    def win_11(s, d):
        return selection.quota_classes(det(s, d), "tree", [F.desc("y1"), F.col("stem"), F.col("det_id")], "cls", 4).select("tree", "stem", "det_id", "quota_cls")

    @q("win_12_context", sql("SELECT stem, det_id, round(avg(cls) OVER w,6) AS mean, round(stddev_pop(cls) OVER w,6) AS std, min(cls) OVER w AS least, max(cls) OVER w AS most, round((cls-avg(cls) OVER w)/greatest(stddev_pop(cls) OVER w,0.001),6) AS z FROM det WINDOW w AS (PARTITION BY tree)"))
    def win_12(s, d):
        w, c = Window.partitionBy("tree"), F.col("cls")
        return det(s, d).select("stem", "det_id", _r(F.avg(c).over(w)).alias("mean"), _r(F.stddev_pop(c).over(w)).alias("std"), F.min(c).over(w).alias("least"), F.max(c).over(w).alias("most"), _r((c - F.avg(c).over(w)) / F.greatest(F.stddev_pop(c).over(w), F.lit(0.001))).alias("z"))

    xv = ", p AS (SELECT a.tree, a.side, a.det_id, a.stem, b.score AS v FROM det a JOIN det b ON a.tree=b.tree AND b.side=(a.side+1)%4)"
    @q("win_13_cross_view", sql(xv + " SELECT stem, det_id, max(v) AS most, round(avg(v),6) AS mean, count(*) FILTER (v>0.3) AS n3, count(*) FILTER (v>0.5) AS n5, round(list_sum(list_slice(list_reverse_sort(list(v)),1,2)),6) AS top2 FROM p GROUP BY stem, det_id"))
    def win_13(s, d):
        nxt = det(s, d).groupBy("tree", F.pmod(F.col("side") - 1, F.lit(4)).alias("side")).agg(F.sort_array(F.collect_list("score"), asc=False).alias("vs"))  # one image's boxes
        vs = F.col("vs")
        total = F.aggregate(vs, F.lit(0.0), lambda a, x: a + x)
        return det(s, d).select("tree", "side", "stem", "det_id").join(nxt, ["tree", "side"]).select("stem", "det_id", F.get(vs, F.lit(0)).alias("most"), _r(total / F.size(vs)).alias("mean"), F.size(F.filter(vs, lambda x: x > 0.3)).cast("bigint").alias("n3"),
            F.size(F.filter(vs, lambda x: x > 0.5)).cast("bigint").alias("n5"), _r(F.get(vs, F.lit(0)) + F.coalesce(F.get(vs, F.lit(1)), F.lit(0.0))).alias("top2"))

    # ------------------------------------------------------------ sorts and top-k
    @q("srt_01_ranking", "SELECT o_custkey, n, total FROM (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice),2) AS total FROM orders GROUP BY 1) ORDER BY n DESC, total, o_custkey LIMIT 30")
    def srt_01(s, d):
        g = read(s, d, "orders").groupBy("o_custkey").agg(N().alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
        return g.orderBy(F.desc("n"), "total", "o_custkey").limit(30)

    modes = {"score": "score", "support": "score*sqrt(n)", "max_member": "most", "class_conf": "score*purity", "score_power": "pow(score,0.5)*pow(purity,2)"}
    for mode, expr in modes.items():
        body = f""", c AS (SELECT tree, cls, count(*) AS n, avg(score) AS score, max(score) AS most FROM det GROUP BY ALL), p AS (SELECT *, n/sum(n) OVER (PARTITION BY tree) AS purity FROM c),
          t AS (SELECT tree, CAST(ceil(count(*)/6.0) AS INTEGER) AS target FROM gt GROUP BY tree) SELECT tree, cls FROM p JOIN t USING (tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY round({expr},9) DESC, cls) <= min(target) OVER (PARTITION BY tree)"""

        @q(f"srt_02_reconcile_{mode}", sql(body))
        def srt_02(s, d, mode=mode):
            c = det(s, d).groupBy("tree", "cls").agg(N().alias("n"), F.avg("score").alias("score"), F.max("score").alias("most"))
            p = c.withColumn("purity", F.col("n") / F.sum("n").over(Window.partitionBy("tree")))
            t = gt(s, d).groupBy("tree").agg(F.ceil(N() / 6.0).cast("int").alias("target"))
            return selection.capped(p.join(t, "tree"), "tree", [F.desc(F.round(selection.RANK_MODES[mode], 9)), F.col("cls")], "target").select("tree", "cls")

    @q("srt_03_argmin_tie", sql("SELECT tree, arg_min(det_id, (score, stem, det_id)) AS lowest, arg_max(det_id, (score, stem, det_id)) AS highest FROM det GROUP BY tree"))
    def srt_03(s, d):
        k = F.struct("score", "stem", "det_id")
        return det(s, d).groupBy("tree").agg(F.min_by("det_id", k).alias("lowest"), F.max_by("det_id", k).alias("highest"))

    @q("srt_04_stable_order", sql("SELECT stem, det_id, row_number() OVER (PARTITION BY stem ORDER BY score DESC, det_id) AS pos FROM det"))
    def srt_04(s, d):
        return det(s, d).select("stem", "det_id", F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("score"), "det_id")).alias("pos"))

    @q("srt_05_audit_best", sql("SELECT 'score' AS criterion, stem, det_id FROM (SELECT * FROM det ORDER BY score DESC, stem, det_id LIMIT 10) UNION ALL SELECT 'area', stem, det_id FROM (SELECT * FROM det ORDER BY (x2-x1)*(y2-y1) DESC, stem, det_id LIMIT 10)"))
    def srt_05(s, d):
        area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
        return selection.best_of(det(s, d), {"score": F.col("score"), "area": area}, ["stem", "det_id"], 10)

    @q("srt_06_dominates", "SELECT o_custkey FROM (SELECT o_custkey, count(*) AS n, avg(o_totalprice) AS p FROM orders GROUP BY 1) WHERE n >= (SELECT count(*) FROM orders WHERE o_custkey=1) AND p >= (SELECT avg(o_totalprice) FROM orders WHERE o_custkey=1)")
    def srt_06(s, d):
        g = read(s, d, "orders").groupBy("o_custkey").agg(N().alias("n"), F.avg("o_totalprice").alias("p"))
        return selection.dominating(g, g.where("o_custkey = 1"), ["n", "p"]).select("o_custkey")

    @q("srt_07_subset_search", "SELECT a.k AS m1, b.k AS m2, count(*) AS n FROM (SELECT DISTINCT l_suppkey % 3 AS k FROM lineitem) a JOIN (SELECT DISTINCT l_suppkey % 3 AS k FROM lineitem) b ON a.k < b.k JOIN lineitem l ON l.l_suppkey % 3 IN (a.k, b.k) GROUP BY ALL ORDER BY n DESC, m1, m2 LIMIT 1")
    def srt_07(s, d):
        per = det(s, d).groupBy("model").agg(N().alias("n"))
        return selection.best_subset(per, "model", "n", 2)

    @q("srt_08_hardest_images", sql("SELECT g.stem, count(*) AS missed FROM gt g LEFT JOIN det d ON d.stem=g.stem AND d.cls=g.cls AND d.score >= 0.6 WHERE d.stem IS NULL GROUP BY g.stem ORDER BY missed DESC, g.stem LIMIT 20"))
    def srt_08(s, d):
        sure = det(s, d).where("score >= 0.6").select("stem", "cls")
        return gt(s, d).join(sure, ["stem", "cls"], "left_anti").groupBy("stem").agg(N().alias("missed")).orderBy(F.desc("missed"), "stem").limit(20)

    @q("srt_09_weighted_objective", sql("SELECT model, round(0.55*avg(CAST(cls=1 AS INT)) + 0.40*avg(score) + 0.05*min(score),6) AS value FROM det GROUP BY model ORDER BY value DESC, model LIMIT 1"))
    def srt_09(s, d):
        v = 0.55 * F.avg((F.col("cls") == 1).cast("int")) + 0.40 * F.avg("score") + 0.05 * F.min("score")
        return det(s, d).groupBy("model").agg(_r(v).alias("value")).orderBy(F.desc("value"), "model").limit(1)

    # ------------------------------------------------------------ sets
    @q("set_01_provenance_union", "SELECT 'C_' || c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'S_' || s_suppkey, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")
    def set_01(s, d):
        c, v = read(s, d, "customer"), read(s, d, "supplier")
        first = c.where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
        b = v.select(F.concat(F.lit("S_"), "s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")).join(first, "nation", "left_anti")
        return c.select(F.concat(F.lit("C_"), "c_custkey").alias("id"), F.col("c_nationkey").alias("nation")).unionByName(b)

    @q("set_02_intersection", sql("SELECT stem FROM det WHERE model=0 INTERSECT SELECT stem FROM det WHERE model=1 INTERSECT SELECT stem FROM det WHERE model=2"))
    def set_02(s, d):
        a, b, c = (det(s, d).where(f"model = {m}").select("stem") for m in range(3))
        return a.intersect(b).intersect(c)

    @q("set_03_difference", sql("SELECT stem FROM det EXCEPT SELECT stem FROM gt"))
    def set_03(s, d):
        return det(s, d).select("stem").subtract(gt(s, d).select("stem"))

    @q("set_04_key_check", sql(", k AS (SELECT stem, line, count(*) AS n FROM det GROUP BY ALL) SELECT count(*) FILTER (n > 1) AS repeated, (SELECT count(*) FROM (SELECT DISTINCT stem FROM gt EXCEPT SELECT stem FROM det WHERE model=0)) AS missing, (SELECT count(*) FROM (SELECT DISTINCT stem FROM det WHERE model=0 EXCEPT SELECT stem FROM gt)) AS extra FROM k"))
    def set_04(s, d):
        rep = det(s, d).groupBy("stem", "line").agg(N().alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated"))
        return rep.crossJoin(selection.key_difference(det(s, d).where("model = 0"), gt(s, d), ["stem"]))  # one row each

    @q("set_05_bag_concat", sql("SELECT model, count(*) AS n FROM (SELECT 10 AS model, stem FROM det WHERE cls=0 UNION ALL SELECT 11, stem FROM det WHERE cls=1 UNION ALL SELECT 12, stem FROM gt) GROUP BY model"))
    def set_05(s, d):
        bags = [det(s, d).where("cls = 0").select("stem"), det(s, d).where("cls = 1").select("stem"), gt(s, d).select("stem")]
        return selection.bag_union(bags, "model", start=10).groupBy("model").agg(N().alias("n"))

    @q("set_06_split_overlap", "SELECT a.new_split AS split_a, b.new_split AS split_b, count(DISTINCT a.tree_id) AS trees FROM split_manifest a JOIN split_manifest b ON a.tree_id=b.tree_id AND a.new_split < b.new_split GROUP BY ALL")
    def set_06(s, d):
        m = read(s, d, "split_manifest").select("tree_id", "new_split").distinct()
        b = m.withColumnRenamed("new_split", "split_b")
        return m.withColumnRenamed("new_split", "split_a").join(b, "tree_id").where("split_a < split_b").groupBy("split_a", "split_b").agg(F.countDistinct("tree_id").alias("trees"))

    @q("set_07_fold_complement", "SELECT f.k AS fold, count(*) AS train_rows FROM orders, range(0,5) f(k) WHERE o_custkey % 5 <> f.k GROUP BY 1")
    def set_07(s, d):
        folds = F.explode(F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), lambda k: k != F.col("o_custkey") % 5))
        return read(s, d, "orders").select(folds.alias("fold")).groupBy("fold").agg(N().alias("train_rows"))

    @q("set_08_identical_models", sql(", v AS (SELECT model, cls, round(avg(score),1) AS a FROM det GROUP BY ALL) SELECT a.model AS m1, b.model AS m2, max(abs(a.a-b.a)) < 0.05 AS same FROM v a JOIN v b ON a.cls=b.cls AND a.model<b.model GROUP BY ALL"))
    def set_08(s, d):
        v = det(s, d).groupBy("model", "cls").agg(F.round(F.avg("score"), 1).alias("a"))
        return selection.same_outputs(v, "model", ["cls"], "a", 0.05)

    @q("set_09_class_routing", sql(", w AS (SELECT cls, model FROM (SELECT cls, model, avg(score) AS v FROM det GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cls ORDER BY v DESC, model)=1) SELECT stem, det_id, cls, model FROM det SEMI JOIN w USING (cls, model)"))
    def set_09(s, d):
        w = det(s, d).groupBy("cls", "model").agg(F.avg("score").alias("v")).groupBy("cls").agg(F.max_by("model", F.struct("v", -F.col("model"))).alias("model"))
        return det(s, d).join(F.broadcast(w), ["cls", "model"], "left_semi").select("stem", "det_id", "cls", "model")  # one row a class
