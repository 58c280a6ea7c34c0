"""Queries of models, resampling and audits (MLX, RSM, VAL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovekit.operators import aggregates as A
from grovekit.operators import calibration, checks
from grovekit.operators import models as M
from grovekit.operators import resample as R
from grovekit.operators import selection
from grovekit.plans.joins import greedy_sql
from grovekit.plans.registry import Registry
from grovekit.plans.roles import det, gt, probs, sql
from grovekit.scale import Workspace, read

FEATURES = ["n", "s", "m", "n5"]


def _r(c, n: int = 6):
    return F.round(c, n)


def trees(s, d):
    """(tree, n, s, m, n5, y, fold): a tree's detections summed up, and its number of true boxes."""
    c = F.col("score")
    x = det(s, d).groupBy("tree").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("score").alias("s"), F.max("score").alias("m"), F.count_if(c >= 0.5).cast("double").alias("n5"))
    y = gt(s, d).groupBy("tree").agg(F.count(F.lit(1)).cast("double").alias("y"))
    return x.join(y, "tree", "left").withColumn("y", F.coalesce("y", F.lit(0.0))).withColumn("fold", (F.col("tree") % 5).cast("int"))


TREES = ", t AS (SELECT tree, CAST(count(*) AS DOUBLE) AS n, sum(score) AS s FROM det GROUP BY tree), ty AS (SELECT tree, CAST(count(*) AS DOUBLE) AS y FROM gt GROUP BY tree), x AS (SELECT tree, n, coalesce(y,0) AS y FROM t LEFT JOIN ty USING (tree))"
PARTS = ", pp AS (SELECT tree, CAST(count(*) FILTER (cls=1) AS DOUBLE) AS a, CAST(count(*) FILTER (score>=0.5) AS DOUBLE) AS b, CAST(count(*) AS DOUBLE) AS n FROM det GROUP BY tree)"
REPLICATES = 200


def weights_sql(entities: str, replicates: int = REPLICATES) -> str:
    """Common tables ending in ``dr`` (tree, rep, times): Poisson numbers by counting down from the law's probabilities."""
    law = ", ".join(f"({k}, {c!r})" for k, c in enumerate(R.POISSON))
    return f""", law AS (SELECT * FROM (VALUES {law}) t(k, below)),
  dg AS (SELECT tree, k, md5('42:' || tree || ':' || k) AS h FROM {entities}, range(0, {-(-replicates // 4)}) r(k)),
  us AS (SELECT tree, k * 4 + i AS rep, CAST(CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM dg, range(0, 4) r(i)),
  dr AS (SELECT tree, rep, u, (SELECT count(*) FROM law WHERE below <= u) AS times FROM us WHERE rep < {replicates})"""


def partials(s, d):
    return det(s, d).groupBy("tree").agg(F.count_if(F.col("cls") == 1).cast("double").alias("a"), F.count_if(F.col("score") >= 0.5).cast("double").alias("b1"), F.count(F.lit(1)).cast("double").alias("n"))


def f1_partials(s, d):
    """(tree, cls, tp, n_pred, n_true) of the one-to-one matches, regardless of class, of each image."""
    from grovekit.operators import matching
    p, t = det(s, d).select("tree", "stem", "det_id", "cls"), gt(s, d).select("tree", "stem", "gt_id", "cls")
    m = matching.match_one_to_one(det(s, d), gt(s, d), ["stem"], 0.5).select("stem", "det_id", "gt_id")
    hit = m.join(p, ["stem", "det_id"]).join(t.select("stem", "gt_id", F.col("cls").alias("tc")), ["stem", "gt_id"]).where("cls = tc")
    one = lambda df, k: df.select("tree", "cls", *[F.lit(float(c == k)).alias(c) for c in ("tp", "n_pred", "n_true")])
    return one(hit, "tp").union(one(p, "n_pred")).union(one(t, "n_true")).groupBy("tree", "cls").agg(*[F.sum(c).alias(c) for c in ("tp", "n_pred", "n_true")])


def pair_rows(s, d):
    """Pairs of boxes of neighbouring sides with a label: the same class."""
    a = det(s, d).select("tree", "side", F.col("cls").alias("ca"), F.col("y1").alias("ya"), F.col("score").alias("sa"))
    b = det(s, d).select("tree", F.pmod(F.col("side") - 1, F.lit(4)).alias("side"), "cls", "y1", "score")
    x = a.join(b, ["tree", "side"])
    return x.select("tree", F.abs(F.col("ya") - F.col("y1")).alias("dy"), F.least("sa", "score").alias("smin"), (F.col("ca") == F.col("cls")).cast("int").alias("same")).withColumn("dy", F.col("dy") / 100)


def register(reg: Registry) -> None:
    q = reg.query

    @q("mlx_01_ridge_cv")
    def mlx_01(s, d):
        t = Workspace(s, "ridge").save(trees(s, d), "t")
        a, b, w, _ = M.ridge_cv(t, FEATURES, "y", "fold", [0.1, 1.0, 10.0, 100.0])
        return t.select("tree", F.lit(a).alias("alpha"), F.greatest(F.rint(M.predict(FEATURES, b, w)), F.lit(0.0)).cast("bigint").alias("count"))

    @q("mlx_01_least_squares", sql(TREES + " SELECT tree, round(regr_intercept(y, n) OVER () + regr_slope(y, n) OVER () * n, 6) AS est FROM x"))
    def mlx_01b(s, d):
        t = trees(s, d)
        b, w = M.solve_ridge(M.gram(t, ["n"], "y")[None], 0.0)
        return t.select("tree", _r(M.predict(["n"], b, w)).alias("est"))

    @q("mlx_02_ridge_gcv")
    def mlx_02(s, d):
        t = Workspace(s, "ridge").save(trees(s, d), "t")
        a, b, w = M.ridge_gcv(t, FEATURES, "y", [0.01, 0.1, 1.0, 10.0, 100.0, 500.0])
        return t.select("tree", F.lit(a).alias("alpha"), _r(M.predict(FEATURES, b, w), 4).alias("est"))

    @q("mlx_03_pair_logistic")
    def mlx_03(s, d):
        x = Workspace(s, "pairs").save(M.balanced_weights(pair_rows(s, d), "same"), "x")
        b, w = M.logistic(x, ["dy", "smin"], "same", "weight")
        return A.auc(x.withColumn("p", M.predict(["dy", "smin"], b, w)), "p", F.col("same") == 1).select(_r(F.col("auc"), 5).alias("auc"))

    @q("mlx_04_tree_ensembles")
    def mlx_04(s, d):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
        t = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(Workspace(s, "ens").save(trees(s, d), "t"))
        out = None
        for name, est in (("gbt", GBTRegressor(labelCol="y", maxIter=5, maxDepth=3, seed=1)), ("forest", RandomForestRegressor(labelCol="y", numTrees=10, maxDepth=4, seed=1))):
            got = est.fit(t.where("fold <> 0")).transform(t.where("fold = 0")).agg(F.lit(name).alias("model"), _r(F.avg(F.abs(F.col("prediction") - F.col("y"))), 3).alias("mae"))
            out = got if out is None else out.union(got)
        return out

    @q("mlx_05_per_class_boosting")
    def mlx_05(s, d):
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.regression import GBTRegressor
        x = A.class_counts(det(s, d), ["tree"], "cls", 4).groupBy("tree").pivot("cls", [0, 1, 2, 3]).agg(F.max("n"))
        y = A.class_counts(gt(s, d), ["tree"], "cls", 4).withColumnRenamed("n", "y")
        t = Workspace(s, "boost").save(y.join(x, "tree"), "t")
        v = VectorAssembler(inputCols=["0", "1", "2", "3"], outputCol="features").transform(t)
        out = None
        for k in range(4):
            m = GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1).fit(v.where(f"cls = {k} and tree % 5 <> 0"))
            got = m.transform(v.where(f"cls = {k} and tree % 5 = 0")).agg(F.lit(k).alias("cls"), _r(F.avg(F.abs(F.rint("prediction") - F.col("y"))), 3).alias("mae"))
            out = got if out is None else out.union(got)
        return out

    @q("mlx_06_out_of_fold")
    def mlx_06(s, d):
        t = Workspace(s, "oof").save(trees(s, d).withColumn("many", (F.col("y") >= 7).cast("int")), "t")
        return M.out_of_fold(t, ["n", "n5"], "many", "fold", range(5)).select("tree", "fold", _r(F.col("oof"), 5).alias("oof"))

    @q("mlx_07_stacking")
    def mlx_07(s, d):
        ws = Workspace(s, "stack")
        t = ws.save(trees(s, d).withColumn("many", (F.col("y") >= 7).cast("int")), "t")
        o = ws.save(M.out_of_fold(t, ["n"], "many", "fold", range(5)).withColumnRenamed("oof", "o1"), "o1")
        o = ws.save(M.out_of_fold(o, ["n5"], "many", "fold", range(5)).withColumnRenamed("oof", "o2"), "o2")
        return A.auc(M.out_of_fold(o, ["o1", "o2"], "many", "fold", range(5)), "oof", F.col("many") == 1).select(_r(F.col("auc"), 5).alias("auc"))

    @q("mlx_08_bagged_selection")
    def mlx_08(s, d):
        t = Workspace(s, "bag").save(trees(s, d).select("tree", (F.col("n") * 0.45).alias("e1"), (F.col("n5") * 0.8).alias("e2"), F.col("s").alias("e3"), "y"), "t")
        share = M.bagged_selection(t, ["e1", "e2", "e3"], "y", 3, 4, "tree")
        return s.createDataFrame(sorted(share.items()), "member string, share double")

    @q("mlx_09_dynamic_selection", sql(", v AS (SELECT tree, model, arg_max(cls, (score, det_id)) AS c, max(score) AS sure FROM det GROUP BY ALL) SELECT tree, arg_max(c, (sure, model)) AS cls, count(DISTINCT c) = 1 AS agreed FROM v GROUP BY tree"))
    def mlx_09(s, d):
        v = det(s, d).groupBy("tree", "model").agg(F.max_by("cls", F.struct("score", "det_id")).alias("c"), F.max("score").alias("sure"))
        return v.groupBy("tree").agg(F.max_by("c", F.struct("sure", "model")).alias("cls"), (F.countDistinct("c") == 1).alias("agreed"))

    @q("mlx_10_clusters")
    def mlx_10(s, d):
        return M.clusters(read(s, d, "embeddings"), "embedding", 8, "label").select("cluster", "n", "majority", _r(F.col("purity"), 4).alias("purity"))

    @q("mlx_10_projection")
    def mlx_10p(s, d):
        return M.principal(read(s, d, "embeddings"), ["vec_id", "label"], "embedding", 3)

    @q("mlx_11_calibrator")
    def mlx_11(s, d):
        p = Workspace(s, "cal").save(probs(det(s, d)).select("p", ((F.col("cls") + (F.col("det_id") % 3 == 0).cast("int")) % 4).alias("t")), "p")
        w, b = M.fit_calibrator(p, "p", "t", 4, steps=12)
        return s.createDataFrame([(i, [round(float(x), 5) for x in w[i]], round(float(b[i]), 5)) for i in range(4)], "cls int, w array<double>, b double")

    @q("mlx_12_cluster_ranker")
    def mlx_12(s, d):
        g = det(s, d).groupBy("tree", "cls").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("score").alias("score"), F.max("score").alias("most"))
        good = gt(s, d).select("tree", "cls").distinct().withColumn("good", F.lit(1))
        x = Workspace(s, "rank").save(g.join(good, ["tree", "cls"], "left").withColumn("good", F.coalesce("good", F.lit(0))), "x")
        b, w = M.logistic(x, ["n", "score", "most"], "good")
        return selection.top_k(x.withColumn("quality", _r(M.predict(["n", "score", "most"], b, w), 5)), ["tree"], [F.desc("quality"), F.col("cls")], 2).select("tree", "cls", "quality")

    @q("mlx_13_ordinal_probe")
    def mlx_13(s, d):
        parts = [f"e{i}" for i in range(64)]
        whole = read(s, d, "embeddings")
        b, w = M.solve_ridge(M.gram_vector(whole, "embedding", "label", len(parts)), 1.0)
        e = whole.select("label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(parts)])
        z = e.select(F.least("label", F.lit(3)).alias("label"), F.rint(M.predict(parts, b, w) * 4).cast("int").alias("g"))
        return calibration.best_cut_triple(z, "g", "label")

    @q("mlx_15_sample_weights", sql(", c AS (SELECT count(*) FILTER (cls=3) AS p, count(*) AS n FROM det) SELECT CAST(cls=3 AS INTEGER) AS pos, count(*) AS rows, round(max(CASE WHEN cls=3 THEN least(30.0, (n-p)/CAST(greatest(p,1) AS DOUBLE)) ELSE 1 END),6) AS weight FROM det, c GROUP BY 1"))
    def mlx_15(s, d):
        w = M.balanced_weights(det(s, d).select((F.col("cls") == 3).cast("int").alias("pos")), "pos")
        return w.groupBy("pos").agg(F.count(F.lit(1)).alias("rows"), _r(F.max("weight")).alias("weight"))

    # 10,000 replicates of a ratio take as long in SQL as all other twins together; the operators take any number
    boot = PARTS + weights_sql("(SELECT tree FROM pp)")

    @q("rsm_01_bootstrap_ratio", sql(boot + " SELECT rep AS b, round(sum(a*times)/sum(n*times),6) AS value FROM dr JOIN pp USING (tree) GROUP BY rep"))
    def rsm_01(s, d):
        return R.bootstrap_ratio(partials(s, d), ["tree"], "a", "n", REPLICATES).select("b", _r(F.col("value")).alias("value"))

    macro = """, pc AS (SELECT tree, cls, CAST(sum(tp) AS DOUBLE) AS tp, CAST(sum(np) AS DOUBLE) AS np, CAST(sum(nt) AS DOUBLE) AS nt FROM (
        SELECT d.tree, d.cls, 1 AS tp, 0 AS np, 0 AS nt FROM fin f JOIN det d ON d.stem=f.stem AND d.det_id=f.det_id JOIN gt g ON g.stem=f.stem AND g.gt_id=f.gt_id WHERE d.cls=g.cls
        UNION ALL SELECT tree, cls, 0, 1, 0 FROM det UNION ALL SELECT tree, cls, 0, 0, 1 FROM gt) GROUP BY ALL)"""
    @q("rsm_01b_interval", greedy_sql(macro + weights_sql("(SELECT DISTINCT tree FROM pc)") + """, v AS (SELECT rep, avg(2*tp/greatest(np+nt,1)) AS v FROM (SELECT rep, cls, sum(tp*times) AS tp, sum(np*times) AS np, sum(nt*times) AS nt FROM dr JOIN pc USING (tree) WHERE times > 0 GROUP BY ALL) GROUP BY rep)
      SELECT count(*) AS n, round(avg(v),6) AS mean, round(quantile_cont(v,0.025),6) AS lo, round(quantile_cont(v,0.975),6) AS hi FROM v"""))
    def rsm_01b(s, d):
        """Interval of the macro F1, resampling trees."""
        return R.interval(R.bootstrap_macro_f1(f1_partials(s, d), ["tree"], REPLICATES), "value").select("n", *[_r(F.col(c)).alias(c) for c in ("mean", "lo", "hi")])

    @q("rsm_02_paired", sql(boot + " SELECT rep AS b, round(sum(pp.b*times)/sum(n*times) - sum(a*times)/sum(n*times),6) AS delta FROM dr JOIN pp USING (tree) GROUP BY rep"))
    def rsm_02(s, d):
        return R.paired_bootstrap(partials(s, d), ["tree"], "a", "b1", "n", REPLICATES).select("b", _r(F.col("delta")).alias("delta"))

    @q("rsm_03_map_bootstrap")
    def rsm_03(s, d):
        from grovekit.operators import matching
        ws = Workspace(s, "mapboot")
        m = ws.save(matching.match_one_to_one(det(s, d), gt(s, d), ["stem", "cls"], 0.5).select("stem", "cls", "det_id", F.lit(True).alias("tp")), "matches")
        ws.release()
        flags = det(s, d).join(m, ["stem", "cls", "det_id"], "left").select("stem", "cls", "score", F.struct("stem", "det_id").alias("tie"), F.coalesce("tp", F.lit(False)).alias("tp"))
        truths = gt(s, d).groupBy("stem", "cls").agg(F.count(F.lit(1)).alias("n"))
        return R.bootstrap_ap(flags, truths, 500, ws).groupBy("b").agg(_r(F.avg("ap"), 5).alias("map50"))

    @q("rsm_04_folds", sql("SELECT CAST(tree % 5 AS INTEGER) AS fold, count(*) AS n, count(DISTINCT tree) AS trees FROM det GROUP BY 1"))
    def rsm_04(s, d):
        return det(s, d).groupBy((F.col("tree") % 5).cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tree").alias("trees"))

    @q("rsm_05_jitter")
    def rsm_05(s, d):
        return R.jitter(det(s, d).select("stem", "det_id", "x1", "y1", "x2", "y2"), 2.0, 0.15, 7)

    @q("rsm_06_label_noise")
    def rsm_06(s, d):
        n = R.spoil_labels(det(s, d), "cls", 4, 0.1, ["stem", "det_id"], 3)
        return n.agg(F.count(F.lit(1)).alias("n"), _r(F.avg((F.col("noisy") == F.col("cls")).cast("int")), 4).alias("agreement"))

    @q("rsm_07_donors", sql(", t AS (SELECT DISTINCT tree FROM det) SELECT tree, coalesce(lead(tree) OVER (ORDER BY tree), min(tree) OVER ()) AS donor FROM t"))
    def rsm_07(s, d):
        return R.donors(det(s, d), "tree")

    @q("rsm_08_transfer", sql(", k AS (SELECT model, sum(CAST(line%2=0 AS INT))/CAST(count(*) AS DOUBLE) AS k FROM det GROUP BY model) SELECT k.model AS source, t.model AS target, round(abs(k.k*t.n - t.y),6) AS error FROM k, (SELECT model, count(*) AS n, sum(CAST(line%2=0 AS INT)) AS y FROM det GROUP BY model) t WHERE k.model <> t.model"))
    def rsm_08(s, d):
        t = det(s, d).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("line") % 2 == 0).cast("int")).alias("y"))
        k = t.select(F.col("model").alias("source"), (F.col("y") / F.col("n").cast("double")).alias("k"))
        return k.join(F.broadcast(t), F.col("source") != F.col("model")).select("source", F.col("model").alias("target"), _r(F.abs(F.col("k") * F.col("n") - F.col("y"))).alias("error"))  # three models

    @q("val_01_audit", "SELECT count(*) AS n, count(*) FILTER (tree_id IS NULL OR trim(tree_id)='') AS unnamed, count(*) FILTER (doc_no IS NULL) AS without_document, count(*) FILTER (B1 < 0 OR B2 < 0 OR B3 < 0 OR B4 < 0) AS negative, (SELECT count(*) FROM (SELECT tree_id FROM split_manifest GROUP BY 1 HAVING count(DISTINCT new_split) > 1)) AS trees_in_several_splits FROM split_manifest")
    def val_01(s, d):
        m = read(s, d, "split_manifest")
        several = m.groupBy("tree_id").agg(F.countDistinct("new_split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("trees_in_several_splits"))
        bad = (F.col("B1") < 0) | (F.col("B2") < 0) | (F.col("B3") < 0) | (F.col("B4") < 0)
        return m.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tree_id").isNull() | (F.trim("tree_id") == "")).alias("unnamed"), F.count_if(F.col("doc_no").isNull()).alias("without_document"), F.count_if(bad).alias("negative")).crossJoin(several)  # one row each

    # Recorded row counts of the two tables whose size is the same at every scale.
    anchors = {"region": 5, "nation": 25}

    @q("val_02_anchor", "SELECT 'region' AS name, true AS reproduced, count(*) AS n FROM region UNION ALL SELECT 'nation', true, count(*) FROM nation")
    def val_02(s, d):
        one = lambda t: checks.anchored(read(s, d, t).agg(F.count(F.lit(1)).alias("n")), "n", float(anchors[t]), 0.5).select(F.lit(t).alias("name"), F.lit(True).alias("reproduced"), "n")
        return one("region").union(one("nation"))

    @q("val_03_lock")
    def val_03(s, d):
        import uuid
        lock = f"{Workspace(s, 'lock').path('test')}-{uuid.uuid4().hex}"
        first, again = checks.take_lock(s, lock), checks.take_lock(s, lock)
        return s.createDataFrame([(first, again)], "first boolean, again boolean")

    @q("val_04_corrupt", "SELECT count(*) AS files, count(*) FILTER (NOT json_valid(ltrim(body, chr(65279)))) AS unreadable FROM tree_raw")
    def val_04(s, d):
        from grovekit.operators.nested import parse_document

        @F.pandas_udf("boolean")
        def bad(v):
            return v.map(lambda b: parse_document(b) is None)
        return read(s, d, "tree_raw").agg(F.count(F.lit(1)).alias("files")).crossJoin(read(s, d, "tree_raw").select(bad("body").alias("x")).agg(F.count_if("x").alias("unreadable")))  # one row each
