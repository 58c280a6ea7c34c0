"""Queries of joins (JON)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grovekit.functions.boxes import CORNERS
from grovekit.functions.names import split_name, tree_key
from grovekit.operators import checks, matching
from grovekit.plans.registry import Registry
from grovekit.plans.roles import det, gt, iou_sql, sql
from grovekit.scale import read


def _r(c, n: int = 6):
    return F.round(c, n)


GREEDY = """, pairs AS (SELECT a.stem, a.det_id, b.gt_id, {iou} AS v, row_number() OVER (PARTITION BY a.stem ORDER BY a.score DESC, a.det_id, {iou} DESC, b.gt_id DESC) AS k
  FROM det a JOIN gt b ON a.stem = b.stem WHERE {iou} >= 0.5),
g AS (
  SELECT stem, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used_d, CAST([] AS BIGINT[]) AS used_g FROM (SELECT DISTINCT stem FROM pairs)
  UNION ALL
  SELECT g.stem, p.k, CASE WHEN list_contains(used_d, p.det_id) OR list_contains(used_g, p.gt_id) THEN used_d ELSE list_append(used_d, p.det_id) END,
    CASE WHEN list_contains(used_d, p.det_id) OR list_contains(used_g, p.gt_id) THEN used_g ELSE list_append(used_g, p.gt_id) END
  FROM g JOIN pairs p ON p.stem = g.stem AND p.k = g.k + 1),
fin AS (SELECT stem, unnest(used_d) AS det_id, unnest(used_g) AS gt_id FROM g QUALIFY row_number() OVER (PARTITION BY stem ORDER BY k DESC) = 1)"""


def greedy_sql(body: str) -> str:
    return sql(GREEDY.replace("{iou}", iou_sql("a", "b")) + body)


def counts(s, d):
    pred = det(s, d).where("score >= 0.3").groupBy("tree").agg(F.count(F.lit(1)).alias("n_pred"))
    true = gt(s, d).groupBy("tree").agg(F.count(F.lit(1)).alias("n_true"))
    return pred, true


COUNTS = ", pc AS (SELECT tree, count(*) AS n_pred FROM det WHERE score >= 0.3 GROUP BY tree), tc AS (SELECT tree, count(*) AS n_true FROM gt GROUP BY tree)"


def register(reg: Registry) -> None:
    q = reg.query

    @q("jon_01_tree_equi", sql(COUNTS + "SELECT tree, n_pred, n_true FROM pc JOIN tc USING (tree)"))
    def jon_01(s, d):
        p, t = counts(s, d)
        return p.join(t, "tree")

    @q("jon_02_left_default", sql(COUNTS + "SELECT tree, coalesce(n_pred, 0) AS n_pred, n_true FROM tc LEFT JOIN pc USING (tree)"))
    def jon_02(s, d):
        p, t = counts(s, d)
        return t.join(p, "tree", "left").select("tree", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), "n_true")

    @q("jon_03_image_intersection", sql("SELECT count(DISTINCT d.stem) AS n_images, count(DISTINCT g.gt_id || '/' || g.stem) AS n_gt FROM gt g JOIN (SELECT DISTINCT stem FROM det WHERE score >= 0.5) d ON g.stem = d.stem"))
    def jon_03(s, d):
        seen = det(s, d).where("score >= 0.5").select("stem").distinct()
        return gt(s, d).join(seen, "stem", "left_semi").agg(F.countDistinct("stem").alias("n_images"), F.countDistinct("gt_id", "stem").alias("n_gt"))

    theta = f"SELECT a.stem, a.det_id, b.gt_id, round({iou_sql('a', 'b')},6) AS iou FROM det a JOIN gt b ON a.stem = b.stem WHERE {iou_sql('a', 'b')} >= 0.3"
    @q("jon_04_theta_iou", sql(theta))
    def jon_04(s, d):
        return matching.theta_join(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id", 0.3).select("stem", "det_id", "gt_id", _r(F.col("iou")).alias("iou"))

    @q("jon_04_theta_grid", sql(theta))
    def jon_04g(s, d):
        return matching.theta_join(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id", 0.3, cell=128.0).select("stem", "det_id", "gt_id", _r(F.col("iou")).alias("iou"))

    @q("jon_05_nearest", sql(f"SELECT stem, det_id, gt_id, round(v,6) AS iou FROM (SELECT a.stem, a.det_id, b.gt_id, {iou_sql('a', 'b')} AS v FROM det a JOIN gt b ON a.stem=b.stem) WHERE v >= 0.3 QUALIFY row_number() OVER (PARTITION BY stem, det_id ORDER BY v DESC, gt_id) = 1"))
    def jon_05(s, d):
        return matching.nearest_join(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id", 0.3).select("stem", "det_id", "gt_id", _r(F.col("iou")).alias("iou"))

    @q("jon_06_greedy_match", greedy_sql("SELECT stem, det_id, gt_id FROM fin"))
    def jon_06(s, d):
        return matching.match_one_to_one(det(s, d), gt(s, d), ["stem"], 0.5).select("stem", "det_id", "gt_id")

    @q("jon_07_optimal_match")
    def jon_07(s, d):
        return matching.match_one_to_one(det(s, d), gt(s, d), ["stem"], 0.5, method="optimal").select("stem", "det_id", "gt_id", _r(F.col("iou")).alias("iou"))

    @q("jon_08_cross_side", sql("SELECT a.tree, a.det_id AS i, b.det_id AS j, a.side AS side_i, b.side AS side_j FROM det a JOIN det b ON a.tree = b.tree AND a.side < b.side WHERE a.score >= 0.5 AND b.score >= 0.5"))
    def jon_08(s, d):
        b = det(s, d).where("score >= 0.5").select("tree", "side", "det_id")
        j = b.select("tree", F.col("side").alias("side_j"), F.col("det_id").alias("j"))
        return b.withColumnsRenamed({"side": "side_i", "det_id": "i"}).join(j, "tree").where("side_i < side_j").select("tree", "i", "j", "side_i", "side_j")

    @q("jon_09_ring_neighbours", sql(", n AS (SELECT tree, count(DISTINCT side) AS s, max(side)+1 AS m FROM det GROUP BY tree) SELECT a.tree, a.det_id AS i, b.det_id AS j FROM det a JOIN n USING (tree) JOIN det b ON b.tree = a.tree AND b.side = (a.side+1)%n.m WHERE n.m > 1 AND a.score >= 0.5 AND b.score >= 0.5"))
    def jon_09(s, d):
        every = det(s, d)
        n = every.groupBy("tree").agg((F.max("side") + 1).alias("m")).where("m > 1")
        b = every.where("score >= 0.5").select("tree", "side", "det_id")
        a = b.join(n, "tree").select("tree", F.pmod(F.col("side") + 1, F.col("m")).alias("side"), F.col("det_id").alias("i"))
        return a.join(b.withColumnRenamed("det_id", "j"), ["tree", "side"]).select("tree", "i", "j")

    kind = "CASE WHEN max(v) IS NULL THEN 'orphan' WHEN max(v) >= 0.5 THEN 'hit' WHEN max(v) >= 0.2 THEN 'shifted' ELSE 'nested' END"
    @q("jon_10_containment", sql(f", c AS (SELECT a.stem, a.det_id, {iou_sql('a', 'b')} AS v FROM det a JOIN gt b ON a.stem=b.stem AND (a.x1+a.x2)/2 BETWEEN b.x1 AND b.x2 AND (a.y1+a.y2)/2 BETWEEN b.y1 AND b.y2) SELECT kind, count(*) AS n FROM (SELECT d.stem, d.det_id, {kind} AS kind FROM det d LEFT JOIN c ON d.stem=c.stem AND d.det_id=c.det_id GROUP BY ALL) GROUP BY kind"))
    def jon_10(s, d):
        best = matching.contained(det(s, d), gt(s, d), ["stem"], "det_id", "gt_id").groupBy("stem", "det_id").agg(F.max("iou").alias("v"))
        k = F.when(F.col("v").isNull(), "orphan").when(F.col("v") >= 0.5, "hit").when(F.col("v") >= 0.2, "shifted").otherwise("nested")
        return det(s, d).select("stem", "det_id").join(best, ["stem", "det_id"], "left").groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))

    @q("jon_11_group_weight", sql(f"SELECT a.tree, a.cls, b.bunch, round(max({iou_sql('a', 'b')}),6) AS weight FROM det a JOIN gt b ON a.tree=b.tree AND a.side=b.side WHERE {iou_sql('a', 'b')} >= 1e-12 GROUP BY ALL"))
    def jon_11(s, d):
        return matching.group_weight(det(s, d), gt(s, d), ["tree", "side"], "cls", "bunch", "det_id", "gt_id").withColumn("weight", _r(F.col("weight")))

    @q("jon_12_anti", greedy_sql("SELECT 'fp' AS kind, stem, det_id AS id FROM det WHERE (stem, det_id) NOT IN (SELECT (stem, det_id) FROM fin) UNION ALL SELECT 'fn', stem, gt_id FROM gt WHERE (stem, gt_id) NOT IN (SELECT (stem, gt_id) FROM fin)"))
    def jon_12(s, d):
        m = matching.match_one_to_one(det(s, d), gt(s, d), ["stem"], 0.5).select("stem", "det_id", "gt_id")
        fp = det(s, d).join(m, ["stem", "det_id"], "left_anti").select(F.lit("fp").alias("kind"), "stem", F.col("det_id").alias("id"))
        return fp.union(gt(s, d).join(m, ["stem", "gt_id"], "left_anti").select(F.lit("fn"), "stem", "gt_id"))

    @q("jon_13_leakage", r"""WITH p AS (SELECT row_id, lower(regexp_replace(new_split, '^[\s\x{FEFF}\x{00A0}\x{200B}]+|[\s\x{FEFF}\x{00A0}\x{200B}]+$', '', 'g')) AS s, trim(regexp_replace(regexp_replace(lower(tree_id), '[\x{FEFF}\x{200B}]', '', 'g'), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS t FROM split_manifest),
      k AS (SELECT row_id, s, CASE WHEN regexp_matches(t, '^[a-z]+_[a-z]+[0-9]+[a-z]*_0*[0-9]+(?:_.*|[a-z].*)?$') THEN regexp_replace(t, '^([a-z]+)_([a-z]+[0-9]+[a-z]*)_0*([0-9]+)(?:_.*|[a-z].*)?$', '\1|\2|\3') WHEN t <> '' THEN t END AS tree FROM p)
      SELECT row_id FROM k WHERE s IN ('test','testing','uji','pengujian') AND coalesce(tree NOT IN (SELECT tree FROM k WHERE s IN ('train','training','latih','pelatihan','val','valid','validation','validasi') AND tree IS NOT NULL), true)""")
    def jon_13(s, d):
        """Test rows whose tree is in neither training nor validation rows; splits and trees are read by their meaning."""
        m = read(s, d, "split_manifest").select("row_id", split_name(F.col("new_split")).alias("s"), tree_key(F.col("tree_id")).alias("tree"))
        return m.where("s = 'test'").join(m.where("s in ('train', 'val')").select("tree"), "tree", "left_anti").select("row_id")

    @q("jon_14_dimension", "SELECT b.box_id, coalesce(r.variety, 'UNKNOWN') AS variety FROM (SELECT DISTINCT box_id, tree_id FROM gt_boxes) b LEFT JOIN reference_trees r USING (tree_id)")
    def jon_14(s, d):
        dim = read(s, d, "reference_trees").select("tree_id", "variety")  # eight rows by definition: small at every scale
        return read(s, d, "gt_boxes").select("box_id", "tree_id").distinct().join(F.broadcast(dim), "tree_id", "left").select("box_id", F.coalesce("variety", F.lit("UNKNOWN")).alias("variety"))

    prior = ", prior AS (SELECT * FROM (VALUES (1, 0.1, 0.2), (2, 0.3, 0.1)) t(turn, mu, sd))"
    @q("jon_15_prior_lookup", sql(prior + "SELECT stem, det_id, round((score - coalesce(CAST(mu AS DOUBLE), 0))/coalesce(CAST(sd AS DOUBLE), 0.5),6) AS z FROM det LEFT JOIN prior ON det.side = prior.turn"))
    def jon_15(s, d):
        pr = s.createDataFrame([(1, 0.1, 0.2), (2, 0.3, 0.1)], "side int, mu double, sd double")
        return det(s, d).join(F.broadcast(pr), "side", "left").select("stem", "det_id", _r((F.col("score") - F.coalesce("mu", F.lit(0.0))) / F.coalesce("sd", F.lit(0.5))).alias("z"))

    @q("jon_16_config_grid", sql("SELECT CAST(f.t AS DOUBLE)/10 AS floor, m.c AS cls, count(*) AS n FROM det, range(1,10) f(t), range(0,4) m(c) WHERE score >= CAST(f.t AS DOUBLE)/10 AND cls = m.c GROUP BY ALL"))
    def jon_16(s, d):
        grid = s.range(1, 10).select((F.col("id") / 10).alias("floor"))  # nine settings
        return det(s, d).select("score", "cls").join(F.broadcast(grid), F.col("score") >= F.col("floor")).groupBy("floor", F.col("cls").cast("bigint").alias("cls")).agg(F.count(F.lit(1)).alias("n"))

    knn_sql = """WITH e AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings),
      s AS (SELECT a.vec_id, b.vec_id AS other, b.label, round(list_dot_product(a.v,b.v)/(sqrt(list_dot_product(a.v,a.v))*sqrt(list_dot_product(b.v,b.v))),6) AS sim FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
      k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, other) AS rank FROM s)
      SELECT vec_id, other, label, rank, sim FROM k WHERE rank <= 7"""
    @q("jon_17_knn_cosine", knn_sql)
    def jon_17(s, d):
        from grovekit.operators.neighbours import knn
        e = read(s, d, "embeddings")
        return knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 7, keep=["label"])

    @q("jon_17_votes", knn_sql.replace("SELECT vec_id, other, label, rank, sim FROM k WHERE rank <= 7", """, v AS (SELECT vec_id, kk, label, count(*) AS n, sum(1/greatest(1-sim,1e-6)) AS w FROM k, (VALUES (3),(7),(15)) t(kk) WHERE rank <= kk GROUP BY ALL)
      SELECT vec_id, kk AS k, first(label ORDER BY round(n,6) DESC, label) AS uniform, first(label ORDER BY round(w,6) DESC, label) AS weighted FROM v GROUP BY ALL""").replace("rank FROM s)\n      , v", "rank FROM s), v"))
    def jon_17v(s, d):
        from grovekit.operators.neighbours import knn, votes
        e = read(s, d, "embeddings")
        return votes(knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 15, keep=["label"]), "vec_id", "label", [3, 7, 15])

    @q("jon_17_prototypes", """WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding,1) AS i FROM embeddings)
      SELECT label, CAST(i-1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)),6) AS mean FROM e GROUP BY ALL""")
    def jon_17p(s, d):
        return read(s, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x")).groupBy("label", "pos").agg(_r(F.avg(F.col("x").cast("double"))).alias("mean"))

    @q("jon_18_alignment", sql(", a AS (SELECT stem, count(*) AS n FROM det WHERE model=0 GROUP BY 1), b AS (SELECT stem, count(*) AS n FROM det WHERE model=1 GROUP BY 1) SELECT count(*) FILTER (b.n IS NULL) AS only_left, count(*) FILTER (a.n IS NULL) AS only_right, count(*) FILTER (a.n <> b.n) AS differing FROM a FULL JOIN b USING (stem)"))
    def jon_18(s, d):
        a, b = (det(s, d).where(f"model = {m}").groupBy("stem").agg(F.count(F.lit(1)).alias("n")) for m in (0, 1))
        return checks.aligned(a, b, ["stem"], ["n"])

    @q("jon_19_paired_entities", "SELECT c.o_custkey, c.o_orderkey AS first_order, n.o_orderkey AS later_order FROM orders c JOIN orders n ON c.o_custkey = n.o_custkey AND c.o_orderdate < n.o_orderdate AND c.o_orderstatus = 'F' AND n.o_orderstatus = 'P'")
    def jon_19(s, d):
        o = read(s, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
        n = o.where("o_orderstatus = 'P'").select("o_custkey", F.col("o_orderkey").alias("later_order"), F.col("o_orderdate").alias("_then"))
        return o.where("o_orderstatus = 'F'").join(n, "o_custkey").where("o_orderdate < _then").select("o_custkey", F.col("o_orderkey").alias("first_order"), "later_order")

    @q("jon_20_pair_order", sql("SELECT CASE WHEN a.side=b.side THEN 'same image' ELSE 'same tree' END AS kind, count(*) AS n, round(avg(CASE WHEN a.score<b.score THEN 1.0 WHEN a.score=b.score THEN 0.5 ELSE 0 END),9) AS p FROM det a JOIN det b ON a.tree=b.tree AND a.cls < b.cls GROUP BY 1"))
    def jon_20(s, d):
        a = det(s, d).select("tree", F.col("side").alias("sa"), F.col("cls").alias("ca"), F.col("score").alias("a"))
        b = det(s, d).select("tree", "side", "cls", F.col("score").alias("b"))
        won = F.when(F.col("a") < F.col("b"), 1.0).when(F.col("a") == F.col("b"), 0.5).otherwise(0.0)
        return a.join(b, "tree").where("ca < cls").groupBy(F.when(F.col("sa") == F.col("side"), "same image").otherwise("same tree").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(won), 9).alias("p"))

    @q("jon_21_positional", sql(", o AS (SELECT stem, det_id, score, row_number() OVER (PARTITION BY stem ORDER BY det_id) AS pos FROM det), h AS (SELECT stem, gt_id, row_number() OVER (PARTITION BY stem ORDER BY gt_id) AS pos FROM gt) SELECT o.stem, o.det_id, h.gt_id, o.pos FROM o JOIN h ON o.stem=h.stem AND o.pos=h.pos"))
    def jon_21(s, d):
        o = det(s, d).select("stem", "det_id", F.row_number().over(Window.partitionBy("stem").orderBy("det_id")).alias("pos"))
        h = gt(s, d).select("stem", "gt_id", F.row_number().over(Window.partitionBy("stem").orderBy("gt_id")).alias("pos"))
        return o.join(h, ["stem", "pos"]).select("stem", "det_id", "gt_id", "pos")


__all__ = ["CORNERS", "greedy_sql", "register"]
