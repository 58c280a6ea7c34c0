"""Queries of scalar functions and predicates (PRJ, FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovekit.functions import boxes as B
from grovekit.functions import vectors as V
from grovekit.functions.names import split_name
from grovekit.plans.registry import Registry
from grovekit.plans.roles import P_SQL, det, gt, iou_sql, probs, sql
from grovekit.scale import read, tidy

W, H = 1300.0, 900.0
BLUR = [[0.8, 0.2, 0.0, 0.0], [0.1, 0.8, 0.1, 0.0], [0.0, 0.1, 0.8, 0.1], [0.0, 0.0, 0.2, 0.8]]
PRIOR = [0.4, 0.3, 0.2, 0.1]


def _r(c, n: int = 6):
    """Rounded for comparison across engines."""
    return F.round(c, n)


def register(reg: Registry) -> None:
    q = reg.query

    @q("prj_01_formats", sql(f"""SELECT stem, det_id, round((x1+x2)/2/{W},6) AS cx, round((y1+y2)/2/{H},6) AS cy, round((x2-x1)/{W},6) AS w, round((y2-y1)/{H},6) AS h,
      round(((x1+x2)/2/{W} - (x2-x1)/{W}/2)*{W},6) AS back_x1, round(x2-x1,6) AS coco_w, round(y2-y1,6) AS coco_h FROM det"""))
    def prj_01(s, d):
        df, b = det(s, d), B.box()
        cx, cy, w, h = B.to_center(b, F.lit(W), F.lit(H))
        back = B.from_center(cx, cy, w, h, F.lit(W), F.lit(H))
        return df.select("stem", "det_id", _r(cx).alias("cx"), _r(cy).alias("cy"), _r(w).alias("w"), _r(h).alias("h"), _r(back.x1).alias("back_x1"), _r(b.width).alias("coco_w"), _r(b.height).alias("coco_h"))

    @q("prj_02_center_features", sql(f"""SELECT stem, det_id, round((x1+x2)/2/greatest({W},1),6) AS ncx, round((y1+y2)/2/greatest({H},1),6) AS ncy,
      round(greatest(x2-x1,1)/greatest({W},1),6) AS nw, round(greatest(y2-y1,1)/greatest({H},1),6) AS nh FROM det"""))
    def prj_02(s, d):
        b, one = B.box(), F.lit(1.0)
        w, h = F.greatest(F.lit(W), one), F.greatest(F.lit(H), one)
        return det(s, d).select("stem", "det_id", _r((b.x1 + b.x2) / 2 / w).alias("ncx"), _r((b.y1 + b.y2) / 2 / h).alias("ncy"), _r(F.greatest(b.width, one) / w).alias("nw"), _r(F.greatest(b.height, one) / h).alias("nh"))

    @q("prj_03_iou", sql(f"SELECT a.stem, a.det_id, b.gt_id, round({iou_sql('a', 'b')},6) AS iou FROM det a JOIN gt b ON a.stem = b.stem WHERE {iou_sql('a', 'b')} > 0"))
    def prj_03(s, d):
        g = gt(s, d).select("stem", "gt_id", *[F.col(c).alias("g" + c) for c in B.CORNERS])
        v = B.iou(B.box(), B.box("g"))
        return det(s, d).join(g, "stem").where(v > 0).select("stem", "det_id", "gt_id", _r(v).alias("iou"))

    @q("prj_04_shape", sql(f"""SELECT stem, det_id, round((x2-x1)*(y2-y1),6) AS area, round(sqrt((x2-x1)*(y2-y1)),6) AS root_area, round((x2-x1)/(y2-y1),6) AS aspect,
      round(ln((x2-x1)/(y2-y1)),6) AS log_aspect, round(greatest(least(x1,y1,{W}-x2,{H}-y2)/{W},0),6) AS edge FROM det"""))
    def prj_04(s, d):
        b = B.box()
        return det(s, d).select("stem", "det_id", _r(b.area).alias("area"), _r(F.sqrt(b.area)).alias("root_area"), _r(b.width / b.height).alias("aspect"), _r(F.ln(b.width / b.height)).alias("log_aspect"), _r(B.edge_distance(b, F.lit(W), F.lit(H))).alias("edge"))

    pv = f", pv AS (SELECT stem, det_id, cls, score, model, {P_SQL} AS p, {P_SQL.replace('cls = k', '(cls+1)%4 = k')} AS r FROM det)"

    def pv_df(s, d):
        other = V.soft_one_hot((F.col("cls") + 1) % 4, F.col("score"), 4)
        return probs(det(s, d)).withColumn("r", other)

    @q("prj_05_normalise", sql(pv + """SELECT stem, det_id, [round(greatest(x-0.2,0)/list_sum([greatest(y-0.2,0) FOR y IN p]),6) FOR x IN p] AS n FROM pv WHERE list_sum([greatest(y-0.2,0) FOR y IN p]) > 1e-9
      UNION ALL SELECT stem, det_id, [CAST(0.25 AS DOUBLE),0.25,0.25,0.25] FROM pv WHERE NOT list_sum([greatest(y-0.2,0) FOR y IN p]) > 1e-9"""))
    def prj_05(s, d):
        n = V.normalise(F.transform("p", lambda x: x - 0.2))
        return pv_df(s, d).select("stem", "det_id", F.transform(n, lambda x: F.round(x, 6)).alias("n"))

    @q("prj_06_argmax", sql(pv + "SELECT stem, det_id, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS best FROM pv"))
    def prj_06(s, d):
        return pv_df(s, d).select("stem", "det_id", V.argmax(F.col("p")).alias("best"))

    @q("prj_07_entropy_margin", sql(pv + """SELECT stem, det_id, round(-list_sum([CASE WHEN x > 0 THEN x*ln(x) ELSE 0 END FOR x IN p]),6) AS entropy,
      round(list_sort(p)[4] - list_sort(p)[3],6) AS margin FROM pv"""))
    def prj_07(s, d):
        return pv_df(s, d).select("stem", "det_id", _r(V.entropy(F.col("p"))).alias("entropy"), _r(V.margin(F.col("p"))).alias("margin"))

    ix = "FOR i IN range(1,5)"
    @q("prj_08_distances", sql(pv + f"""SELECT stem, det_id, round(list_sum([sqrt(p[i]*r[i]) {ix}]),6) AS bhattacharyya, round(list_sum([p[i]*r[i] {ix}]),6) AS dot,
      round(list_sum([abs(p[i]-r[i]) {ix}]),6) AS l1, round(sqrt(list_sum([(p[i]-r[i])*(p[i]-r[i]) {ix}])),6) AS l2,
      round(list_sum([least(p[i],r[i]) {ix}]),6) AS common, round(0.5*list_sum([CASE WHEN p[i]+r[i]>0 THEN (p[i]-r[i])*(p[i]-r[i])/(p[i]+r[i]) ELSE 0 END {ix}]),6) AS chi2,
      round(list_sum([p[i]*r[i] {ix}])/(sqrt(list_sum([p[i]*p[i] {ix}]))*sqrt(list_sum([r[i]*r[i] {ix}]))),6) AS cosine,
      round(0.5*list_sum([CASE WHEN p[i]>0 THEN p[i]*ln(p[i]/((p[i]+r[i])/2)) ELSE 0 END + CASE WHEN r[i]>0 THEN r[i]*ln(r[i]/((p[i]+r[i])/2)) ELSE 0 END {ix}]),6) AS js FROM pv"""))
    def prj_08(s, d):
        a, b = F.col("p"), F.col("r")
        fs = {"bhattacharyya": V.bhattacharyya, "dot": V.dot, "l1": V.l1, "l2": V.l2, "common": V.common_mass, "chi2": V.chi_square, "cosine": V.cosine, "js": V.jensen_shannon}
        return pv_df(s, d).select("stem", "det_id", *[_r(f(a, b)).alias(k) for k, f in fs.items()])

    @q("prj_09_ordinal", sql(pv + """SELECT stem, det_id, round(g,6) AS g, CAST(CAST(g>0.9 AS INT)+CAST(g>1.5 AS INT)+CAST(g>2.1 AS INT) AS INTEGER) AS cls
      FROM (SELECT stem, det_id, p[2]+2*p[3]+3*p[4] AS g FROM pv)"""))
    def prj_09(s, d):
        g = V.expectation(F.col("p"))
        return pv_df(s, d).select("stem", "det_id", _r(g).alias("g"), V.ordinal_class(g, [0.9, 1.5, 2.1]).alias("cls"))

    @q("prj_10_power_softmax_blend", sql(pv + """SELECT stem, det_id, [round(pow(x,0.5)/list_sum([pow(y,0.5) FOR y IN p]),6) FOR x IN p] AS power,
      [round(exp((x-list_max(p))/0.5)/list_sum([exp((y-list_max(p))/0.5) FOR y IN p]),6) FOR x IN p] AS soft, [round(0.7*p[i]+0.3*r[i],6) FOR i IN range(1,5)] AS blend,
      round(pow(score,0.6)*pow(list_max(p),0.4),6) AS rank_score FROM pv"""))
    def prj_10(s, d):
        p, six = F.col("p"), lambda a: F.transform(a, lambda x: F.round(x, 6))
        return pv_df(s, d).select("stem", "det_id", six(V.power(p, 0.5)).alias("power"), six(V.softmax(p, 0.5)).alias("soft"), six(V.blend(p, F.col("r"), 0.3)).alias("blend"), _r(F.pow("score", F.lit(0.6)) * F.pow(F.array_max(p), F.lit(0.4))).alias("rank_score"))

    @q("prj_11_prior", sql(pv + f"""SELECT stem, det_id, CAST(list_position(z, list_max(z))-1 AS INTEGER) AS cls, round(list_max(z),6) AS top FROM (
      SELECT stem, det_id, [p[i]*pow([{','.join(map(str, PRIOR))}][i],0.5) {ix}] AS z FROM pv)"""))
    def prj_11(s, d):
        z = V.reweight(F.col("p"), PRIOR, 0.5)
        return pv_df(s, d).select("stem", "det_id", V.argmax(z).alias("cls"), _r(F.array_max(z)).alias("top"))

    @q("prj_12_gate", sql(pv + """SELECT stem, det_id, CASE WHEN list_max(r) >= 0.5 AND list_sort(r)[4]-list_sort(r)[3] >= 0.2 THEN CAST(list_position(r, list_max(r))-1 AS INTEGER) ELSE cls END AS cls FROM pv"""))
    def prj_12(s, d):
        r = F.col("r")
        sure = (F.array_max(r) >= 0.5) & (V.margin(r) >= 0.2)
        return pv_df(s, d).select("stem", "det_id", F.when(sure, V.argmax(r)).otherwise(F.col("cls")).alias("cls"))

    @q("prj_13_blur", sql(pv + "SELECT stem, det_id, [round(0.8*p[1]+0.1*p[2],6), round(0.2*p[1]+0.8*p[2]+0.1*p[3],6), round(0.1*p[2]+0.8*p[3]+0.2*p[4],6), round(0.1*p[3]+0.8*p[4],6)] AS b FROM pv"))
    def prj_13(s, d):
        return pv_df(s, d).select("stem", "det_id", F.transform(V.blur(F.col("p"), BLUR), lambda x: F.round(x, 6)).alias("b"))

    pair = ", z AS (SELECT a.tree, a.det_id AS i, b.det_id AS j, (b.x1-a.x1)/300 AS zdx, (b.y1-a.y1)/200 AS zdy, ln(((b.x2-b.x1)*(b.y2-b.y1))/((a.x2-a.x1)*(a.y2-a.y1))) AS za, ln(((b.x2-b.x1)/(b.y2-b.y1))/((a.x2-a.x1)/(a.y2-a.y1))) AS zs, CASE WHEN a.cls=b.cls THEN 1.0 ELSE 0.0 END AS sim FROM det a JOIN det b ON a.tree=b.tree AND b.side=(a.side+1)%4)"
    @q("prj_14_pair_score", sql(pair + "SELECT tree, i, j, round(exp(-least(0.5*(zdx*zdx+zdy*zdy)+0.12*za*za+0.08*zs*zs+0.10*(1-sim),40)),6) AS link FROM z"))
    def prj_14(s, d):
        a = det(s, d).select("tree", "side", F.col("det_id").alias("i"), F.col("cls").alias("acls"), *[F.col(c).alias("a" + c) for c in B.CORNERS])
        b = det(s, d).select("tree", ((F.col("side") + 3) % 4).alias("side"), F.col("det_id").alias("j"), "cls", *B.CORNERS)
        p, q_ = B.box("a"), B.box()
        v = B.pair_similarity((q_.x1 - p.x1) / 300, (q_.y1 - p.y1) / 200, F.ln(q_.area / p.area), F.ln((q_.width / q_.height) / (p.width / p.height)), (F.col("acls") == F.col("cls")).cast("double"))
        return a.join(b, ["tree", "side"]).select("tree", "i", "j", _r(v).alias("link"))

    @q("prj_15_pair_features", sql("""SELECT a.tree, a.det_id AS i, b.det_id AS j, round(abs((a.x1+a.x2)/2-(b.x1+b.x2)/2),6) AS dx, round(abs((a.y1+a.y2)/2-(b.y1+b.y2)/2),6) AS dy,
      round(abs(ln((a.x2-a.x1)/(b.x2-b.x1))),6) AS dw, round(abs(ln((a.y2-a.y1)/(b.y2-b.y1))),6) AS dh, round(least(a.score,b.score),6) AS smin, round(greatest(a.score,b.score),6) AS smax,
      round(abs(a.score-b.score),6) AS sdiff, abs(a.cls-b.cls) AS dcls, CAST(a.cls=b.cls AS INTEGER) AS same_cls, ((b.side-a.side)%4+4)%4 AS turn
      FROM det a JOIN det b ON a.tree=b.tree AND a.side<b.side"""))
    def prj_15(s, d):
        a = det(s, d).select("tree", F.col("side").alias("aside"), F.col("det_id").alias("i"), F.col("cls").alias("acls"), F.col("score").alias("ascore"), *[F.col(c).alias("a" + c) for c in B.CORNERS])
        b = det(s, d).select("tree", "side", F.col("det_id").alias("j"), "cls", "score", *B.CORNERS)
        p, r = B.box("a"), B.box()
        f = {"dx": F.abs((p.x1 + p.x2) / 2 - (r.x1 + r.x2) / 2), "dy": F.abs((p.y1 + p.y2) / 2 - (r.y1 + r.y2) / 2), "dw": F.abs(F.ln(p.width / r.width)), "dh": F.abs(F.ln(p.height / r.height)),
             "smin": F.least("ascore", "score"), "smax": F.greatest("ascore", "score"), "sdiff": F.abs(F.col("ascore") - F.col("score"))}
        return a.join(b, "tree").where("aside < side").select("tree", "i", "j", *[_r(v).alias(k) for k, v in f.items()], F.abs(F.col("acls") - F.col("cls")).alias("dcls"), (F.col("acls") == F.col("cls")).cast("int").alias("same_cls"), F.pmod(F.col("side") - F.col("aside"), F.lit(4)).alias("turn"))

    @q("prj_16_cylinder", sql("""SELECT stem, det_id, ((x1+x2)/2-c)/greatest(r,1e-9) AS u FROM (
      SELECT *, (min(x1) OVER w + max(x2) OVER w)/2 AS c, (max(x2) OVER w - min(x1) OVER w)/2 AS r FROM det WINDOW w AS (PARTITION BY stem))"""))
    def prj_16(s, d):
        from pyspark.sql import Window
        w = Window.partitionBy("stem")
        lo, hi = F.min("x1").over(w), F.max("x2").over(w)
        return det(s, d).select("stem", "det_id", (((F.col("x1") + F.col("x2")) / 2 - (lo + hi) / 2) / F.greatest((hi - lo) / 2, F.lit(1e-9))).alias("u"))

    @q("prj_17_rounding", sql("""SELECT stem, det_id, CAST(round_even(score*10,0) AS BIGINT) AS half_even, CAST(floor(score*10+0.5) AS BIGINT) AS half_up,
      CAST(greatest(round_even(score*10-2,0),0) AS BIGINT) AS clipped FROM det"""))
    def prj_17(s, d):
        v = F.col("score") * 10
        return det(s, d).select("stem", "det_id", F.rint(v).cast("bigint").alias("half_even"), F.floor(v + 0.5).alias("half_up"), F.greatest(F.rint(v - 2), F.lit(0.0)).cast("bigint").alias("clipped"))

    @q("prj_18_inverse_depth", sql("""SELECT stem, det_id, code, round(CASE WHEN code = 0 THEN NULL ELSE 1/(1/6.0 + (code-1)/254.0*(1/0.5 - 1/6.0)) END,6) AS depth FROM (
      SELECT stem, det_id, CASE WHEN x1 = 0 THEN 0 ELSE CAST(round_even(1 + 254*(1/least(greatest(x1/100,0.5),6.0) - 1/6.0)/(1/0.5 - 1/6.0),0) AS INTEGER) END AS code FROM det)"""))
    def prj_18(s, d):
        near, far = 0.5, 6.0
        z = F.least(F.greatest(F.col("x1") / 100, F.lit(near)), F.lit(far))
        code = F.when(F.col("x1") == 0, 0).otherwise(F.rint(1 + 254 * (1 / z - 1 / far) / (1 / near - 1 / far)).cast("int"))
        back = F.when(F.col("code") > 0, 1 / (1 / far + (F.col("code") - 1) / 254.0 * (1 / near - 1 / far)))
        return det(s, d).select("stem", "det_id", code.alias("code")).withColumn("depth", _r(back))

    @q("prj_19_tiles", """SELECT p_partkey, CASE WHEN len <= 640 THEN [0] ELSE list_sort(list_distinct(list_concat(CAST(range(0, len-640+1, 512) AS INTEGER[]), [len-640]))) END AS starts
      FROM (SELECT p_partkey, CAST(300 + p_size*50 AS INTEGER) AS len FROM part)""")
    def prj_19(s, d):
        n = (F.col("p_size") * 50 + 300).cast("int")
        return read(s, d, "part").select("p_partkey", B.tile_starts(n, 640, 128).alias("starts"))

    @q("prj_20_sha256", "SELECT p_partkey, sha256(p_name || '|' || p_brand || '|' || CAST(p_size AS VARCHAR)) AS digest FROM part")
    def prj_20(s, d):
        return read(s, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_name", "p_brand", F.col("p_size").cast("string")), 256).alias("digest"))

    @q("prj_21_format", "SELECT c_custkey, replace(printf('%.2f', c_acctbal), '.', ',') AS comma, printf('%.4f%%', c_acctbal/100) AS pct, printf('%+.5f', c_acctbal/1000) AS delta FROM customer")
    def prj_21(s, d):
        v = F.col("c_acctbal")
        return read(s, d, "customer").select("c_custkey", F.translate(F.printf(F.lit("%.2f"), v), ".", ",").alias("comma"), F.printf(F.lit("%.4f%%"), v / 100).alias("pct"), F.printf(F.lit("%+.5f"), v / 1000).alias("delta"))

    @q("prj_22_cumulative", sql(pv + """, c AS (SELECT stem, det_id, score AS c1, least(score, score*0.9) AS c2, least(score, score*0.9, p[2]) AS c3 FROM pv)
      SELECT stem, det_id, [round((1-c1)/1,6), round(c1-c2,6), round(c2-c3,6), round(c3,6)] AS q FROM c"""))
    def prj_22(s, d):
        cum = F.array(F.col("score"), F.col("score") * 0.9, F.get("p", F.lit(1)))
        return pv_df(s, d).select("stem", "det_id", F.transform(V.from_cumulative(cum), lambda x: F.round(x, 6)).alias("q"))

    @q("prj_23_lab", """SELECT p_partkey, round(116*fy-16,5) AS l, round(500*(fx-fy),5) AS a, round(200*(fy-fz),5) AS b FROM (
      SELECT p_partkey, CASE WHEN x>0.008856 THEN pow(x,1/3.0) ELSE 7.787*x+16/116.0 END AS fx, CASE WHEN y>0.008856 THEN pow(y,1/3.0) ELSE 7.787*y+16/116.0 END AS fy, CASE WHEN z>0.008856 THEN pow(z,1/3.0) ELSE 7.787*z+16/116.0 END AS fz FROM (
      SELECT p_partkey, (0.4124564*r+0.3575761*g+0.1804375*bl)/0.95047 AS x, 0.2126729*r+0.7151522*g+0.0721750*bl AS y, (0.0193339*r+0.1191920*g+0.9503041*bl)/1.08883 AS z FROM (
      SELECT p_partkey, CASE WHEN r>0.04045 THEN pow((r+0.055)/1.055,2.4) ELSE r/12.92 END AS r, CASE WHEN g>0.04045 THEN pow((g+0.055)/1.055,2.4) ELSE g/12.92 END AS g, CASE WHEN bl>0.04045 THEN pow((bl+0.055)/1.055,2.4) ELSE bl/12.92 END AS bl FROM (
      SELECT p_partkey, CAST(p_partkey*37%256 AS DOUBLE)/255 AS r, CAST(p_partkey*91%256 AS DOUBLE)/255 AS g, CAST(p_size*5%256 AS DOUBLE)/255 AS bl FROM part))))""")
    def prj_23(s, d):
        from grovekit.functions.pixels import srgb_to_lab
        rgb = [(F.col("p_partkey") * 37 % 256).cast("double") / 255, (F.col("p_partkey") * 91 % 256).cast("double") / 255, (F.col("p_size") * 5 % 256).cast("double") / 255]
        lab = srgb_to_lab(*rgb)
        return read(s, d, "part").select("p_partkey", *[_r(v, 5).alias(k) for k, v in zip("lab", lab, strict=True)])

    @q("prj_24_one_hot", sql("SELECT stem, det_id, [CAST(cls = k AS DOUBLE) FOR k IN range(4)] AS hot FROM det"))
    def prj_24(s, d):
        return det(s, d).select("stem", "det_id", V.one_hot(F.col("cls"), 4).alias("hot"))

    @q("prj_25_logit", sql("SELECT stem, det_id, round(ln(q/(1-q)) - ln(0.3/0.7),6) AS gain FROM (SELECT stem, det_id, greatest(least(score,1-1e-6),1e-6) AS q FROM det)"))
    def prj_25(s, d):
        return det(s, d).select("stem", "det_id", _r(V.logit(F.col("score")) - F.ln(F.lit(0.3 / 0.7))).alias("gain"))

    # ------------------------------------------------------------ filters
    @q("flt_01_score_floor", sql("SELECT stem, det_id FROM det WHERE score >= CASE model WHEN 0 THEN 0.2 WHEN 1 THEN 0.3 ELSE 0.4 END"))
    def flt_01(s, d):
        floor = F.when(F.col("model") == 0, 0.2).when(F.col("model") == 1, 0.3).otherwise(0.4)
        return det(s, d).where(F.col("score") >= floor).select("stem", "det_id")

    @q("flt_02_class_domain", "SELECT box_id, cls FROM gt_boxes WHERE cls BETWEEN 0 AND 3")
    def flt_02(s, d):
        return read(s, d, "gt_boxes").where(F.col("cls").between(0, 3)).select("box_id", "cls")

    @q("flt_03_variety_split", r"""SELECT row_id FROM (SELECT row_id, variety, lower(regexp_replace(new_split, '^[\s\x{FEFF}\x{00A0}\x{200B}]+|[\s\x{FEFF}\x{00A0}\x{200B}]+$', '', 'g')) AS s, upper(regexp_replace(tree_id, '^[\s\x{FEFF}\x{00A0}\x{200B}]+', '')) AS t FROM split_manifest)
      WHERE starts_with(t, 'MERANTU') AND variety = 'MERANTU' AND s IN ('train','training','latih','pelatihan')""")
    def flt_03(s, d):
        """Training rows of one variety; the split is read by its meaning, the name without marks, blanks and letter case."""
        m = read(s, d, "split_manifest").where((F.col("variety") == "MERANTU") & F.upper(tidy(F.col("tree_id"))).startswith("MERANTU"))
        return m.where(split_name(F.col("new_split")) == "train").select("row_id")

    @q("flt_04_four_sides", sql(", n AS (SELECT tree, count(DISTINCT side) AS n_sides FROM det GROUP BY tree) SELECT CASE WHEN n_sides = 4 THEN 'kept' ELSE 'excluded' END AS status, n_sides, count(*) AS n_trees FROM n GROUP BY ALL"))
    def flt_04(s, d):
        n = det(s, d).groupBy("tree").agg(F.countDistinct("side").alias("n_sides"))
        return n.groupBy(F.when(F.col("n_sides") == 4, "kept").otherwise("excluded").alias("status"), "n_sides").agg(F.count(F.lit(1)).alias("n_trees"))

    @q("flt_05_singletons", sql(", c AS (SELECT tree, cls, count(*) AS size, max(score) AS score FROM det GROUP BY tree, cls) SELECT tree, cls, size FROM c WHERE NOT (size = 1 AND score < 0.6)"))
    def flt_05(s, d):
        c = det(s, d).groupBy("tree", "cls").agg(F.count(F.lit(1)).alias("size"), F.max("score").alias("score"))
        return c.where(~((F.col("size") == 1) & (F.col("score") < 0.6))).select("tree", "cls", "size")

    @q("flt_06_tile_border", sql(f"SELECT stem, det_id FROM det WHERE NOT ((x1 % 512 < 3 AND x1 >= 512) OR (x2 % 512 > 509 AND x2 < {W}-3))"))
    def flt_06(s, d):
        cut = ((F.col("x1") % 512 < 3) & (F.col("x1") >= 512)) | ((F.col("x2") % 512 > 509) & (F.col("x2") < W - 3))
        return det(s, d).where(~cut).select("stem", "det_id")

    @q("flt_07_contract", sql("SELECT count(*) AS n, CAST(sum(CAST(cls NOT BETWEEN 0 AND 3 AS INT)) AS BIGINT) AS bad_class, CAST(sum(CAST(x2 <= x1 OR y2 <= y1 AS INT)) AS BIGINT) AS bad_box FROM det"))
    def flt_07(s, d):
        from grovekit.operators.checks import require
        ok = require(det(s, d), {"class out of range": F.col("cls").between(0, 3), "empty box": (F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))})
        return ok.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("cls").between(0, 3)).alias("bad_class"), F.count_if((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))).alias("bad_box"))

    @q("flt_08_adjacent_sides", "SELECT link_id FROM edges WHERE ((side_j-side_i)%8+8)%8 IN (1,7)")
    def flt_08(s, d):
        return read(s, d, "edges").where(F.pmod(F.col("side_j") - F.col("side_i"), F.lit(8)).isin(1, 7)).select("link_id")

    @q("flt_09_cluster_retention", sql("SELECT tree, cls, round(1-exp(sum(ln(1-least(score,0.999999)))),6) AS strength FROM det GROUP BY tree, cls HAVING 1-exp(sum(ln(1-least(score,0.999999)))) >= 0.7"))
    def flt_09(s, d):
        agg = det(s, d).groupBy("tree", "cls").agg((1 - F.exp(F.sum(F.ln(1 - F.least("score", F.lit(0.999999)))))).alias("v"))
        return agg.where("v >= 0.7").select("tree", "cls", _r(F.col("v")).alias("strength"))
