import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovekit.functions import vectors as V
from grovekit.operators import aggregates as A
from grovekit.operators import fusion, linking, matching, models, selection

ALL = lambda sides: [(1.0 - 0.001 * (i * len(sides) + j), i, j) for i in range(len(sides)) for j in range(i + 1, len(sides))]


@pytest.mark.parametrize(("sides", "cap", "want"), [([0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3], 4, 3), ([0, 0, 0, 1, 1, 2, 3], 3, 3), ([0, 1, 2, 3], 4, 1), ([0, 0], 2, 2), ([0, 1, 0, 1], 2, 2)])
def test_constrained_union_find(sides, cap, want):
    assert len(set(linking.union_find(sides, ALL(sides), cap))) == want


def test_link_never_repeats_a_side():
    sides = [0, 1, 2, 0]
    label = linking.union_find(sides, [(0.9, 0, 1), (0.8, 1, 2), (0.7, 2, 3)], 4, 0.5)
    for g in set(label):
        s = [sides[i] for i in range(4) if label[i] == g]
        assert len(s) == len(set(s))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(0, 10_000))
def test_linkers_keep_constraints(sides, seed):
    rng = np.random.default_rng(seed)
    w = rng.random((len(sides), len(sides)))
    w = (w + w.T) / 2 * (np.array(sides)[:, None] != np.array(sides)[None])
    gain = np.where(w > 0, w - 0.5, -9.0)
    value = lambda lab: sum(gain[i, j] for i in range(len(lab)) for j in range(i) if lab[i] == lab[j])
    for lab in (linking.union_find(sides, linking.weight_edges(w), 3), linking.agglomerate(sides, w, 0.3, 3), linking.clique_partition(sides, gain, 3), linking.set_partition(sides, gain, 3)):
        for g in set(lab):
            s = [sides[i] for i in range(len(sides)) if lab[i] == g]
            assert len(s) == len(set(s)) <= 3
    best = value(linking.clique_partition(sides, gain, 3))
    assert best >= value(linking.set_partition(sides, gain, 3)) - 1e-9 >= -1e-9
    assert best >= value(linking.union_find(sides, linking.weight_edges(w, 0.5), 3)) - 1e-9


def test_optimal_then_threshold_matches_one():
    p = np.array([[1.5510445158382746, 0, 9.81466858266568, 1], [2.5588945280532913, 0, 14.876801775651957, 1]])
    t = np.array([[5.203047068022556, 0, 9.715917095505924, 1], [0.34205806544546247, 0, 9.863732372221252, 1]])
    m = matching.iou_matrix(p, t)
    to = matching.assignment(m)
    assert sum(m[i, j] >= 0.5 for i, j in enumerate(to)) == 1


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 10_000))
def test_assignment_is_optimal(n, m, seed):
    from itertools import permutations

    w = np.random.default_rng(seed).random((n, m))
    to = matching.assignment(w)
    got = sum(w[i, j] for i, j in enumerate(to) if j >= 0)
    small, big = (w, m) if n <= m else (w.T, n)
    best = max(sum(small[i, p[i]] for i in range(small.shape[0])) for p in permutations(range(big), small.shape[0]))
    assert abs(got - best) < 1e-9 and len({j for j in to if j >= 0}) == min(n, m)


def row(k, box, score, cls=0, model=0):
    return {"det_id": k, "x1": box[0], "y1": box[1], "x2": box[2], "y2": box[3], "score": score, "cls": cls, "model": model}


def test_weighted_fusion_scores():
    rows = [row(0, (0, 0, 10, 10), 0.9), row(1, (0, 0, 10, 10), 0.9, 0, 0), row(2, (0, 0, 10, 10), 0.9, 1, 1)]
    assert fusion.fuse_running(rows, 0.5, 2, 2)[0][4] == pytest.approx(0.9)
    assert fusion.fuse_running(rows, 0.5, 2, 2, [1.0, 1.0])[0][4] == pytest.approx(1.35)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20), st.integers(1, 12), st.integers(1, 12), st.integers(1, 9), st.integers(0, 1)), max_size=12))
def test_suppression_leaves_no_overlap(items):
    rows = [row(i, (x, y, x + w, y + h), s / 10, c) for i, (x, y, w, h, s, c) in enumerate(items)]
    kept = fusion.suppress(rows, 0.4)
    m = matching.iou_matrix(fusion.corners(kept), fusion.corners(kept))
    assert all(m[i, j] < 0.4 for i in range(len(kept)) for j in range(i) if kept[i]["cls"] == kept[j]["cls"])
    assert bool(kept) == bool(rows)


GT = [(0, c, 30.0 * c, 0.0, 30.0 * c + 10, 10.0, c) for c in range(4)]


def ap(spark, preds, gts=GT, cap=None):
    p = spark.createDataFrame(preds, "stem int, det_id bigint, x1 double, y1 double, x2 double, y2 double, cls int, score double") if preds else spark.createDataFrame([], "stem int, det_id bigint, x1 double, y1 double, x2 double, y2 double, cls int, score double")
    t = spark.createDataFrame(gts, "stem int, gt_id bigint, x1 double, y1 double, x2 double, y2 double, cls int")
    if cap:
        p = selection.top_k(p, ["stem", "cls"], [F.desc("score"), F.col("det_id")], cap)
    m = matching.match_one_to_one(p, t, ["stem", "cls"], 0.5).select("stem", "cls", "det_id", F.lit(True).alias("hit"))
    fl = p.join(m, ["stem", "cls", "det_id"], "left").select("cls", "score", F.col("det_id").alias("tie"), F.coalesce("hit", F.lit(False)).alias("tp"))
    tot = t.groupBy("cls").agg(F.count(F.lit(1)).alias("n_true"))
    got = A.average_precision(fl, tot, ["cls"])
    return got.agg(F.avg("ap")).first()[0], fl.where("tp").count()


def perfect(shift=0):
    return [(0, c, 30.0 * c, 0.0, 30.0 * c + 10, 10.0, (c + shift) % 4, 0.9) for c in range(4)]


def test_average_precision_cases(spark):
    assert ap(spark, perfect())[0] == pytest.approx(1)
    assert ap(spark, [])[0] == 0
    assert ap(spark, perfect() + [(0, 10 + c, *perfect()[c][2:]) for c in range(4)])[1] == 4
    assert ap(spark, perfect(1))[0] == 0
    assert ap(spark, perfect() + [(0, 20 + c, 500.0, 500.0, 510.0, 510.0, c, 0.95) for c in range(4)])[0] == pytest.approx(0.5)
    half = [(0, c, 30.0 * c, 0.0, 30.0 * c + 10, 5.0, c, 0.9) for c in range(4)]
    assert ap(spark, half)[0] == pytest.approx(1)
    ahead = [(0, 100 + k, 500.0 + 20 * k, 500.0, 510.0 + 20 * k, 510.0, 0, 0.95) for k in range(101)] + perfect()[:1]
    assert ap(spark, ahead, GT[:1], 100)[0] == 0
    doubled = GT + [(0, 50 + c, 30.0 * c, 300.0, 30.0 * c + 10, 310.0, c) for c in range(4)]
    assert ap(spark, perfect(), doubled)[0] == pytest.approx(51 / 101)


def test_vectors(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.0, 0.0, 0.0],), ([0.5, 0.5, 0.0],), (None,)], "p array<double>")
    rows = df.select(V.argmax(F.col("p")).alias("a"), V.normalise(F.col("p")).alias("n"), V.margin(F.col("p")).alias("m")).collect()
    assert [r.a for r in rows] == [1, 0, 0, None]
    assert rows[1].n == pytest.approx([1 / 3] * 3) and rows[2].m == 0 and rows[3].n is None


def test_ridge_agrees_with_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(size=200) * 0.1
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, c double, y double")
    b, w = models.solve_ridge(models.gram(df, ["a", "b", "c"], "y")[None], 2.0)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose(w, want) and b == pytest.approx(y.mean() - want @ x.mean(0))


def test_matching_properties(spark):
    rng = np.random.default_rng(3)
    mk = lambda n, name: [(int(s), int(i), float(x), float(y), float(x + 20), float(y + 20), 0, float(sc)) for i, (s, x, y, sc) in enumerate(zip(rng.integers(0, 5, n), rng.random(n) * 60, rng.random(n) * 60, rng.random(n), strict=True))]
    schema = "stem int, {} bigint, x1 double, y1 double, x2 double, y2 double, cls int, score double"
    p, t = spark.createDataFrame(mk(80, "p"), schema.format("det_id")), spark.createDataFrame(mk(50, "t"), schema.format("gt_id")).drop("score")
    for method in ("greedy", "optimal"):
        m = matching.match_one_to_one(p, t, ["stem"], [0.3, 0.5], method).toPandas()
        for _, g in m.groupby(["threshold", "stem"]):
            assert g.det_id.is_unique and g.gt_id.is_unique
        assert (m.iou >= m.threshold).all()


def test_scores_of_images_with_large_keys(spark, tmp_path):
    """Stems beyond a million, whose product with 10 ** 13 is no bigint."""
    from grovekit.plans import catalog

    src = "/root/testdata/sf0.001/lineitem.parquet"
    small, large = tmp_path / "small", tmp_path / "large"
    li = spark.read.parquet(src).where("l_orderkey < 300")
    li.write.parquet(str(small / "lineitem.parquet"))
    li.withColumn("l_orderkey", F.col("l_orderkey") + 40_000_000).write.parquet(str(large / "lineitem.parquet"))
    reg = catalog.build().queries
    for name in ("agg_15_ap_coco", "agg_15_ap_raw", "agg_15_ap_interp", "agg_16_map_grid", "agg_17_agnostic"):
        a, b = (sorted(map(tuple, reg[name](spark, str(d)).collect())) for d in (small, large))
        assert a == b and a
    assert reg["rsm_03_map_bootstrap"](spark, str(large)).count() == 500


def test_one_pass_over_a_grid_equals_one_at_a_time(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), float(s), i, [bool(x) for x in h]) for i, (c, s, h) in enumerate(zip(rng.integers(0, 2, 300), rng.random(300).round(1), rng.random((300, 3)) < [0.7, 0.4, 0.05], strict=True))]
    fl = spark.createDataFrame(rows, "cls int, score double, tie int, tp array<boolean>")
    tot = spark.createDataFrame([(0, 120), (1, 90), (2, 5)], "cls int, n_true int")
    grid = [0.5, 0.7, 0.9]
    got = {(r.threshold, r.cls): r.ap for r in A.average_precision(fl, tot.withColumn("threshold", F.explode(F.lit(grid))), ["cls"], grid=grid).collect()}
    for i, t in enumerate(grid):
        for v in ("coco", "raw", "interp"):
            one = {r.cls: r.ap for r in A.average_precision(fl.withColumn("tp", F.col("tp")[i]), tot, ["cls"], v).collect()}
            assert one == {c: got[t, c] for c in range(3)}
        for c, n in ((0, 120), (1, 90)):
            k = hit = 0
            points = []
            for r in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[1], r[2])):
                k, hit = k + 1, hit + r[3][i]
                points.append((hit / n, hit / k))
            assert got[t, c] == pytest.approx(sum(max((p for r, p in points if r >= x / 100 - 1e-11), default=0.0) for x in range(101)) / 101)


def test_greedy_matches_by_pairs_equal_the_matrix(spark):
    rng = np.random.default_rng(8)
    box = lambda n: [(int(s), i, float(x), float(y), float(x + 12), float(y + 12)) for i, (s, x, y) in enumerate(zip(rng.integers(0, 6, n), rng.integers(0, 25, n), rng.integers(0, 25, n), strict=True))]
    pred, true = [(*b, float(s)) for b, s in zip(box(90), rng.random(90).round(1), strict=True)], box(70)
    p = spark.createDataFrame(pred, "stem int, det_id bigint, x1 double, y1 double, x2 double, y2 double, score double")
    t = spark.createDataFrame(true, "stem int, gt_id bigint, x1 double, y1 double, x2 double, y2 double")
    got = {(r.threshold, r.stem, r.det_id, r.gt_id) for r in matching.match_one_to_one(p, t, ["stem"], [0.2, 0.5]).collect()}
    want = set()
    for s in range(6):
        ps, ts = sorted((r for r in pred if r[0] == s), key=lambda r: (-r[6], r[1])), [r for r in true if r[0] == s]
        m = matching.iou_matrix(np.array([r[2:6] for r in ps]), np.array([r[2:6] for r in ts]))
        want |= {(c, s, ps[i][1], ts[j][1]) for c in (0.2, 0.5) for i, j in enumerate(matching.greedy(m, c)) if j >= 0}
    assert got == want


def test_many_trees_link_like_one_at_a_time():
    """Thousands of trees, with ties, in one step each; a tree at a time took milliseconds."""
    import time

    rng = np.random.default_rng(2)
    n = rng.integers(0, 14, 3000)
    start, rows = np.cumsum(n) - n, []
    for k in n:
        rows += [{"side": int(s), "y1": float(y), "y2": float(y + h), "cls": int(c)} for s, y, h, c in zip(*(rng.integers(a, b, k) for a, b in ((0, 4), (0, 400), (20, 24), (0, 2))), strict=True)]
    col = {f: np.array([r[f] for r in rows]) for f in ("side", "y1", "y2", "cls")}
    got, spent = {}, time.process_time()
    for trees, at, ok in linking.dense_trees(start, n):
        side = col["side"][at]
        w = linking.dense_weights(side, (col["y1"] + col["y2"])[at] / 2, (col["y2"] - col["y1"])[at], col["cls"][at], ok)
        a, u = linking.agglomerate_many(side, w, ok, 0.4, 3), linking.union_find_many(side, w, ok, 0.3, 3)
        got |= {t: (a[i, : n[t]].tolist(), u[i, : n[t]].tolist()) for i, t in enumerate(trees)}
    assert time.process_time() - spent < 5
    assert got.keys() == {t for t in range(len(n)) if n[t]}
    for t in rng.choice(len(n), 400, replace=False):
        if n[t]:
            sides, w = linking.view_weights(rows[start[t] : start[t] + n[t]])
            assert got[t] == (linking.agglomerate(sides, w, 0.4, 3), linking.union_find(sides, linking.weight_edges(w), 3, 0.3))
