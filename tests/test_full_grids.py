from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.functions import vectors as V
from grovekit.operators import calibration as C
from grovekit.plans import catalog
from grovekit.plans.aggregates import pred_true
from grovekit.plans.roles import det, probs

SF = "/root/testdata/sf0.001"


def tried_one_by_one(rows, grid):
    hits = {t: sum(sum(b >= x for x in t) == k for b, k in rows) for t in combinations(sorted(grid), 3)}
    return min((-h, *t) for t, h in hits.items())


@pytest.mark.parametrize("seed", range(3))
def test_triple_is_the_best_of_all(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(np.clip(k * 3 + rng.normal() * 2, -2, 11)), int(k)) for k in rng.integers(0, 4, 60)]
    df = spark.createDataFrame(rows, "b int, k int")
    for grid in ([0, 2, 5, 7, 9], None):
        r = C.best_cut_triple(df, "b", "k", grid).first()
        assert (-r.hits, r.a, r.b, r.c) == tried_one_by_one(rows, grid or range(min(b for b, _ in rows) - 2, max(b for b, _ in rows) + 4))


def test_triple_of_nothing(spark):
    assert C.best_cut_triple(spark.createDataFrame([], "b int, k int"), "b", "k").count() == 0


def test_registered_triple_searches_every_cut(spark):
    r = catalog.build().queries["grp_15_threshold_triple_full"](spark, SF).first()
    h = probs(det(spark, SF)).groupBy("cls", F.floor(V.expectation(F.col("p")) * 20).alias("b")).count().collect()
    n = np.zeros((4, 80), dtype=int)
    for x in h:
        n[x.cls, x.b] += x["count"]
    at = lambda t: sum(int(n[k, lo:hi].sum()) for k, (lo, hi) in enumerate(zip((0, *t), (*t, 80), strict=True)))
    assert (-r.hits, r.a, r.b, r.c) == min((-at(t), *t) for t in combinations(range(2, 60), 3))


def test_registered_affine_searches_every_pair(spark):
    rows = {r.cls: r for r in catalog.build().queries["grp_17_affine_full"](spark, SF).collect()}
    data = pred_true(spark, SF).toPandas()
    grid = [(k / 40, j / 20) for k in range(32, 49) for j in range(-30, 31)]
    for cls, g in data.groupby("cls"):
        x, y = g["pred"].to_numpy(float), g["true"].to_numpy(float)
        best = min((round(float(np.abs(np.maximum(np.rint(a * x + b), 0) - y).mean()), 9), abs(a - 1), abs(b), a, b) for a, b in grid)
        assert (rows[cls].a, rows[cls].b) == best[3:]
