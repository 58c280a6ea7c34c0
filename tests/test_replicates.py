import contextlib
import math
import re
import threading
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from grovekit.operators import resample as R
from grovekit.plans import catalog
from grovekit.scale import Workspace


def test_weights_are_poisson_and_independent(spark):
    n, reps = 4000, 40
    got = R.replicate_weights(spark.range(n), ["id"], reps).groupBy("_rep", "_times").count().collect()
    share = {}
    for r in got:
        share[r["_times"]] = share.get(r["_times"], 0) + r["count"] / (n * reps)
    for k in (1, 2, 3):
        assert abs(share[k] - math.exp(-1) / math.factorial(k)) < 0.005
    sizes = {r["_rep"]: r.s for r in R.replicate_weights(spark.range(n), ["id"], reps).groupBy("_rep").agg(F.sum("_times").alias("s")).collect()}
    assert len(sizes) == reps and len(set(sizes.values())) > 30


def test_variance_of_a_ratio(spark):
    rnd = np.random.RandomState(1)
    n = 3750  # a number for which even steps through the positions would draw the same entities every time
    num = rnd.binomial(20, rnd.beta(2, 4, n)).astype(float)
    df = spark.createDataFrame([(i, float(a), 20.0) for i, a in enumerate(num)], "tree int, a double, n double")
    got = np.array([r.value for r in R.bootstrap_ratio(df, ["tree"], "a", "n", 400).collect()])
    r = num.sum() / (20 * n)
    want = ((num - r * 20) ** 2).sum() / (20 * n) ** 2
    assert len(set(got.round(9))) > 390 and abs(got.mean() - r) < 3 * math.sqrt(want / 400)
    assert abs(got.var() / want - 1) < 0.2


def test_paired_draws_are_shared(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i % 7), 10.0) for i in range(100)], "tree int, a double, b double, n double")
    assert {r.delta for r in R.paired_bootstrap(df, ["tree"], "a", "b", "n", 8).collect()} == {0.0}


def test_bootstrap_ap_against_copies(spark):
    rnd = np.random.RandomState(4)
    rows = [(int(s), int(c), float(round(v, 2)), i, bool(t)) for i, (s, c, v, t) in enumerate(zip(rnd.randint(0, 30, 400), rnd.randint(0, 2, 400), rnd.rand(400), rnd.rand(400) < 0.6, strict=True))]
    flags = spark.createDataFrame(rows, "stem int, cls int, score double, tie int, tp boolean")
    truths = spark.createDataFrame([(s, c, 1 + sum(r[4] for r in rows if r[0] == s and r[1] == c)) for s in range(30) for c in range(2)], "stem int, cls int, n int")
    reps = 6
    w = R.image_weights(np.arange(30), reps, 42)
    want = {}
    for b in range(reps):
        for c in range(2):
            real = sum(w[r.stem, b] * r.n for r in truths.collect() if r.cls == c)
            hit = k = 0
            points = []
            for s, _, _, _, t in sorted((r for r in rows if r[1] == c), key=lambda r: (-r[2], r[3])):
                k, hit = k + w[s, b], hit + w[s, b] * t
                points.append((hit / real, hit / k if k else 0.0))
            want[b, c] = sum(max((p for r, p in points if r >= x / 100 - 1e-11), default=0.0) for x in range(101)) / 101
    for band_rows in (1_000_000, 25):
        got = {(r.b, r.cls): r.ap for r in R.bootstrap_ap(flags, truths, reps, Workspace(spark, "t"), band_rows=band_rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_map_bootstrap_has_500_unlike_replicates(spark):
    got = [r.map50 for r in catalog.build().queries["rsm_03_map_bootstrap"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == 500 and len(set(got)) > 100


def test_numbers_drawn_in_place_are_those_of_the_whole_hash():
    images = np.r_[np.arange(-3, 30_000), 2**62, -(2**63)]
    with np.errstate(over="ignore"):
        h = R._mixed(R._mixed(images.astype(np.int64).view(np.uint64) + np.uint64(7))[:, None] + np.arange(1, 41, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    assert (R._by_top_bits()[h >> np.uint64(48)] == R.OPEN).sum() > 50  # numbers that the upper bits don't tell
    assert (R.image_weights(images, 40, 7) == np.searchsorted(R.POISSON, h / 2.0**64, side="right")).all()


def worker_mb():
    """Memory of the largest Python worker now."""
    most = 0
    for p in Path("/proc").glob("[0-9]*"):
        with contextlib.suppress(OSError):
            if b"pyspark.daemon" in (p / "cmdline").read_bytes():
                most = max(most, int(re.search(r"RssAnon:\s+(\d+)", (p / "status").read_text())[1]) / 1024)
    return most


def test_bootstrap_ap_holds_few_weights_of_rows_with_one_score(spark):
    """No score parts these rows, and their weights for all replicates at once would take 8 bytes x 40,000 x 500, several times over."""
    n, reps = 40_000, 500
    stem, tp = np.arange(n) // 2, np.random.RandomState(3).rand(n) < 0.4
    rows = spark.range(n).select((F.col("id") / 2).cast("bigint").alias("stem"), F.lit(1).alias("cls"), F.lit(0.5).alias("score"), F.col("id").alias("tie"), F.element_at(F.lit(tp.tolist()), (F.col("id") + 1).cast("int")).alias("tp"))
    flags = Workspace(spark, "one").save(rows, "rows")
    truths = spark.range(n // 2).select(F.col("id").alias("stem"), F.lit(1).alias("cls"), F.lit(1).alias("n"))
    before, most, over = worker_mb(), [0.0], threading.Event()
    watch = threading.Thread(target=lambda: [most.append(worker_mb()) for _ in iter(lambda: over.wait(0.05), True)])
    watch.start()
    got = {r.b: r.ap for r in R.bootstrap_ap(flags, truths, reps, Workspace(spark, "t")).collect()}
    over.set()
    watch.join()
    assert 0 < max(most) < before + 300
    assert len(got) == reps
    w = R.image_weights(np.arange(n // 2), 3, 42).astype(float)
    for b in range(3):
        k, hit = np.cumsum(w[stem, b]), np.cumsum(w[stem, b] * tp)
        recall, precision = hit / w[:, b].sum(), np.divide(hit, k, out=np.zeros(n), where=k > 0)
        assert abs(got[b] - sum(precision[recall >= x / 100 - 1e-11].max(initial=0.0) for x in range(101)) / 101) < 1e-6
