"""Models fitted from aggregated sufficient statistics, and MLlib pipelines around them (MLX)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gram(df: DataFrame, features: Sequence[str], target: str, by: str | None = None) -> dict:
    """Second moments of (1, features, target) for each value of ``by``: one aggregate, (p + 2) squared numbers a key."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(target).cast("double")]
    n = len(cols)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(n) for j in range(i, n)]
    rows = (df.groupBy(by) if by else df.groupBy()).agg(*aggs).collect()  # a number of keys such as folds
    out = {}
    for r in rows:
        m = np.zeros((n, n))
        for i in range(n):
            for j in range(i, n):
                m[i, j] = m[j, i] = r[f"s{i}_{j}"] or 0.0
        out[r[by] if by else None] = m
    return out


def gram_vector(df: DataFrame, vector: str, target: str, size: int) -> np.ndarray:
    """Second moments of (1, vector's components, target): summed in each task, then by place.

    Rows without target or without a vector of ``size`` known components don't count.
    """
    whole = F.col(vector).isNotNull() & (F.size(vector) == size) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    rows = df.where(whole & F.col(target).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.col(target).cast("double").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((size + 2, size + 2))
        for pdf in batches:
            if len(pdf):
                x = np.column_stack([np.ones(len(pdf)), np.array(pdf["v"].tolist(), dtype=float), pdf["y"].to_numpy(float)])
                m += x.T @ x
        yield pd.DataFrame({"m": [m.ravel()]})

    sums = rows.mapInPandas(run, "m array<double>").select(F.posexplode("m").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # (size + 2) squared numbers
    out = np.zeros((size + 2) ** 2)
    for r in sums:
        out[r["at"]] = r["x"]
    return out.reshape(size + 2, size + 2)


def solve_ridge(m: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """(intercept, coefficients on the raw features) of ridge on standardised features from second moments."""
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    sd = np.where(sd > 1e-12, sd, 1.0)
    y = m[0, -1] / n
    xy = (m[1:-1, -1] / n - mean * y) / sd * n
    w = np.linalg.solve(cov / np.outer(sd, sd) * n + alpha * np.eye(len(sd)), xy)
    return float(y - (w / sd) @ mean), w / sd


def predict(features: Sequence[str], intercept: float, coef: np.ndarray) -> Column:
    out = F.lit(float(intercept))
    for f, c in zip(features, coef, strict=True):
        out = out + F.col(f) * F.lit(float(c))
    return out


def ridge_cv(df: DataFrame, features: Sequence[str], target: str, fold: str, alphas: Sequence[float]) -> tuple[float, float, np.ndarray, dict[float, float]]:
    """(alpha, intercept, coefficients, error by alpha): the penalty by the folds' mean absolute error of whole counts, ties to the smaller.

    Two passes: second moments of every fold, then the errors of all folds and penalties in one aggregate.
    """
    moments = gram(df, features, target, fold)
    whole = sum(moments.values())
    each = []
    for k, m in moments.items():
        for a in alphas:
            b, w = solve_ridge(whole - m, a)
            err = F.abs(F.greatest(F.rint(predict(features, b, w)), F.lit(0.0)) - F.col(target))
            each.append((a, F.sum(F.when(F.col(fold) == k, err)).alias(f"e{len(each)}")))
    row = df.agg(*[c for _, c in each]).first()
    error = {a: sum(row[f"e{i}"] or 0.0 for i, (x, _) in enumerate(each) if x == a) / whole[0, 0] for a in alphas}
    best = min(alphas, key=lambda a: (round(error[a], 12), a))
    b, w = solve_ridge(whole, best)
    return best, b, w, error


def ridge_gcv(df: DataFrame, features: Sequence[str], target: str, alphas: Sequence[float]) -> tuple[float, float, np.ndarray]:
    """Ridge with the penalty of least generalised cross-validation error, from one set of second moments."""
    m = gram(df, features, target)[None]
    n = m[0, 0]
    mean = m[0, 1:-1] / n
    cov = m[1:-1, 1:-1] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-24))
    z = cov / np.outer(sd, sd) * n
    eig = np.linalg.eigvalsh(z)
    best = None
    for a in alphas:
        b, w = solve_ridge(m, a)
        full = np.concatenate([[b], w, [-1.0]])
        rss = float(full @ m @ full)
        gcv = rss / n / max(1 - (1 + (eig / (eig + a)).sum()) / n, 1e-9) ** 2
        if best is None or gcv < best[0] - 1e-12:
            best = (gcv, a, b, w)
    return best[1], best[2], best[3]


def logistic(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, l2: float = 1e-3, steps: int = 25) -> tuple[float, np.ndarray]:
    """Logistic regression by Newton steps, each one aggregate of gradient and curvature; weights e.g. balance the classes."""
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    w = np.zeros(len(cols))
    sw = F.col(weight) if weight else F.lit(1.0)
    for _ in range(steps):
        p = 1 / (1 + F.exp(-sum((c * float(x) for c, x in zip(cols[1:], w[1:], strict=True)), cols[0] * float(w[0]))))
        d, h = sw * (p - F.col(label)), sw * p * (1 - p)
        n = len(cols)
        row = df.agg(*[F.sum(d * cols[i]).alias(f"g{i}") for i in range(n)], *[F.sum(h * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)], F.sum(sw).alias("n")).first()
        pen = np.r_[0.0, np.full(n - 1, l2)] * row["n"]
        g = np.array([row[f"g{i}"] for i in range(n)]) + pen * w
        hm = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)]) + np.diag(pen + 1e-9)
        delta = np.linalg.solve(hm, g)
        w = w - delta
        if np.abs(delta).max() < 1e-8:
            break
    return float(w[0]), w[1:]


def balanced_weights(df: DataFrame, label: str, cap: float = 30.0) -> DataFrame:
    """Rows with ``weight``: positives weigh negatives / positives, at most ``cap``."""
    n = df.agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    pos = min(cap, (n["n"] - (n["p"] or 0)) / max(n["p"] or 0, 1))
    return df.withColumn("weight", F.when(F.col(label) == 1, F.lit(float(pos))).otherwise(1.0))


def out_of_fold(df: DataFrame, features: Sequence[str], label: str, fold: str, folds: Sequence[int]) -> DataFrame:
    """Rows with ``oof``: each fold's probability from the model fitted on the others."""
    out = F.lit(None).cast("double")
    for k in folds:
        b, w = logistic(df.where(F.col(fold) != k), features, label)
        out = F.when(F.col(fold) == k, 1 / (1 + F.exp(-predict(features, b, w)))).otherwise(out)
    return df.withColumn("oof", out)


def clusters(df: DataFrame, vector: str, k: int, label: str, seed: int = 1) -> DataFrame:
    """(cluster, n, majority, purity): k-means clusters named by their commonest label."""
    v = df.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"), label)
    got = KMeans(k=k, seed=seed, maxIter=20).fit(v).transform(v).groupBy(F.col("prediction").alias("cluster"), label).agg(F.count(F.lit(1)).alias("n"))
    return got.groupBy("cluster").agg(F.sum("n").alias("n"), F.max_by(label, F.struct("n", -F.col(label))).alias("majority"), (F.max("n") / F.sum("n")).alias("purity"))


def principal(df: DataFrame, keys: Sequence[str], vector: str, k: int) -> DataFrame:
    """(keys, pc): coordinates on the first ``k`` principal directions."""
    v = df.select(*keys, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="_pc").fit(v).transform(v).select(*keys, vector_to_array("_pc").alias("pc"))


def bagged_selection(df: DataFrame, members: Sequence[str], true: str, bags: int, picks: int, key: str) -> dict[str, float]:
    """Share of picks of each member in greedy ensemble selection with replacement over ``bags`` halves of the keys.

    Each pick scores every candidate average by squared error in one aggregate.
    """
    used = dict.fromkeys(members, 0)
    for b in range(bags):
        part = df.where(F.pmod(F.xxhash64(F.col(key), F.lit(b)), F.lit(2)) == 0)
        total, n = F.lit(0.0), 0
        for _ in range(picks):
            row = part.agg(*[F.avg(F.pow((total + F.col(m)) / (n + 1) - F.col(true), F.lit(2.0))).alias(m) for m in members]).first()
            best = min(members, key=lambda m: (row[m] if row[m] is not None else np.inf, m))
            total, n = total + F.col(best), n + 1
            used[best] += 1
    return {m: c / (bags * picks) for m, c in used.items()}


def fit_calibrator(df: DataFrame, p: str, cls: str, classes: int, l2: float = 1.0, steps: int = 60, rate: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(W, b) of softmax(W log p + b), drawn to the identity by ``l2``; gradient steps, each one aggregate of K*(K+1) sums."""
    w, b = np.eye(classes), np.zeros(classes)
    lg = [F.ln(F.greatest(F.get(p, F.lit(k)), F.lit(1e-6))) for k in range(classes)]
    n = df.count()
    for _ in range(steps):
        z = [sum((lg[j] * float(w[i, j]) for j in range(1, classes)), lg[0] * float(w[i, 0])) + float(b[i]) for i in range(classes)]
        top = F.greatest(*z)
        e = [F.exp(x - top) for x in z]
        total = sum(e[1:], e[0])
        d = [e[i] / total - (F.col(cls) == i).cast("double") for i in range(classes)]
        row = df.agg(*[F.avg(d[i]).alias(f"b{i}") for i in range(classes)], *[F.avg(d[i] * lg[j]).alias(f"w{i}_{j}") for i in range(classes) for j in range(classes)]).first()
        gw = np.array([[row[f"w{i}_{j}"] for j in range(classes)] for i in range(classes)]) + l2 * (w - np.eye(classes)) / max(n, 1)
        w, b = w - rate * gw / 4, b - rate * np.array([row[f"b{i}"] for i in range(classes)])
    return w, b
