"""Ranking, top-k, constrained selection and set helpers (SRT, SET)."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def N() -> Column:
    """Number of rows."""
    return F.count(F.lit(1))



def _modes() -> dict[str, Column]:
    s, n, p, m = F.col("score"), F.col("n"), F.col("purity"), F.col("most")
    out = {"score": s, "support": s * F.sqrt(n), "max_member": m, "class_conf": s * p, "joint_conf": s * p * m, "head_conf": p, "support_head": p * F.sqrt(n), "score_conf": s + p}
    for name, a, b in (("score_power", 0.5, 2.0), ("head_power", 1.0, 0.5), ("joint_power", 0.5, 0.5), ("support_power", 1.0, 1.0)):
        out[name] = F.pow(s, F.lit(a)) * F.pow(p, F.lit(b)) * (F.sqrt(n) if name.startswith("support") else F.lit(1.0))
    return out


class _Modes(dict):
    """Built at first use: columns need a session."""

    def __missing__(self, key: str) -> Column:
        self.update(_modes())
        return dict.__getitem__(self, key)


#: Keys by which clusters (score, n members, most: best member's score, purity: class confidence) are ranked.
RANK_MODES = _Modes()


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; the optimiser keeps ``k`` rows a partition before the shuffle."""
    out = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank or "_rank") <= k)
    return out if rank else out.drop("_rank")


def capped(df: DataFrame, key: str, order: Sequence[Column], target: str) -> DataFrame:
    """At most as many rows of a key as its own ``target`` says, best first; never adds rows."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= F.col(target)).drop("_rank")


def quota_classes(df: DataFrame, key: str, order: Sequence[Column], cls: str, classes: int) -> DataFrame:
    """Classes dealt by rank within a key, as many of each as the key has: the first ones get class 0, the next 1 …"""
    quota = df.groupBy(key).agg(*[F.count_if(F.col(cls) <= k).alias(f"_q{k}") for k in range(classes - 1)])
    ranked = df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).join(quota, key)
    out = F.lit(classes - 1)
    for k in range(classes - 2, -1, -1):
        out = F.when(F.col("_k") <= F.col(f"_q{k}"), k).otherwise(out)
    return ranked.withColumn("quota_cls", out.cast("int")).drop("_k", *[f"_q{k}" for k in range(classes - 1)])


def best_of(df: DataFrame, criteria: dict[str, Column], keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` best rows by each criterion, for an audit trail."""
    out = None
    for name, c in criteria.items():
        part = df.orderBy(c.desc(), *keys).limit(n).select(F.lit(name).alias("criterion"), *keys)
        out = part if out is None else out.union(part)
    return out


def dominating(df: DataFrame, base: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Rows at least as good as the one row of ``base`` in every metric."""
    one = base.agg(*[F.max(m).alias(f"_b_{m}") for m in metrics])
    ok = F.lit(True)
    for m in metrics:
        ok = ok & (F.col(m) >= F.col(f"_b_{m}"))
    return df.join(F.broadcast(one), ok).drop(*[f"_b_{m}" for m in metrics])


def best_subset(df: DataFrame, member: str, value: str, size: int) -> DataFrame:
    """The subset of ``size`` members with the largest summed value, the first in order of the members on ties.

    ``df`` has one row a member, a handful; values must add up over members.
    """
    rows = sorted((r[member], r[value]) for r in df.select(member, value).collect())
    best = max(combinations(rows, size), key=lambda c: (sum(v for _, v in c), [-m for m, _ in c]))
    cols = [F.lit(m).cast("bigint").alias(f"m{i + 1}") for i, (m, _) in enumerate(best)]
    return df.sparkSession.range(1).select(*cols, F.lit(sum(v for _, v in best)).cast("bigint").alias("n"))


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys of b missing from a, and keys of a that b hasn't."""
    ka, kb = a.select(*keys).distinct(), b.select(*keys).distinct()
    missing = kb.join(ka, list(keys), "left_anti").agg(N().alias("missing"))
    return missing.crossJoin(ka.join(kb, list(keys), "left_anti").agg(N().alias("extra")))


def bag_union(frames: Sequence[DataFrame], source: str, start: int = 0) -> DataFrame:
    """All rows of all frames with the number of the frame they come from."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn(source, F.lit(start + i))
        out = part if out is None else out.unionByName(part)
    return out


def same_outputs(df: DataFrame, model: str, keys: Sequence[str], value: str, tolerance: float) -> DataFrame:
    """Pairs of models, and whether all their common values agree within the tolerance."""
    b = df.select(*keys, F.col(model).alias("m2"), F.col(value).alias("_v"))
    pairs = df.withColumnRenamed(model, "m1").join(b, list(keys)).where("m1 < m2")
    return pairs.groupBy("m1", "m2").agg((F.max(F.abs(F.col(value) - F.col("_v"))) < tolerance).alias("same"))
