"""Contracts on tables that stop a job, and audits that count violations (FLT-07, JON-18, VAL)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The same rows; the job fails with the rule's name at the first row that breaks one (null counts as broken)."""
    ok = F.lit(True)
    for name, rule in rules.items():
        ok = F.when(F.coalesce(rule, F.lit(False)), ok).otherwise(F.raise_error(F.lit(name)).cast("boolean"))
    return df.where(ok)


def aligned(a: DataFrame, b: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row: keys only in a, only in b, and keys whose values differ."""
    left = a.select(*keys, F.struct(*values).alias("_va"))
    right = b.select(*keys, F.struct(*values).alias("_vb"))
    both = left.join(right, keys, "full")
    count = lambda c, name: F.count_if(c).alias(name)
    return both.agg(count(F.col("_vb").isNull(), "only_left"), count(F.col("_va").isNull(), "only_right"), count(F.col("_va").isNotNull() & F.col("_vb").isNotNull() & ~F.col("_va").eqNullSafe(F.col("_vb")), "differing"))


def anchored(df: DataFrame, c: str, expected: float, tolerance: float) -> DataFrame:
    """The same rows; the job fails where ``c`` is further than ``tolerance`` from a recorded number."""
    return require(df, {f"{c} isn't {expected:g} within {tolerance:g}": F.abs(F.col(c) - expected) <= tolerance})


def take_lock(spark, path: str) -> bool:
    """Whether this call created the lock file: a locked evaluation runs once."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.createNewFile(p))
