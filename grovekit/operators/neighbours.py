"""Nearest neighbours of embeddings by cosine (JON-17): a stated query set against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grovekit.scale import parts_for

#: Rows of a block of queries, and of a block of the base: what a task holds at once.
QUERY_BLOCK, BASE_BLOCK = 1024, 4096


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _blocks(df: DataFrame, ident: str, vector: str, keep: Sequence[str], rows: int, name: str) -> DataFrame:
    """Rows packed to arrays of about ``rows`` each; null ids and vectors are left out."""
    df = df.where(F.col(ident).isNotNull() & F.col(vector).isNotNull()).select(ident, vector, *keep)
    n = parts_for(df.count(), rows)
    return df.groupBy(F.pmod(F.xxhash64(ident), F.lit(n)).alias(f"_{name}")).agg(F.collect_list(F.struct(ident, vector, *keep)).alias(name))


def knn(queries: DataFrame, base: DataFrame, ident: str, vector: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """(ident, other, keep…, rank, sim) of the ``k`` rows of ``base`` most similar to each query; a row is not its own neighbour.

    A stated query set against all rows, in blocks: both are packed to blocks of bounded size, and each block of queries meets
    each block of the base once.  Nothing comes to the driver.  Of a pair of blocks only the ``k`` best for each query go
    on, so what is shuffled is at most queries * k * base blocks.  Equal similarities (to 6 digits) go by the smaller id.
    """
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    cols = [ident, "other", *keep, "sim"]
    schema = f"{ident} {kinds[ident]}, other {kinds[ident]}, " + "".join(f"{c} {kinds[c]}, " for c in keep) + "sim double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qs, bs in zip(pdf["q"], pdf["b"], strict=True):
                ids, other = np.array([r[ident] for r in qs]), np.array([r[ident] for r in bs])
                sim = np.round(_unit(np.array([r[vector] for r in qs], dtype=float)) @ _unit(np.array([r[vector] for r in bs], dtype=float)).T, 6)
                sim[ids[:, None] == other[None, :]] = -np.inf
                top = min(k, sim.shape[1])
                col = np.lexsort((np.broadcast_to(other, sim.shape), -sim), axis=1)[:, :top].ravel()
                row = np.repeat(np.arange(len(ids)), top)
                df = pd.DataFrame({ident: ids[row], "other": other[col], **{c: np.array([r[c] for r in bs], dtype=object)[col] for c in keep}, "sim": sim[row, col]})
                yield df[np.isfinite(df["sim"])]

    pairs = _blocks(queries, ident, vector, (), QUERY_BLOCK, "q").crossJoin(_blocks(base, ident, vector, keep, BASE_BLOCK, "b"))  # blocks, not rows
    w = Window.partitionBy(ident).orderBy(F.desc("sim"), "other")
    best = pairs.select("q", "b").repartition(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInPandas(run, schema)
    return best.select(*cols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("bigint"))


def votes(neighbours: DataFrame, ident: str, label: str, ks: Sequence[int]) -> DataFrame:
    """(ident, k, uniform, weighted): the label most of the ``k`` nearest have, by number and by inverse distance; ties go to the smaller label."""
    each = neighbours.withColumn("k", F.explode(F.lit(list(ks)))).where(F.col("rank") <= F.col("k"))
    per = each.groupBy(ident, "k", label).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(1 / F.greatest(1 - F.col("sim"), F.lit(1e-6))).alias("w"))
    first = lambda c: F.max(F.struct(F.round(c, 6).alias("v"), (-F.col(label)).alias("l")))["l"]
    return per.groupBy(ident, "k").agg((-first(F.col("n"))).alias("uniform"), (-first(F.col("w"))).alias("weighted"))
