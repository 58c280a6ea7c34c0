"""Building blocks that keep plans alive at scale: shared working tables, two-level grouping and exact distributed ranks.

Nothing here collects rows to the driver.  Working tables are ordinary Parquet tables in the folder that the session names in
``spark.checkpoint.dir``, so a lost executor only costs a re-read.
"""

from __future__ import annotations

import atexit
import contextlib
import math
import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space, byte order mark and no-break space, as they occur around dirty names.
BLANKS = " \t\r\n\f\x0b﻿ ​"


#: Rows of one group that a task may sort: larger groups are dealt to as many parts as that takes.
PART_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for working tables: the session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (``local``) gets an own folder; on a cluster it is an error, since executors
    could not read each other's disks.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="grovekit-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def parts_for(rows: int, each: int = PART_ROWS) -> int:
    """Parts that hold about ``each`` rows at most, even if all rows are of one group."""
    return max(1, -(-rows // each))


def score_cuts(df: DataFrame, c: str, parts: int) -> list[float]:
    """Rising cuts of a numeric column into about ``parts`` ranges of equally many rows (one range needs none).

    Equal values stay in one range: a value that very many rows share makes its range larger, never wrong.
    """
    if parts <= 1:
        return []
    found = df.agg(F.percentile_approx(c, [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] or []
    return sorted({float(x) for x in found})


def band_of(c: Column, cuts: Sequence[float]) -> Column:
    """How many of the rising ``cuts`` a value reaches, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    wide = math.isqrt(len(cuts) - 1) + 1
    firsts = F.lit(list(cuts[::wide]))
    block = F.size(F.filter(firsts, lambda x: x <= c))
    inside = F.filter(F.slice(F.lit(list(cuts)), (F.greatest(block, F.lit(1)) - 1) * wide + 1, F.lit(wide)), lambda x: x <= c)
    return F.when(block == 0, 0).otherwise((block - 1) * wide + F.size(inside)).cast("int")


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Remove a table when the program ends."""
    atexit.register(_delete, spark, path)


class Workspace:
    """Working tables of one job under :func:`shared_dir`.

    ``save`` cuts the lineage: it writes the frame as Parquet and returns a frame that reads it.  ``drop`` removes a table as
    soon as no later step needs it; ``close`` removes the rest, at the latest when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        removed_at_end(spark, self.root)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, self.path(name))

    def release(self) -> None:
        """Have the shuffle files of the steps before the last ``save`` removed: Spark keeps them until the driver's JVM happens to collect garbage."""
        with contextlib.suppress(Exception):
            self.spark._jvm.System.gc()

    def close(self) -> None:
        _delete(self.spark, self.root)


def tidy(c: Column) -> Column:
    """Text without blanks or byte order marks around it."""
    return F.btrim(c, F.lit(BLANKS))


def salt_of(c: Column, salts: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")


def star_edges(df: DataFrame, keys: Sequence[str], vertex: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Edges (a, b), a > b, that connect all vertices sharing ``keys``, through at most two hops.

    A group is first split by a salt of the vertex, each part linked to its smallest vertex, then those to the smallest of
    all; there are as many salts as keep a part at about ``part_rows`` rows even if one group holds all of them.  Null keys
    must be filtered out by the caller.
    """
    salts = parts_for(df.count(), part_rows)
    w1 = Window.partitionBy(*keys, "_salt")
    w2 = Window.partitionBy(*keys)
    part = df.select(*keys, F.col(vertex).alias("a")).withColumn("_salt", salt_of(F.col("a"), salts))
    low = part.groupBy(*keys, "_salt").agg(F.min("a").alias("b"))
    inner = part.withColumn("b", F.min("a").over(w1)).where("a > b").select("a", "b")
    outer = low.withColumn("m", F.min("b").over(w2)).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return inner.union(outer)


def distributed_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Exact 0-based rank within ``keys`` without putting a whole group into one task.

    Rows of a group are dealt to parts of about ``part_rows`` rows by a hash of the order columns; the rank counts within (group, part) and then adds
    the sizes of the group's earlier parts.  It is a numbering without gaps or ties, the same at every run, though not in
    sort order across parts (callers that only need distinct consecutive ranks can use it on groups of any size).
    """
    parts = parts_for(df.count(), part_rows)
    w = Window.partitionBy(*keys, "_part").orderBy(*order)
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    ranked = dealt.withColumn("_rn", F.row_number().over(w))
    joined = ranked.join(offset.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p2"), "_off"),
                         [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p2")])
    return joined.withColumn(out, F.col("_off") + F.col("_rn") - 1).drop("_rn", "_off", "_part", "_p2", *[f"_k{i}" for i in range(len(keys))])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def with_source_row(df: DataFrame, out: str = "source_row") -> DataFrame:
    """A scan of Parquet files with a unique text for each row: its file's name and its place there, the same at every read."""
    return df.withColumn(out, F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index")))
