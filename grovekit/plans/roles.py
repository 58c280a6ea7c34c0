"""The roles that the driver's star-schema tables play: detections, ground truth and class probabilities.

An order is an image (``stem``), four orders a tree, a line item a detected box; every second line is also a true box, moved a
few pixels.  The SQL twins begin with the same derivation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovekit.functions.vectors import soft_one_hot
from grovekit.scale import read

CLASSES = 4

DET_SQL = """det AS (
  SELECT l_orderkey AS stem, l_orderkey // 4 AS tree, CAST(l_orderkey % 4 AS INTEGER) AS side,
    CAST(round(l_extendedprice * 100) AS BIGINT) * 10 + l_linenumber AS det_id, CAST(l_suppkey % 3 AS INTEGER) AS model,
    CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS INTEGER) AS cls,
    (l_quantity + CAST(500 AS DOUBLE) * l_discount) / CAST(101 AS DOUBLE) AS score,
    CAST(l_partkey * 7 % 1000 AS DOUBLE) AS x1, CAST(l_suppkey * 13 % 700 AS DOUBLE) AS y1,
    CAST(l_partkey * 7 % 1000 AS DOUBLE) + 20 + l_quantity AS x2,
    CAST(l_suppkey * 13 % 700 AS DOUBLE) + 20 + l_linenumber * 9 % 40 AS y2,
    l_linenumber AS line, l_tax AS tax, CAST(l_shipdate AS TIMESTAMP) AS shot_at
  FROM lineitem)"""
GT_SQL = """gt AS (
  SELECT stem, tree, side, det_id AS gt_id, cls, x1 + tax * 100 AS x1, y1 + tax * 100 AS y1, x2 + tax * 100 AS x2, y2 + tax * 100 AS y2,
    CAST(det_id // 10 % 5 AS INTEGER) AS bunch FROM det WHERE line % 2 = 0)"""


def sql(body: str) -> str:
    """A query over ``det`` and ``gt``; the body may begin with further common tables (", name AS (...)")."""
    return f"WITH RECURSIVE {DET_SQL},\n{GT_SQL}\n{body.strip()}"


def det(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    c = F.col
    x1, y1 = (c("l_partkey") * 7 % 1000).cast("double"), (c("l_suppkey") * 13 % 700).cast("double")
    cls = F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2) + F.when(c("l_linestatus") == "O", 1).otherwise(0)
    return li.select(
        c("l_orderkey").alias("stem"), F.floor(c("l_orderkey") / 4).cast("bigint").alias("tree"), (c("l_orderkey") % 4).cast("int").alias("side"),
        (F.round(c("l_extendedprice") * 100).cast("bigint") * 10 + c("l_linenumber")).alias("det_id"), (c("l_suppkey") % 3).cast("int").alias("model"), cls.cast("int").alias("cls"),
        ((c("l_quantity") + F.lit(500.0) * c("l_discount")) / F.lit(101.0)).alias("score"),
        x1.alias("x1"), y1.alias("y1"), (x1 + 20 + c("l_quantity")).alias("x2"), (y1 + 20 + c("l_linenumber") * 9 % 40).alias("y2"),
        c("l_linenumber").alias("line"), c("l_tax").alias("tax"), c("l_shipdate").cast("timestamp_ntz").alias("shot_at"))


def gt(spark: SparkSession, d: str) -> DataFrame:
    off = F.col("tax") * 100
    return det(spark, d).where(F.col("line") % 2 == 0).select("stem", "tree", "side", F.col("det_id").alias("gt_id"), "cls", *[(F.col(k) + off).alias(k) for k in ("x1", "y1", "x2", "y2")], (F.floor(F.col("det_id") / 10) % 5).cast("int").alias("bunch"))


def probs(df: DataFrame) -> DataFrame:
    """Detections with class probabilities ``p``: the score on the own class, the rest spread evenly."""
    return df.withColumn("p", soft_one_hot(F.col("cls"), F.col("score"), CLASSES))


P_SQL = "[CASE WHEN cls = k THEN score ELSE (1 - score) / 3 END FOR k IN range(4)]"
IOU_SQL = """(greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0))
 / greatest(({a}.x2-{a}.x1)*({a}.y2-{a}.y1)+({b}.x2-{b}.x1)*({b}.y2-{b}.y1)
 - greatest(least({a}.x2,{b}.x2)-greatest({a}.x1,{b}.x1),0)*greatest(least({a}.y2,{b}.y2)-greatest({a}.y1,{b}.y1),0), 1e-9)"""


def iou_sql(a: str, b: str) -> str:
    return IOU_SQL.format(a=a, b=b)
