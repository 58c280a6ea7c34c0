"""Functions callable from SQL: native SQL functions, vectorised functions and a table function (the extension points)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SQL_FUNCTIONS = """
CREATE OR REPLACE TEMPORARY FUNCTION box_iou(a1 DOUBLE, b1 DOUBLE, a2 DOUBLE, b2 DOUBLE, c1 DOUBLE, d1 DOUBLE, c2 DOUBLE, d2 DOUBLE) RETURNS DOUBLE
RETURN greatest(least(a2, c2) - greatest(a1, c1), 0D) * greatest(least(b2, d2) - greatest(b1, d1), 0D)
 / greatest((a2 - a1) * (b2 - b1) + (c2 - c1) * (d2 - d1) - greatest(least(a2, c2) - greatest(a1, c1), 0D) * greatest(least(b2, d2) - greatest(b1, d1), 0D), 1e-9D);
CREATE OR REPLACE TEMPORARY FUNCTION class_label(c INT) RETURNS STRING RETURN CASE WHEN c BETWEEN 0 AND 3 THEN concat('B', c + 1) ELSE 'unknown' END
"""


class Suppress:
    """Table function over one image's boxes (array of structs): ids kept by greedy suppression."""

    def eval(self, boxes: list, cut: float):
        from grovekit.operators.fusion import suppress

        for r in suppress([b.asDict() for b in boxes or []], cut):
            yield (r["det_id"],)


def embedding_norm(v: pd.Series) -> pd.Series:
    return v.map(lambda x: float(np.linalg.norm(np.asarray(x, dtype=float))) if x is not None else None)


def register(spark: SparkSession) -> None:
    """Register all of them in the session."""
    for statement in SQL_FUNCTIONS.split(";"):
        spark.sql(statement.strip())
    spark.udf.register("embedding_norm", F.pandas_udf(embedding_norm, "double"))
    spark.udtf.register("suppress_boxes", F.udtf(Suppress, returnType="det_id bigint"))
