"""Writers of metric documents, dumps, reports and tree documents (SNK-01..08)."""

from __future__ import annotations

import io
import time
import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def metric_document(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def detection_dump(df: DataFrame, path: str, by: Sequence[str] = ("model", "split")) -> None:
    """Detections as Parquet, a folder for each model and split."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def encode_npz(df: DataFrame, group: str, stem: str = "stem") -> DataFrame:
    """(group, content): an NPZ archive for each group with an N x 6 matrix (box, score, class) for each stem.

    A group (a shard of images) must fit a task; choose it by a hash of the stem.
    """
    kind = df.schema[group].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        buf = io.BytesIO()
        np.savez(buf, **{str(k): g[["x1", "y1", "x2", "y2", "score", "cls"]].to_numpy(float) for k, g in pdf.sort_values("row_index").groupby(stem)})
        return pd.DataFrame({group: [pdf[group].iloc[0]], "content": [buf.getvalue()]})

    return df.groupBy(group).applyInPandas(run, f"{group} {kind}, content binary")


def encode_depth(df: DataFrame, width: int, height: int) -> DataFrame:
    """(path, content): raw little-endian uint16 images of (path, v, u, mm)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros((height, width), dtype="<u2")
        z[pdf["v"], pdf["u"]] = pdf["mm"]
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "content": [z.tobytes()]})

    return df.groupBy("path").applyInPandas(run, "path string, content binary")


def summary_csv(df: DataFrame, fields: Sequence[str], path: str) -> None:
    """A CSV with a fixed list of fields, in their order."""
    df.select(*fields).write.mode("overwrite").csv(path, header=True)


def markdown_matrix(df: DataFrame, row: str, column: str, values: Sequence[str], cell: str, digits: int = 3) -> DataFrame:
    """(pos, line) of a Markdown table: one row for each ``row``, one column for each of ``values``; the best cell of a row bold."""
    wide = df.groupBy(row).pivot(column, list(values)).agg(F.max(cell))
    cols = [F.col(f"`{v}`") for v in values]
    best = F.greatest(*cols) if len(cols) > 1 else cols[0]
    shown = [F.when(c.isNull(), F.lit("-")).when(c == best, F.concat(F.lit("**"), F.printf(F.lit(f"%.{digits}f"), c), F.lit("**"))).otherwise(F.printf(F.lit(f"%.{digits}f"), c)) for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(row).cast("string"), *shown), F.lit(" |"))
    spark = df.sparkSession
    head = spark.createDataFrame([(0, "", "| " + " | ".join([row, *map(str, values)]) + " |"), (1, "", "|" + " - |" * (len(values) + 1))], "pos int, key string, line string")
    return head.union(wide.select(F.lit(2), F.col(row).cast("string"), line))


def tree_documents(boxes: DataFrame) -> DataFrame:
    """(tree_id, body): a JSON document for each tree from (tree_id, side, box_index, cls, x1..y2), images by side."""
    box = F.struct("box_index", F.col("cls").alias("class_id"), F.array("x1", "y1", "x2", "y2").alias("bbox_pixel"))
    image = boxes.groupBy("tree_id", "side").agg(F.sort_array(F.collect_list(box)).alias("annotations"))  # one image
    named = F.struct(F.concat(F.lit("side_"), F.col("side") + 1), F.struct(F.col("side").alias("side_index"), "annotations"))
    doc = image.groupBy("tree_id").agg(F.map_from_entries(F.sort_array(F.collect_list(named))).alias("images"))  # one tree
    return doc.select("tree_id", F.to_json(F.struct("tree_id", "images")).alias("body"))


def payload_digest(cols: Sequence[str]) -> Column:
    """Digest of a row's payload, whatever the order of the columns."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def enrich(recorded: DataFrame, changed: DataFrame, keys: Sequence[str], payload: Sequence[str], meta: Sequence[str]) -> DataFrame:
    """Recorded rows with the metadata columns of ``changed``, and ``_unchanged``: whether the payload came through as it was.

    A row whose payload's digest differs from the recorded one is rolled back: it keeps the recorded payload and gets no
    metadata.  Rows that only one of the two tables has are left as they are recorded, or left out.
    """
    new = changed.select(*keys, payload_digest(payload).alias("_d"), F.struct(*meta).alias("_m"))
    same = F.coalesce(payload_digest(payload) == F.col("_d"), F.lit(False))
    both = recorded.select(*keys, *payload).join(new, list(keys), "left").withColumn("_unchanged", same)
    return both.select(*keys, *payload, *[F.when(F.col("_unchanged"), F.col(f"_m.{m}")).alias(m) for m in meta], "_unchanged")


def replace_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path`` in one step: readers see the old rows or the new ones, never none or half.

    Rows are written to a folder of their own; then a small pointer file is renamed over the old one, which file systems do in
    one step.  The folder before is kept for readers that still use it; older ones are removed.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = f"rows-{time.time_ns()}-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}")
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer-{name}")
    out = system.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    before = _pointed(spark, path)
    rename = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.getFileSystem(conf).getUri(), conf).rename(draft, jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer"), rename)
    for f in system.listStatus(root):
        old = f.getPath().getName()
        if old.startswith("rows-") and old not in (name, before) and old < name:
            system.delete(f.getPath(), True)


def _pointed(spark: SparkSession, path: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_pointer")
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(p):
        return None
    stream = system.open(p)
    text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return text


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table last put at ``path`` by :func:`replace_table`."""
    name = _pointed(spark, path)
    if name is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.parquet(f"{path}/{name}")
