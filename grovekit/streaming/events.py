"""Streaming surface over event tables (an extension: the batch operators have no streams).

Every function takes a batch or a streaming frame alike.  ``run_to_table`` drives a stream through all available data into a
table of the workspace, with its checkpoint beside it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from grovekit.scale import Workspace


def event_stream(spark: SparkSession, path: str, files_per_batch: int = 16) -> DataFrame:
    """The events as a stream of their Parquet files; ``ts`` becomes an instant, so that it can carry a watermark."""
    schema = spark.read.parquet(path).schema
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    df = src.parquet(path) if not path.endswith(".parquet") else src.option("pathGlobFilter", path.rsplit("/", 1)[1]).parquet(path.rsplit("/", 1)[0])
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(df: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) for each window of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = df.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, stop, n): a user's events without a pause of ``gap``."""
    g = df.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def without_repeats(df: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First row of each key; repeats later than the watermark may pass in a stream."""
    return df.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if df.isStreaming else df.dropDuplicates(keys)


class RunningGroups(StatefulProcessor):
    """Keeps, per key, the number of rows, the sum and the latest value; emits them at every batch that brings rows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n bigint, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for pdf in rows:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    def close(self) -> None:
        pass


def running_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").transformWithStateInPandas(RunningGroups(), "user_id bigint, n bigint, total double", "Update", "None")


def run_to_table(stream: DataFrame, ws: Workspace, name: str, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """All available data through the stream into a table.

    In complete mode the last batch's result counts.  In update mode every batch brings only the ``keys`` it has rows of: each
    batch is written to a folder of its own (again, if it is repeated), and a key's row is that of its latest batch.
    """
    path = ws.path(name)
    out = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", path + "-state")
    if mode == "append":
        out.format("parquet").option("path", path).start().awaitTermination()
    elif mode == "complete":
        out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start().awaitTermination()
    else:
        if not keys:
            raise ValueError("update mode needs the keys that a batch replaces")
        out.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{path}/_batch={i}")).start().awaitTermination()
        rest = [c for c in stream.columns if c not in keys]
        every = ws.spark.read.option("basePath", path).parquet(f"{path}/_batch=*")
        return every.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, "_r.*")
    return ws.spark.read.schema(stream.schema).parquet(path)
