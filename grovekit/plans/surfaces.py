"""Queries of the streaming and function surfaces (STR, UDF) and of file listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovekit.functions import surface
from grovekit.plans.registry import Registry
from grovekit.plans.roles import det, iou_sql, sql
from grovekit.scale import Workspace, read
from grovekit.sources import files
from grovekit.streaming import events as E


def register(reg: Registry) -> None:
    q = reg.query

    def stream(s, d):
        return E.event_stream(s, f"{d}/events.parquet")

    @q("src_08_image_files")
    def src_08(s, d):
        return files.image_files(s, f"{d}/events.parquet").select(files.stem_of(F.col("path")).alias("stem"), "length")

    @q("str_01_tumbling_stream", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY ALL")
    def str_01(s, d):
        out = E.run_to_table(E.tumbling(stream(s, d), "1 day"), Workspace(s, "stream"), "days", "complete")
        return out.withColumn("start", F.col("start").cast("timestamp_ntz"))

    @q("str_02_sliding", "SELECT b AS start, event_type, count(*) AS n, round(sum(value),4) AS total FROM (SELECT time_bucket(INTERVAL '1 hour', ts) - INTERVAL '1 hour' * k AS b, event_type, value FROM events, range(0,2) r(k)) GROUP BY ALL")
    def str_02(s, d):
        ev = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        return E.tumbling(ev, "2 hours", "1 hour").withColumn("start", F.col("start").cast("timestamp_ntz"))

    @q("str_03_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS new FROM events), h AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '6 hours' AS stop, count(*) AS n FROM h GROUP BY user_id, k")
    def str_03(s, d):
        ev = read(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
        out = E.sessions(ev, "6 hours")
        return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")

    @q("str_04_dedup_stream", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
    def str_04(s, d):
        twice = stream(s, d).withColumn("k", F.explode(F.lit([1, 2]))).drop("k")
        out = E.run_to_table(E.without_repeats(twice, ["event_id"], "3650 days"), Workspace(s, "stream"), "once")
        return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))

    @q("str_05_stateful_stream", "SELECT user_id, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1")
    def str_05(s, d):
        conf = "spark.sql.streaming.stateStore.providerClass"
        before = s.conf.get(conf)
        s.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # only for this stream
        try:
            return E.run_to_table(E.running_totals(stream(s, d).select("user_id", "value")), Workspace(s, "stream"), "totals", "update", ["user_id"])
        finally:
            s.conf.set(conf, before)

    @q("udf_01_sql_functions", sql(f"SELECT a.stem, a.det_id, b.gt_id, round({iou_sql('a', 'b')},6) AS iou, CASE WHEN a.cls BETWEEN 0 AND 3 THEN 'B' || (a.cls+1) ELSE 'unknown' END AS label FROM det a JOIN gt b ON a.stem=b.stem WHERE {iou_sql('a', 'b')} > 0.5"))
    def udf_01(s, d):
        surface.register(s)
        from grovekit.plans.roles import gt
        g = gt(s, d).select("stem", "gt_id", *[F.col(c).alias("g" + c) for c in ("x1", "y1", "x2", "y2")])
        return det(s, d).join(g, "stem").selectExpr("stem", "det_id", "gt_id", "box_iou(x1, y1, x2, y2, gx1, gy1, gx2, gy2) AS v", "class_label(cls) AS label").where("v > 0.5").select("stem", "det_id", "gt_id", F.round("v", 6).alias("iou"), "label")

    @q("udf_02_table_function")
    def udf_02(s, d):
        surface.register(s)
        det(s, d).groupBy("stem").agg(F.collect_list(F.struct("det_id", "x1", "y1", "x2", "y2", "score", "cls")).alias("boxes")).createOrReplaceTempView("_images")
        return s.sql("SELECT stem, det_id FROM _images, LATERAL suppress_boxes(boxes, 0.3D)")

    @q("udf_03_vectorised", "SELECT vec_id, round(sqrt(list_sum([CAST(x AS DOUBLE)*CAST(x AS DOUBLE) FOR x IN embedding])),5) AS norm FROM embeddings")
    def udf_03(s, d):
        surface.register(s)
        return read(s, d, "embeddings").selectExpr("vec_id", "round(embedding_norm(embedding), 5) AS norm")
