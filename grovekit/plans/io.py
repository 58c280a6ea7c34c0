"""Queries of scans and sinks (SRC, SNK): tables are written in the format and read back, whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from grovekit.operators import nested
from grovekit.plans.registry import Registry
from grovekit.plans.roles import det, sql
from grovekit.scale import Workspace, read, tidy
from grovekit.sources import files, sinks

SPLITS = "CASE WHEN lower(trim(new_split)) IN ('train','latih') THEN 'train' WHEN lower(trim(new_split)) IN ('val','valid','validasi') THEN 'val' WHEN lower(trim(new_split)) IN ('test','uji') THEN 'test' END"


def register(reg: Registry) -> None:
    q = reg.query

    def path(s, name):
        return Workspace(s, "io").path(name)

    @q("src_01_manifest_csv", f"SELECT {SPLITS} AS new_split, cls, CAST(sum(n) AS BIGINT) AS n FROM (SELECT new_split, unnest(['B1','B2','B3','B4']) AS cls, unnest([B1,B2,B3,B4]) AS n FROM split_manifest) WHERE {SPLITS} IS NOT NULL GROUP BY ALL")
    def src_01(s, d):
        p = path(s, "manifest")
        read(s, d, "split_manifest").select("tree_id", "variety", "new_split", "B1", "B2", "B3", "B4").write.csv(p, header=True)
        return files.manifest_counts(files.manifest_csv(s, p)).groupBy("new_split", "cls").agg(F.sum("n").alias("n"))

    @q("src_02_tree_json", "SELECT doc_no, count(*) AS n FROM (SELECT doc_no, unnest(map_entries(images)) AS e FROM tree_doc) GROUP BY doc_no")
    def src_02(s, d):
        p = path(s, "trees")
        read(s, d, "tree_doc").select(F.to_json(F.struct("doc_no", "tree_id", "images", "bunches")).alias("value")).write.text(p)
        docs = s.read.text(p).withColumn("doc_no", F.get_json_object("value", "$.doc_no").cast("bigint")).withColumn("raw_id", F.lit(0).cast("bigint"))
        return nested.json_nodes(docs, "doc_no", "raw_id", "value").where("path = 'images'").groupBy("doc_no").agg(F.count(F.lit(1)).alias("n"))

    @q("src_03_folder_split", f"SELECT {SPLITS} AS split, count(*) AS n FROM split_manifest WHERE {SPLITS} IS NOT NULL GROUP BY 1")
    def src_03(s, d):
        folder = F.concat(F.lit("/corpus/"), F.col("new_split"), F.lit("/"), F.col("row_id"), F.lit(".json"))
        return read(s, d, "split_manifest").select(files.folder_split(folder).alias("split")).where("split is not null").groupBy("split").agg(F.count(F.lit(1)).alias("n"))

    @q("src_04_yolo_labels", sql("SELECT stem, cls, round((x1+x2)/2/1300,6) AS cx, round((y1+y2)/2/900,6) AS cy FROM det"))
    def src_04(s, d):
        p = path(s, "labels")
        b = det(s, d)
        num = lambda c: F.printf(F.lit("%.9f"), c)
        line = F.concat_ws(" ", F.col("cls").cast("string"), num((F.col("x1") + F.col("x2")) / 2 / 1300), num((F.col("y1") + F.col("y2")) / 2 / 900), num((F.col("x2") - F.col("x1")) / 1300), num((F.col("y2") - F.col("y1")) / 900))
        b.select(F.concat_ws("\t", F.col("stem").cast("string"), line).alias("value")).write.text(p)
        raw = s.read.text(p).select(F.split("value", "\t")[0].cast("bigint").alias("stem"), F.lit(0).alias("line_no"), F.split("value", "\t")[1].alias("line"))
        return files.yolo_lines(raw).select("stem", "cls", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))

    @q("src_05_npz_dump", sql("SELECT stem, x1, y1, x2, y2, score, cls FROM det"))
    def src_05(s, d):
        b = det(s, d).withColumn("shard", F.pmod(F.xxhash64("stem"), F.lit(64)).cast("int")).withColumn("row_index", F.col("det_id"))
        out = files.decode_npz(sinks.encode_npz(b, "shard"))
        return out.select(F.col("stem").cast("bigint").alias("stem"), "x1", "y1", "x2", "y2", "score", "cls")

    @q("src_06_key_parsing", r"""SELECT row_id, CASE WHEN regexp_matches(t, '^(.*)_([0-9]+)$') THEN regexp_extract(t, '^(.*)_([0-9]+)$', 1) ELSE t END AS tree, CASE WHEN regexp_matches(t, '^(.*)_([0-9]+)$') THEN CAST(regexp_extract(t, '^(.*)_([0-9]+)$', 2) AS INTEGER) END AS side
      FROM (SELECT row_id, regexp_replace(tree_id, '^[\s\x{FEFF}\x{00A0}\x{200B}]+|[\s\x{FEFF}\x{00A0}\x{200B}]+$', '', 'g') AS t FROM split_manifest)""")
    def src_06(s, d):
        """Keys of all rows, without marks and blanks (tabs too) around the name; a null name has neither tree nor side."""
        tree, side = files.tree_and_side(tidy(F.col("tree_id")))
        return read(s, d, "split_manifest").select("row_id", tree.alias("tree"), side.alias("side"))

    @q("src_07_raw_depth", sql("SELECT path, max(mm) AS most, count(*) AS n FROM (SELECT CAST(tree % 16 AS VARCHAR) AS path, CAST(y1 AS INT) % 48 AS v, CAST(x1 AS INT) % 64 AS u, max(CAST(floor(score*5000) AS INTEGER)+1) AS mm FROM det GROUP BY ALL) GROUP BY 1"))
    def src_07(s, d):
        px = det(s, d).groupBy((F.col("tree") % 16).cast("string").alias("path"), (F.col("y1").cast("int") % 48).alias("v"), (F.col("x1").cast("int") % 64).alias("u")).agg(F.max(F.floor(F.col("score") * 5000).cast("int") + 1).alias("mm"))
        return files.decode_depth(sinks.encode_depth(px, 64, 48), 64, 48).groupBy("path").agg(F.max("mm").alias("most"), F.count(F.lit(1)).alias("n"))

    @q("src_09_struct_text", sql("SELECT stem, det_id, round(score,4) AS fx, CAST(cls AS DOUBLE) AS fy FROM det"))
    def src_09(s, d):
        text = F.concat(F.lit("CameraParam{id=7, focal=["), F.printf(F.lit("%.9f"), F.col("score")), F.lit(", "), F.col("cls").cast("string"), F.lit("], size=(3)}"))
        n = files.struct_numbers(text, "focal")
        return det(s, d).select("stem", "det_id", F.round(F.get(n, F.lit(0)), 4).alias("fx"), F.get(n, F.lit(1)).alias("fy"))

    @q("src_10_stored_result", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
    def src_10(s, d):
        make = lambda: read(s, d, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))
        key = files.signature(files.file_states(s, f"{d}/lineitem.parquet"), "by flag")
        files.stored(s, "flags", key, make)
        return files.stored(s, "flags", key, make)

    @q("src_11_views_of_trees", sql("SELECT CAST(tree AS VARCHAR) AS tree, list_sort(list(DISTINCT CAST(tree AS VARCHAR) || '_' || CAST(side AS VARCHAR))) AS stems FROM det GROUP BY 1"))
    def src_11(s, d):
        return files.views_of_trees(det(s, d).select(F.concat_ws("_", F.col("tree").cast("string"), F.col("side").cast("string")).alias("stem")))

    @q("src_12_bank", "SELECT * FROM (VALUES ('a','v1','t1'),('b','v2','t2')) x(name, val, test)")
    def src_12(s, d):
        bank = files.parse_bank(["a=v1=t1", "b = v2 = t2"])
        return s.createDataFrame([(k, *v) for k, v in bank.items()], "name string, val string, test string")

    @q("snk_01_metric_json", sql("SELECT cls, count(*) AS n FROM det GROUP BY cls"))
    def snk_01(s, d):
        p = path(s, "metrics")
        sinks.metric_document(det(s, d).groupBy("cls").agg(F.count(F.lit(1)).alias("n")), p)
        return s.read.schema("cls int, n bigint").json(p)

    @q("snk_02_dump", sql("SELECT model, side, count(*) AS n FROM det GROUP BY ALL"))
    def snk_02(s, d):
        p = path(s, "dump")
        sinks.detection_dump(det(s, d).select("stem", "det_id", "score", "model", "side"), p, ("model", "side"))
        return s.read.schema("stem bigint, det_id bigint, score double, model int, side int").parquet(p).groupBy("model", "side").agg(F.count(F.lit(1)).alias("n"))

    @q("snk_03_summary_csv", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
    def snk_03(s, d):
        p = path(s, "summary")
        sinks.summary_csv(read(s, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), ["c_mktsegment", "n"], p)
        return s.read.csv(p, header=True, schema="c_mktsegment string, n bigint")

    @q("snk_04_markdown", sql("""SELECT 0 AS pos, '' AS key, '| cls | 0 | 1 | 2 |' AS line UNION ALL SELECT 1, '', '| - | - | - | - |' UNION ALL
      SELECT 2, CAST(cls AS VARCHAR), '| ' || CAST(cls AS VARCHAR) || ' | ' || string_agg(CASE WHEN v = m THEN '**' || printf('%.3f', v) || '**' ELSE printf('%.3f', v) END, ' | ' ORDER BY model) || ' |' FROM (SELECT cls, model, v, max(v) OVER (PARTITION BY cls) AS m FROM (SELECT cls, model, max(score) + CAST(model AS DOUBLE)/1000 AS v FROM det GROUP BY cls, model)) GROUP BY cls"""))
    def snk_04(s, d):
        v = det(s, d).groupBy("cls", "model").agg((F.max("score") + F.first("model") / 1000.0).alias("v"))
        out = sinks.markdown_matrix(v, "cls", "model", [0, 1, 2], "v")
        return out

    @q("snk_05_atomic_manifest", "SELECT DISTINCT row_id FROM split_manifest")
    def snk_05(s, d):
        p = path(s, "manifest")
        sinks.replace_table(read(s, d, "split_manifest").select("row_id").where("row_id is null"), p)
        sinks.replace_table(read(s, d, "split_manifest").select("row_id").distinct(), p)
        return sinks.current_table(s, p)

    @q("snk_06_dataset_manifest", sql("SELECT DISTINCT 'det_' || stem || '.jpg' AS source, 'train/' || stem || '.jpg' AS target FROM det WHERE stem % 5 <> 0"))
    def snk_06(s, d):
        stem = F.col("stem").cast("string")
        return det(s, d).where("stem % 5 <> 0").select("stem").distinct().select(F.concat(F.lit("det_"), stem, F.lit(".jpg")).alias("source"), F.concat(F.lit("train/"), stem, F.lit(".jpg")).alias("target"))

    @q("snk_07_tree_documents", sql("SELECT tree AS tree_id, side AS side_index, count(*) AS n FROM det GROUP BY ALL"))
    def snk_07(s, d):
        b = det(s, d).select(F.col("tree").alias("tree_id"), "side", F.col("det_id").alias("box_index"), "cls", "x1", "y1", "x2", "y2")
        docs = sinks.tree_documents(b).select(F.col("tree_id").alias("doc_no"), F.lit(0).cast("bigint").alias("raw_id"), "body")
        nodes = nested.json_nodes(docs, "doc_no", "raw_id", "body").where("path = 'images.annotations'")
        return nodes.groupBy(F.col("doc_no").alias("tree_id"), F.col("parent_members")["side_index"].cast("int").alias("side_index")).agg(F.count(F.lit(1)).alias("n"))

    # every seventh row comes back with another B1: it must be rolled back
    @q("snk_08_guarded_enrichment", "SELECT row_id, B1, CASE WHEN row_id % 7 <> 0 OR B1 IS NULL THEN 'manifest' END AS origin, row_id % 7 <> 0 OR B1 IS NULL AS unchanged FROM split_manifest")
    def snk_08(s, d):
        kept = ["tree_id", "B1", "B2", "B3", "B4"]
        m = read(s, d, "split_manifest").select("row_id", *kept)
        spoilt = m.withColumn("B1", F.col("B1") + (F.col("row_id") % 7 == 0).cast("int")).withColumn("origin", F.lit("manifest"))
        return sinks.enrich(m, spoilt, ["row_id"], kept, ["origin"]).select("row_id", "B1", "origin", F.col("_unchanged").alias("unchanged"))
