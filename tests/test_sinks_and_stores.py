import pytest
from pyspark.sql import functions as F

from grovekit.operators import checks
from grovekit.operators.neighbours import knn, votes
from grovekit.scale import Workspace, parts_for, score_cuts, shared_dir
from grovekit.sources import files, sinks
from grovekit.streaming import events


def test_a_table_is_replaced_in_one_step(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    with pytest.raises(FileNotFoundError):
        sinks.current_table(spark, path)
    sinks.replace_table(spark.range(3), path)
    reader = sinks.current_table(spark, path)
    sinks.replace_table(spark.range(5), path)
    assert reader.count() == 3 and sinks.current_table(spark, path).count() == 5  # the old rows are still there for their readers
    for n in (6, 7):
        sinks.replace_table(spark.range(n), path)
    assert sinks.current_table(spark, path).count() == 7
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("rows-")]) == 2
    with pytest.raises(Exception, match="no way"):
        sinks.replace_table(spark.range(9).withColumn("x", F.raise_error(F.lit("no way")).cast("int")), path)
    assert sinks.current_table(spark, path).count() == 7


def test_enrichment_is_rolled_back_where_the_payload_changed(spark):
    old = spark.createDataFrame([(1, 5, "a"), (2, None, "b"), (3, 7, "c"), (4, 1, "d")], "k int, n int, s string")
    new = spark.createDataFrame([(1, 5, "a", "x"), (2, None, "b", "y"), (3, 8, "c", "z"), (9, 1, "q", "w")], "k int, n int, s string, m string")
    got = {r.k: (r.n, r.s, r.m, r["_unchanged"]) for r in sinks.enrich(old, new, ["k"], ["n", "s"], ["m"]).collect()}
    assert got == {1: (5, "a", "x", True), 2: (None, "b", "y", True), 3: (7, "c", None, False), 4: (1, "d", None, False)}


def test_a_changed_file_is_read_anew(spark, tmp_path):
    folder, made = tmp_path / "in", []

    def run():
        key = files.signature(files.file_states(spark, str(folder)), "sum")

        def make():
            made.append(1)
            return spark.read.parquet(str(folder)).agg(F.sum("id").alias("s"))
        return files.stored(spark, "sums", key, make).first().s

    spark.range(4).write.parquet(str(folder))
    assert run() == run() == 6 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(str(folder))
    assert run() == 10 and len(made) == 2
    with pytest.raises(ZeroDivisionError):
        files.stored(spark, "sums", "other", lambda: 1 / 0)


def test_a_scan_cut_short_goes_on(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"line {i}\n")
    seen = []

    def scan(paths):
        seen.append(len(paths))
        if len(seen) == 2:
            raise OSError("cut short")
        return spark.read.text(paths)

    with pytest.raises(OSError):
        files.scan_in_chunks(spark, "lines", str(tmp_path), 2, scan)
    assert files.scan_in_chunks(spark, "lines", str(tmp_path), 2, scan).count() == 5
    assert seen == [2, 2, 2, 1]  # the first chunk is not scanned again


def test_update_mode_keeps_keys_of_earlier_batches(spark, tmp_path):
    for i, rows in enumerate([[("a", 1.0), ("b", 2.0)], [("a", 3.0)], [("c", 4.0)]]):
        spark.createDataFrame(rows, "user_id string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert i < 3
    s = spark.readStream.schema("user_id string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    g = s.groupBy("user_id").agg(F.sum("value").alias("total"))
    out = events.run_to_table(g, Workspace(spark, "t"), "totals", "update", ["user_id"])
    assert {r.user_id: r.total for r in out.collect()} == {"a": 4.0, "b": 2.0, "c": 4.0}
    with pytest.raises(ValueError):
        events.run_to_table(g, Workspace(spark, "t"), "none", "update")


def test_an_anchor_off_by_one_fails(spark):
    df = spark.range(5).agg(F.count(F.lit(1)).alias("n"))
    assert checks.anchored(df, "n", 5.0, 0.5).count() == 1
    with pytest.raises(Exception, match="n isn't 6"):
        checks.anchored(df, "n", 6.0, 0.5).collect()


def test_votes_and_blocks(spark):
    rows = [(i, [1.0, i / 10], i % 2) for i in range(30)] + [(99, None, 0)]
    e = spark.createDataFrame(rows, "i bigint, v array<double>, l int")
    near = knn(e.where("i % 10 = 0"), e, "i", "v", 3, keep=["l"])
    got = {r.i: [x.other for x in sorted(near.where(f"i = {r.i}").collect(), key=lambda x: x["rank"])] for r in near.select("i").distinct().collect()}
    assert got[0] == [1, 2, 3] and set(got) == {0, 10, 20}
    assert {(r.i, r.k): r.uniform for r in votes(near, "i", "l", [1, 3]).collect()}[0, 3] == 1


def test_cuts_and_folders(spark):
    df = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    assert score_cuts(df, "x", 1) == [] and len(score_cuts(df, "x", 4)) == 3 and parts_for(0) == 1
    assert score_cuts(df.where("x is null"), "x", 4) == []
    assert shared_dir(spark).startswith("file:")
