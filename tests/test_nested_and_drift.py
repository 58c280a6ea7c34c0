import datetime as dt
import json

from pyspark.sql import functions as F

from grovekit.operators import drift, nested
from grovekit.plans.documents import history_changes, history_table
from grovekit.scale import Workspace

DOC = """doc_no bigint, tree_id string, tree_name string, split string, detector string, node string,
 images map<string, struct<side_index:int, filename:string, width:int, height:int, annotations:array<struct<box_index:int, class_id:int, class_name:string, bbox_yolo:array<double>, bbox_pixel:array<double>, conf:double>>>>,
 bunches array<struct<bunch_id:string, class:string, class_mismatch:boolean, appearance_count:int, appearances:array<struct<side:string, side_index:int, box_index:int, bbox_pixel:array<double>>>>>"""


def found(spark, docs, bodies):
    d = spark.createDataFrame(docs, DOC)
    r = spark.createDataFrame([(i, n, b, "x") for i, (n, b) in enumerate(bodies)], "raw_id bigint, doc_no bigint, body string, path string")
    t = nested.tree_tables(d.withColumn("source_row", F.monotonically_increasing_id()), r, Workspace(spark, "t"))
    return {tuple(x) for x in nested.linked_appearances(t).collect()}, t


def ann(i):
    return (i, None, None, None, None, None)


def test_typed_documents(spark):
    im = {"a": (0, None, None, None, [ann(0), None, ann(2)]), "b": (1, None, None, None, None), "c": None}
    bunches = [("k1", None, None, None, [("a", 0, 0, None), ("a", 0, 0, None), ("a", None, 2, None), ("zz", None, 0, None), ("a", 0, 9, None), None]), ("k2", None, None, None, None), None, ("k3", None, None, None, [])]
    got, t = found(spark, [(1, "t", None, None, None, "n", im, bunches), (1, "t", None, None, None, "n", im, bunches), (2, None, None, None, None, None, None, None), (None, None, None, None, None, None, im, bunches)], [])
    assert got == {(1, "k1", 0, 0), (1, "k1", 0, 2)}
    rows = t["annotations"].where("doc_no = 1").distinct().collect()
    assert {(r.node, r.parent) for r in rows} == {("6.0.4.0", "6.0"), ("6.0.4.2", "6.0")}
    parents = {r.node for r in t["images"].where("doc_no = 1").collect()}
    assert {r.parent for r in rows} <= parents


def test_raw_documents(spark):
    doc = {"images": {"a": {"side_index": 0, "annotations": [{"box_index": "0"}, {"box_index": 1, "bbox_yolo": "0.1 0.2 0.3 0.4"}]}}, "bunches": [{"bunch_id": 7, "appearances": {"side": "a", "box_index": 0}}, {"bunch_id": "x", "appearances": [{"side_index": "0", "box_index": 1}]}]}
    listed = {"data": {"images": [{"side": "a", "side_index": 0, "annotations": [{"box_index": 3}]}], "bunches": [{"bunch_id": None, "appearances": [{"side": "a", "box_index": 3}]}]}}
    bodies = [(1, json.dumps(doc)), (2, "﻿" + json.dumps(listed)), (3, json.dumps(doc)[:-4]), (4, None), (5, ""), (6, "[1]"), (7, json.dumps(doc) + "x"), (8, '"text"'), (9, "{}"), (1, json.dumps(doc))]
    got, t = found(spark, [], bodies)
    assert got == {(1, "7", 0, 0), (1, "x", 0, 1), (2, None, 0, 3)}
    yolo = [r.bbox_yolo for r in t["annotations"].where("doc_no = 1 and box_index = 1").collect()]
    assert yolo == [[0.1, 0.2, 0.3, 0.4]] * 2


def test_truncation_gives_parents():
    stack = list(nested.shred({"images": {"a": {"annotations": [{"x": 1}, {"x": 2}]}}, "meta": {"d": 1}}, frozenset(nested.COLLECTIONS)))
    by = {n: (path, parent) for path, n, parent, *_ in stack}
    assert by["0.0.0.1"] == ("images.annotations", "0.0") and by["0.0"] == ("images", "") and by["1"] == ("meta", "")


def test_no_depth_or_size_is_too_much(spark):
    deep = {"images": {"a": {"side_index": 0, "annotations": [{"box_index": "1000000000"}]}}, "bunches": [{"bunch_id": "x", "appearances": [{"side": "a", "box_index": 1000000000}]}]}
    wrapped = json.dumps(deep)
    for _ in range(30):
        wrapped = '{"data": ' + wrapped + "}"
    nest = '{"odd": ' + "[" * 200_000 + "]" * 200_000 + ", " + json.dumps(deep)[1:]
    got, t = found(spark, [], [(1, wrapped), (2, nest), (3, "[" + json.dumps(deep) + ", 5, " + json.dumps(deep) + "]"), (4, nest[:-1]), (5, "[" * 200_000)])
    assert got == {(i, "x", 0, 1000000000) for i in (1, 2, 3)}
    assert sorted(r.node for r in t["trees"].where("doc_no = 3").collect()) == ["0", "2"]


def test_keys_are_unique_where_documents_are_filed_twice(spark):
    im = {"a": (0, None, None, None, [ann(0), ann(1)])}
    bunches = [("k", None, None, None, [("a", 0, 0, None), ("a", 0, 1, None)])]
    doc = {"images": {"a": {"side_index": 0, "annotations": [{"box_index": 0}]}}, "bunches": [{"bunch_id": 7, "appearances": {"side": "a", "box_index": 0}}]}
    _, t = found(spark, [(1, "t", None, None, None, "n", im, bunches)] * 2, [(1, json.dumps(doc)), (1, json.dumps(doc)), (1, json.dumps([doc, doc]))])
    keys = {}
    for name, df in t.items():
        rows = [(r.source_row, r.node) for r in df.collect()]
        keys[name] = set(rows)
        assert len(rows) == len(keys[name])
    for child, parent in (("images", "trees"), ("annotations", "images"), ("bunches", "trees"), ("appearances", "bunches")):
        assert {(r.source_row, r.parent) for r in t[child].collect()} <= keys[parent]


def test_deep_parser_agrees_with_the_plain_one():
    good = ['{"a": [1, -2.5e3, "x\\n\\u00e9", {}, [], null, true, {"b": {"c": "]"}}], "a": 2}', "[]", "{}", ' 5 ', '"t"', "[[[1]]]"]
    bad = ["", "{", "[1,]", "{,}", '{"a"}', '{"a": }', "[1 2]", "[1]]", '{"a": 1,}', "tru", "[1}", '{"a": 1]', ":", ",", '"', "01", '{1: 2}', "[,1]"]
    for text in good:
        assert nested._parse_deep(text) == json.loads(text)
    assert [nested._parse_deep(t) for t in bad] == [None] * len(bad)
    assert nested._written(json.loads(good[0])) == json.dumps(json.loads(good[0]), ensure_ascii=False)


def lines(files):
    out, k = [], 0
    for fid, run, day, text in files:
        for no, line in enumerate(text, 1):
            k += 1
            out.append((k, fid, run, f"f{fid}.csv", dt.datetime(2031, 1, day), dt.datetime(2031, 1, day), no, line, "x"))
    return out


LINES = "line_id bigint, file_id bigint, run_name string, file_name string, written_at timestamp, loaded_at timestamp, line_no int, line string, col string"


def changes(spark, tmp_path, files):
    spark.createDataFrame(lines(files), LINES).write.mode("overwrite").parquet(str(tmp_path / "history_raw.parquet"))
    for t in ("rtdetr_l_rgbd4_training_metrics", "sel4_352_rgbedgemono__results"):
        spark.createDataFrame([("r", "1/60", "0,5")], "run_name string, epoch string, `train/box_loss` string").write.mode("overwrite").parquet(str(tmp_path / f"{t}.parquet"))
    return {tuple(r) for r in history_changes(spark, str(tmp_path)).select("file_id", "change", "old_name", "new_name").collect()}


def test_changes(spark, tmp_path):
    files = [
        (1, "r", 1, ["﻿epoch, train/box_loss ,note,same,gone", "1,0.5,a,1,7", "2,0.25,b,1,5", "", "# c", "3,0.125,,1,nan"]),
        (2, "r", 2, ['"epoch";"box";"same";"const";"fresh"', '"2";"0,25";"1.5";"7";"9"', 'epoch;box;same;const;fresh', '"3/60";"0,125";"2";"8";"9"', None]),
        (3, "r", 3, ["epoch,box,same,const,fresh", "3,12%,1.5,7,nan", "4,1,1.5,7,"]),
        (9, "other", 1, ["epoch,a", "1,2"]),
    ]
    assert changes(spark, tmp_path, files) == {
        (2, "renamed", "train/box_loss", "box"), (2, "removed", "note", ""), (2, "removed", "gone", ""), (2, "added", "", "const"), (2, "added", "", "fresh"),
        (2, "retyped", "same", "same"), (2, "retyped", "epoch", "epoch"), (3, "retyped", "epoch", "epoch")}
    table = {(r.run_name, r.epoch, r.origin): r for r in history_table(spark, str(tmp_path)).collect()}
    assert table["r", 3, "file"]["train/box_loss"] == 0.12 and table["r", 1, "file"]["train/box_loss"] == 0.5 and table["r", 1, "export_1"]["train/box_loss"] == 0.5


def test_same_values_go_to_the_likelier_name(spark, tmp_path):
    files = [(1, "r", 1, ["epoch,train/cls_loss,val/cls_loss", "1,0.5,0.5", "2,0.6,0.6"]), (2, "r", 2, ["epoch,val_cls_loss,train_cls_loss", "1,0.5,0.5", "2,0.6,0.6"])]
    assert changes(spark, tmp_path, files) == {(2, "renamed", "train/cls_loss", "train_cls_loss"), (2, "renamed", "val/cls_loss", "val_cls_loss")}


def test_empty_history(spark, tmp_path):
    assert changes(spark, tmp_path, []) == set()


def test_flooding_prefers_the_same_group():
    s = drift.flood([("epoch", "integer"), ("train/box_loss", "number"), ("val/box_loss", "number")], [("epoch", "integer"), ("train_reg_loss", "number"), ("val_reg_loss", "number")])
    assert s["train/box_loss", "train_reg_loss"] > s["train/box_loss", "val_reg_loss"]
    assert s["val/box_loss", "val_reg_loss"] > s["val/box_loss", "train_reg_loss"]


def test_scores_select_and_values_only_confirm(spark, tmp_path):
    files = [(1, "r", 1, ["epoch,train/box_loss,val/box_loss,metrics/recall(B)", "1,0.5,0.7,0.1", "2,0.4,0.6,0.2"]),
             (2, "r", 2, ["epoch,train.box,val.box,R,lr", "2,0.4,0.6,0.2,9", "3,0.3,0.5,0.3,8"])]
    spark.createDataFrame(lines(files), LINES).write.mode("overwrite").parquet(str(tmp_path / "history_raw.parquet"))
    heads = drift.headers(spark.read.parquet(str(tmp_path / "history_raw.parquet")))
    cells = drift.long_cells(drift.data_rows(spark.read.parquet(str(tmp_path / "history_raw.parquet")), heads))
    pairs, types = drift.file_pairs(heads), drift.column_types(cells)
    shared = drift.shared_values(drift.open_columns(pairs), cells)
    named = lambda score: {(r.old_name, r.new_name) for r in drift.renames(drift.correspondences(pairs, types, shared, score), shared).collect()}
    want = {("train/box_loss", "train.box"), ("val/box_loss", "val.box"), ("metrics/recall(B)", "R")}
    assert named(drift.flood) == want
    # constant scores, or scores turned round, select other correspondences and lose the renames
    flat = named(lambda old, new, po, pn: {(o, n): 1.0 for o, _ in old for n, _ in new})
    back = named(lambda old, new, po, pn: {k: 1 - v for k, v in drift.flood(old, new, po, pn).items()})
    assert flat < want and back < want and named(lambda old, new, po, pn: {(o, n): 0.0 for o, _ in old for n, _ in new}) == set()
