import random

import numpy as np
from pyspark.sql import functions as F

from grovekit.llm import overlap
from grovekit.llm.overlap import SHARD_PHRASES, Boxes, Names, cross_split_pairs, merged_length, overlap_classes, overlap_report, pair_count, scan_texts
from grovekit.scale import Workspace

DOC = """doc_no bigint, tree_id string, ingested_at timestamp, token string, images map<string, struct<side_index:int, filename:string, width:int, height:int,
 annotations:array<struct<box_index:int, class_id:int, class_name:string, bbox_yolo:array<double>, bbox_pixel:array<double>, conf:double>>>>"""
ROW = "row_id bigint, doc_no bigint, new_split string, tree_id string, s string, id int, n int"


def document(no, boxes, pixel=False):
    ann = []
    for i, (cx, cy, w, h) in enumerate(boxes):
        px = [(cx - w / 2) * 1000, (cy - h / 2) * 1000, (cx + w / 2) * 1000, (cy + h / 2) * 1000]
        ann.append((i, 0, "B1", None if pixel else [cx, cy, w, h], px if pixel else None, None))
    half = len(ann) // 2
    return (no, "x", None, "x", {"side_1": (0, "f", 1000, 1000, ann[:half]), "side_2": (1, "f", 1000, 1000, ann[half:])})


def pairs(spark, rows, docs):
    out = cross_split_pairs(spark.createDataFrame(rows, ROW).withColumn("source", F.lit("x")), spark.createDataFrame(docs, DOC), Workspace(spark, "t"))
    return {(r.eval_row, r.train_row, r.reason) for r in out.collect()}


def test_near_same_boxes(spark):
    rnd = random.Random(4)
    base = [(rnd.uniform(0.1, 0.9), rnd.uniform(0.1, 0.9), rnd.uniform(0.05, 0.2), rnd.uniform(0.05, 0.2)) for _ in range(10)]
    near = [tuple(v + rnd.uniform(-0.0099, 0.0099) for v in b) for b in base]
    rnd.shuffle(near)
    far = [(b[0] + 0.0101, *b[1:]) for b in base]
    eight, seven = near[:8] + [(0.5, 0.5, 0.9, 0.9)] * 2, near[:7] + [(0.5, 0.5, 0.9, 0.9)] * 3
    few = near[:5]
    docs = [document(1, base), document(2, near, pixel=True), document(3, far), document(4, eight), document(5, seven), document(6, few), (7, None, None, None, None), document(8, base[:8]), document(9, base[:7])]
    rows = [(i, i, "uji" if i == 1 else "latih", f"T_{chr(64 + i)}1A_{i}", None, 0, 0) for i in range(1, 10)] + [(20, None, "val", None, None, 0, 0), (21, 1, "field", None, None, 0, 0), (22, 1, None, None, None, 0, 0), (None, 1, "train", None, None, 0, 0)]
    assert pairs(spark, rows, docs) == {(1, 2, "boxes"), (1, 4, "boxes"), (1, 8, "boxes")}


def test_same_tree_spellings(spark):
    rows = [(1, None, "TEST ", "﻿MERANTU_A01A_0007", None, 0, 0), (2, None, " train", "Merantu a01a 7", None, 0, 0), (3, None, "Latih", "MERANTU-A01A-007 (2)", None, 0, 0), (4, None, "train", "MERANTU_A01A_0007_ulang3", None, 0, 0),
            (5, None, "train", "MERANTU_A01B_0007", None, 0, 0), (6, None, "train", "MERANTU_A01A_0070", None, 0, 0), (7, None, "valid", "merantu_a01a_7-V2", None, 0, 0), (8, None, "train", "  ", None, 0, 0), (9, None, "val", "", None, 0, 0)]
    assert pairs(spark, rows, []) == {(e, t, "tree") for e in (1, 7) for t in (2, 3, 4)}


def test_copies_and_repeats(spark):
    rnd = random.Random(9)
    base = [(rnd.random(), rnd.random(), 0.1, 0.1) for _ in range(8)]
    docs = [document(i, base) for i in range(1, 6)] + [document(1, base)]
    rows = [(i, i, "train" if i < 4 else "test", f"A_B1C_{i}", None, 0, 0) for i in range(1, 6)]
    assert pairs(spark, rows, docs) == {(e, t, "boxes") for e in (4, 5) for t in (1, 2, 3)}


def test_empty(spark):
    assert pairs(spark, [], []) == set()


def test_pair_count_is_a_largest_matching():
    a = np.array([[0.5, 0.5, 0.1, 0.1], [0.505, 0.5, 0.1, 0.1], [0.51, 0.5, 0.1, 0.1]])
    b = np.array([[0.5, 0.5, 0.1, 0.1], [0.515, 0.5, 0.1, 0.1], [0.496, 0.5, 0.1, 0.1]])
    assert pair_count(a, b) == 3
    assert pair_count(a, b[:0].reshape(0, 4)) == 0
    assert pair_count(a, b + [0, 0, 0.02, 0]) == 0


def test_scan_finds_all_phrases(spark):
    p = spark.createDataFrame([(1, "a b 1"), (2, "b"), (4, "nix")], "id bigint, key string")
    t = spark.createDataFrame([(10, "a b 1"), (11, "b"), (12, "c a b 1"), (13, "a"), (14, "b 1")], "id bigint, key string")
    for shard in (1, 1000):
        assert {(r.pid, r.tid) for r in scan_texts(p, t, Names(), shard * SHARD_PHRASES // 300, 5).collect()} == {(1, 10), (2, 11)}


def test_shards_and_salts_lose_nothing(spark, monkeypatch):
    rnd = random.Random(3)
    docs = [(i, [round(rnd.uniform(0.1, 0.9), 2) for _ in range(4 * 8)]) for i in range(40)]
    near = [(100 + i, [v + rnd.uniform(-0.009, 0.009) for v in b]) for i, b in docs]
    t = spark.createDataFrame(near, "id bigint, boxes array<double>")
    p = spark.createDataFrame([(i, b, list(range(8))) for i, b in docs], "id bigint, boxes array<double>, ords array<int>")
    want = {(i, 100 + i, 8) for i, _ in docs}
    for phrases, expanded in ((1, 2_000_000), (SHARD_PHRASES * 7, 3)):
        monkeypatch.setattr(overlap, "EXPANDED", expanded)
        got = {(r.pid, r.tid, r.covered) for r in scan_texts(p, t, Boxes(0.01), phrases, 10, 4).collect()}
        assert got == want


def test_merged_length():
    key, start, stop = np.array([2, 1, 2, 2, 1]), np.array([0, 5, 2, 8, 5]), np.array([3, 9, 6, 9, 6])
    keys, length = merged_length(key, start, stop)
    assert list(keys) == [1, 2] and list(length) == [4, 7]


def test_report_counts_the_pairs_of_classes(spark):
    rnd = random.Random(8)
    base = [[(rnd.random(), rnd.random(), 0.1, 0.1) for _ in range(8)] for _ in range(3)]
    docs = [document(i, base[i % 3]) for i in range(1, 31)]
    rows = [(i, i if i % 4 else None, rnd.choice(["train", "latih", "val", "uji", None]), f"A_B1C_{rnd.randrange(6)}", rnd.choice(["x", "y", None]), 0, 0) for i in range(1, 31)]
    schema = ROW.replace("s string", "source string")
    args = spark.createDataFrame(rows, schema), spark.createDataFrame(docs, DOC), Workspace(spark, "t")
    found = cross_split_pairs(*args).collect()
    both = {(r.eval_row, r.train_row) for r in found}
    tree, box = ({r.eval_row for r in found if r.reason == k} for k in ("tree", "boxes"))
    split = {"val": "val", "uji": "test"}
    got = {(r.new_split, r.source): tuple(r)[2:] for r in overlap_report(*overlap_classes(*args[:2], Workspace(spark, "t"))).collect()}
    want = {}
    for r in rows:
        if r[2] in split:
            n, hit, t, b, k = want.get((split[r[2]], r[4]), (0, 0, 0, 0, 0))
            mine = {x for e, x in both if e == r[0]}
            want[split[r[2]], r[4]] = (n + 1, hit + bool(mine), t + (r[0] in tree), b + (r[0] in box), k + len(mine))
    assert got == want
