"""Queries over nested documents and drifting files (problems 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grovekit.operators import drift, nested
from grovekit.plans.registry import Registry
from grovekit.scale import Workspace, read, with_source_row

P3_SQL = r"""
WITH raw AS (
  SELECT doc_no, CASE WHEN json_valid(ltrim(body, chr(65279))) THEN ltrim(body, chr(65279))::JSON END AS j FROM tree_raw),
root AS (SELECT doc_no, coalesce(json_extract(j, '$.data'), j) AS j FROM raw WHERE j IS NOT NULL),
raw_images AS (
  SELECT r.doc_no, coalesce(e.value->>'side', e.key) AS side, CAST(e.value->>'side_index' AS INTEGER) AS side_index, e.value AS v
  FROM root r, json_each(r.j, '$.images') e),
raw_ann AS (
  SELECT i.doc_no, i.side_index, CAST(a.value->>'box_index' AS INTEGER) AS box_index
  FROM raw_images i, json_each(i.v, '$.annotations') a),
raw_bunch AS (SELECT r.doc_no, e.value->>'bunch_id' AS bunch_id, e.value->'appearances' AS apps FROM root r, json_each(r.j, '$.bunches') e),
raw_app AS (
  SELECT doc_no, bunch_id, a.value AS v FROM raw_bunch b, json_each(b.apps) a WHERE json_type(b.apps) = 'ARRAY'
  UNION ALL SELECT doc_no, bunch_id, apps FROM raw_bunch WHERE json_type(apps) = 'OBJECT'),
doc_images AS (SELECT doc_no, e.key AS side, e.value.side_index AS side_index, e.value.annotations AS anns
  FROM (SELECT doc_no, unnest(map_entries(images)) AS e FROM tree_doc)),
doc_ann AS (SELECT doc_no, side_index, a.box_index AS box_index FROM (SELECT doc_no, side_index, unnest(anns) AS a FROM doc_images)),
doc_bunch AS (SELECT doc_no, b.bunch_id AS bunch_id, b.appearances AS apps FROM (SELECT doc_no, unnest(bunches) AS b FROM tree_doc)),
doc_app AS (SELECT doc_no, bunch_id, a.side AS side, a.side_index AS side_index, a.box_index AS box_index
  FROM (SELECT doc_no, bunch_id, unnest(apps) AS a FROM doc_bunch)),
apps AS (SELECT * FROM doc_app UNION ALL
  SELECT doc_no, bunch_id, v->>'side', CAST(v->>'side_index' AS INTEGER), CAST(v->>'box_index' AS INTEGER) FROM raw_app),
images AS (SELECT doc_no, side, side_index FROM doc_images UNION SELECT doc_no, side, side_index FROM raw_images),
anns AS (SELECT doc_no, side_index, box_index FROM doc_ann UNION SELECT * FROM raw_ann),
named AS (SELECT a.doc_no, a.bunch_id, coalesce(a.side_index, i.side_index) AS side_index, a.box_index
  FROM apps a LEFT JOIN images i ON a.side_index IS NULL AND i.doc_no = a.doc_no AND i.side = a.side)
SELECT DISTINCT n.doc_no, n.bunch_id, n.side_index, n.box_index
FROM named n JOIN anns x ON x.doc_no = n.doc_no AND x.side_index = n.side_index AND x.box_index = n.box_index
"""


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return nested.tree_tables(with_source_row(read(spark, sf_dir, "tree_doc")), read(spark, sf_dir, "tree_raw"), Workspace(spark, "p3"))


def _history(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    ws, lines = Workspace(spark, "p4"), read(spark, sf_dir, "history_raw")
    heads = ws.save(drift.headers(lines), "heads")
    cells = ws.save(drift.long_cells(drift.data_rows(lines, heads)), "cells")
    types, pairs = ws.save(drift.column_types(cells), "types"), ws.save(drift.file_pairs(heads), "pairs")
    shared = ws.save(drift.shared_values(drift.open_columns(pairs), cells), "shared")
    renamed = ws.save(drift.renames(drift.correspondences(pairs, types, shared), shared), "renamed")
    return {"heads": heads, "cells": cells, "types": types, "pairs": pairs, "renamed": renamed}


def history_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return drift.schema_changes(h["pairs"], h["types"], h["renamed"])


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    typed = [read(spark, sf_dir, t) for t in ("rtdetr_l_rgbd4_training_metrics", "sel4_352_rgbedgemono__results")]
    targets = [c for t in typed for c in t.columns]
    return drift.epoch_table(h["cells"], h["heads"], drift.canonical_names(h["renamed"], h["heads"], targets), typed)


def register(reg: Registry) -> None:
    reg.add("p3_found", lambda s, d: nested.linked_appearances(_tables(s, d)), P3_SQL)
    for name in ("trees", "images", "annotations", "bunches", "appearances"):
        reg.add(f"p3_{name}", lambda s, d, n=name: _tables(s, d)[n])
    reg.add("p4_found", history_changes)
    reg.add("p4_epochs", history_table)
