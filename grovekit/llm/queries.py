"""Queries of the training-data operators and, where SQL can state them, their SQL."""

from __future__ import annotations

from grovekit.llm import components, mixing, overlap, packing, sentences, splits
from grovekit.plans.registry import Registry

P1_SQL = r"""
WITH RECURSIVE known AS (
  SELECT DISTINCT box_id, lower(trim(tree_id)) AS tree, side_index, box_index, bunch_id FROM gt_boxes),
led AS (SELECT box_id, min(box_id) OVER (PARTITION BY tree, bunch_id) AS b FROM known
  WHERE bunch_id IS NOT NULL AND trim(bunch_id) <> '' AND NOT starts_with(trim(bunch_id), '-')),
pairs AS (
  SELECT x.box_id AS a, y.box_id AS b FROM edges e
  JOIN known x ON lower(trim(e.tree_id)) = x.tree AND e.side_i = x.side_index AND e.i = x.box_index
  JOIN known y ON lower(trim(e.tree_id)) = y.tree AND e.side_j = y.side_index AND e.j = y.box_index
  UNION SELECT box_id, b FROM led),
both_ways AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) WHERE a <> b),
reach AS (
  SELECT DISTINCT a AS v, a AS w FROM both_ways
  UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.w = e.a)
SELECT v AS box_id, min(w) AS group_id FROM reach GROUP BY v
"""

P5_SQL = r"""
WITH RECURSIVE plain AS (
  SELECT row_id, trim(regexp_replace(replace(lower(tree_id), chr(65279), ''), '[^\p{L}\p{N}]+', '_', 'g'), '_') AS t,
    trim(session_id) AS s FROM split_manifest),
keyed AS (
  SELECT row_id, CASE WHEN regexp_matches(t, '^[a-z]+_[a-z]+[0-9]+[a-z]*_0*[0-9]+(?:_.*|[a-z].*)?$')
      THEN regexp_replace(t, '^([a-z]+)_([a-z]+[0-9]+[a-z]*)_0*([0-9]+)(?:_.*|[a-z].*)?$', '\1|\2|\3') WHEN t <> '' THEN t END AS tree,
    CASE WHEN lower(s) NOT IN ('', '-', '--', '?', 'n/a', 'na', 'nan', 'none', 'null', 'unknown', 'tidak diketahui', 'tidak ada') THEN s END AS session
  FROM plain),
pairs AS (
  SELECT x.row_id AS a, y.row_id AS b FROM keyed x JOIN keyed y ON x.tree = y.tree AND x.row_id <> y.row_id
  UNION SELECT x.row_id, y.row_id FROM keyed x JOIN keyed y ON x.session = y.session AND x.row_id <> y.row_id),
reach AS (
  SELECT DISTINCT a AS v, a AS w FROM pairs
  UNION SELECT r.v, e.b FROM reach r JOIN pairs e ON r.w = e.a)
SELECT v AS row_id, min(w) AS group_id FROM reach GROUP BY v
"""


def build() -> Registry:
    reg = Registry()
    reg.add("p1_found", components.p1_found, P1_SQL)
    reg.add("p2_found", overlap.p2_found)
    reg.add("p2_report", overlap.p2_report)
    reg.add("p5_found", splits.p5_found, P5_SQL)
    reg.add("p5_forest", splits.p5_forest)
    reg.add("p5_assigned", splits.p5_assigned)
    reg.add("p5_shares", splits.p5_shares)
    reg.add("p6_packed", packing.p6_packed)
    reg.add("p6_fill", packing.p6_fill)
    reg.add("p7_mixed", mixing.p7_mixed)
    reg.add("p7_shares", mixing.p7_shares)
    reg.add("p7_held_out", mixing.p7_held_out)
    reg.add("p8_found", sentences.p8_found)
    return reg
