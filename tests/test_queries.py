"""Every query outside the training-data subpackage against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import numpy as np
import pytest

from grovekit.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
REG = catalog.build()


def plain(v):
    if isinstance(v, float | np.floating):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 5) + 0.0
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def unique(*keys):
    """Rows are told apart by the keys, which are not null."""
    return lambda rows, duck: len({tuple(r[k] for k in keys) for r in rows}) == len(rows) and all(r[k] is not None for r in rows for k in keys)


def shares(*names):
    return lambda rows, duck: all(0 <= r[n] <= 1 for r in rows for n in names)


def both(*rules):
    return lambda rows, duck: all(f(rows, duck) for f in rules)


def lines_of(duck, where="true"):
    return duck.execute(f"SELECT count(*) FROM lineitem WHERE {where}").fetchone()[0]


def fused(rows, duck):
    """Fewer boxes than detections, each a box with 1 to 3 supporters."""
    return len(rows) <= lines_of(duck) and all(r["x1"] < r["x2"] and r["y1"] < r["y2"] and 1 <= r["support"] <= 3 and 0 <= r["score"] <= 1 for r in rows)


def clusters(rows, duck):
    """Every node once; a cluster is named by one of its nodes, which is in it."""
    member = {(r["tree"], r["det_id"]): r["cluster"] for r in rows}
    return len(member) == len(rows) and all(member[t, c] == c for (t, _), c in member.items())


def per_cut(rows, duck):
    return all(clusters([r for r in rows if r["cut"] == c], duck) for c in {r["cut"] for r in rows})


SCORE = "(l_quantity + 500 * l_discount) / 101"
#: What holds for the queries that SQL can't state; unit tests compare their operators with brute force or known answers.
INVARIANTS = {
    "agg_15_ap_interp": both(unique("cls"), shares("ap")), "agg_16_map_grid": lambda rows, duck: len(rows) == 1 and 0 <= rows[0]["map50_95"] <= rows[0]["map50"] <= 1,
    "jon_07_optimal_match": both(unique("stem", "det_id"), unique("stem", "gt_id"), lambda rows, duck: all(r["iou"] >= 0.5 for r in rows)),
    "grp_01_nms_agnostic": unique("stem", "det_id"), "grp_02_wbf_running": fused, "grp_02_wbf_weighted": fused, "grp_03_wbf_anchor": fused, "grp_04_two_stage": fused,
    "grp_05_twins": lambda rows, duck: len(rows) <= lines_of(duck) and all(r["support"] >= 1 for r in rows),
    "grp_06_union_find": clusters, "grp_06_stop_at_count": clusters, "grp_07_assignment_grid": per_cut, "grp_08_agglomerative": clusters, "grp_09_clique_partition": clusters, "grp_10_set_partition": clusters,
    "grp_13_quota_assignment": lambda rows, duck: len(rows) == lines_of(duck, f"{SCORE} >= 0.3") and all(0 <= r["quota_cls"] <= 3 for r in rows),
    "grp_14_monotone": lambda rows, duck: len(rows) == lines_of(duck, f"{SCORE} >= 0.5") and all(0 <= r["mono_cls"] <= 3 for r in rows),
    "grp_15_threshold_triple_full": lambda rows, duck: len(rows) == 1 and rows[0]["a"] < rows[0]["b"] < rows[0]["c"], "grp_17_affine_full": unique("cls"), "grp_17_forward_blend": unique("step"),
    "grp_19_collapse": unique("stem", "det_id", "cls"), "grp_23_policy": both(unique("tree"), lambda rows, duck: all(r["f1"] in (r["f_union"], r["f_agglo"]) for r in rows)),
    "mlx_01_ridge_cv": both(unique("tree"), lambda rows, duck: all(r["count"] >= 0 for r in rows)), "mlx_02_ridge_gcv": unique("tree"), "mlx_03_pair_logistic": shares("auc"), "mlx_04_tree_ensembles": unique("model"),
    "mlx_05_per_class_boosting": unique("cls"), "mlx_06_out_of_fold": both(unique("tree"), shares("oof")), "mlx_07_stacking": shares("auc"), "mlx_08_bagged_selection": both(unique("member"), shares("share")),
    "mlx_10_clusters": both(unique("cluster"), shares("purity")), "mlx_10_projection": unique("vec_id"), "mlx_11_calibrator": unique("cls"), "mlx_12_cluster_ranker": unique("tree", "cls"),
    "mlx_13_ordinal_probe": lambda rows, duck: len(rows) == 1, "rsm_03_map_bootstrap": both(unique("b"), shares("map50")),
    "rsm_05_jitter": both(unique("stem", "det_id"), lambda rows, duck: 0.8 < len(rows) / lines_of(duck) < 0.9), "rsm_06_label_noise": lambda rows, duck: 0.87 < rows[0]["agreement"] < 0.93,
    "val_03_lock": lambda rows, duck: rows == [{"again": False, "first": True}], "src_08_image_files": unique("stem"), "udf_02_table_function": unique("stem", "det_id"),
    "p3_trees": unique("source_row", "node"), "p3_images": unique("source_row", "node"), "p3_annotations": unique("source_row", "node"), "p3_bunches": unique("source_row", "node"), "p3_appearances": unique("source_row", "node"),
    "p4_found": both(unique("file_id", "change", "old_name", "new_name"), lambda rows, duck: {r["change"] for r in rows} <= {"renamed", "added", "removed", "retyped"}),
    "p4_epochs": unique("run_name", "epoch", "origin"),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(REG.queries))
def test_query(spark, duck, name):
    df = REG.queries[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    if name not in REG.sql:
        holds = INVARIANTS.get(name)
        assert holds is not None, f"{name} has neither SQL nor an invariant"
        rows = [dict(zip(cols, r, strict=True)) for r in got]
        assert rows and holds(rows, duck)
        return
    res = duck.execute(REG.sql[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in res.fetchall()), key=repr)
