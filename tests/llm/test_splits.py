import random
from collections import Counter

from pyspark.sql import functions as F

from grovekit.llm.splits import assign, band_quotas, deal_splits, spanning_forest
from grovekit.scale import Workspace

MANIFEST = "row_id bigint, tree_id string, new_split string, source string, session_id string, doc_no bigint, a int, weight double, group_id int"
TARGETS = [("train", 0.7), ("val", 0.14), ("test", 0.16)]


def components(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {x: find(x) for x in parent}


def test_forest_spans_and_has_no_cycle(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(120), rnd.randrange(120), float(rnd.randrange(3))) for _ in range(150)] + [(i, i + 1, 1.0) for i in range(500, 700)] + [(9, 9, 1.0), (None, 4, 1.0)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint, weight double")
    forest, labels = spanning_forest(df, Workspace(spark, "t"))
    f, lab = forest.collect(), {r.vertex: r.root for r in labels.collect()}
    want = components([(a, b) for a, b, _ in pairs if a is not None and a != b])
    assert set(lab) == set(want)
    sizes = Counter(lab.values())
    assert len(f) == sum(s - 1 for s in sizes.values())
    assert {frozenset(x for x in want if want[x] == c) for c in set(want.values())} == {frozenset(x for x in lab if lab[x] == c) for c in sizes}
    assert components([(r.a, r.b) for r in f]).keys() == lab.keys()
    assert all(min(x for x in lab if lab[x] == c) == c for c in sizes)


def test_minimum_weight(spark):
    edges = [(1, 2, 5.0), (2, 3, 1.0), (1, 3, 1.0), (3, 4, 2.0), (4, 1, 9.0)]
    forest, _ = spanning_forest(spark.createDataFrame(edges, "a bigint, b bigint, weight double"), Workspace(spark, "t"))
    assert sum(r.weight for r in forest.collect()) == 4.0


def test_groups_stay_together_and_shares_hold(spark):
    rnd = random.Random(2)
    rows = [(i, f"MERANTU_A{rnd.randrange(10):02d}A_{rnd.randrange(120):04d}", None, "s", rnd.choice([None, "-", "", "n/a", f"S-{rnd.randrange(4000)}"]), None, 0, 0.0, 0) for i in range(3000)]
    m = spark.createDataFrame(rows, MANIFEST)
    out = assign(m, spark.createDataFrame(TARGETS, "split_name string, share double"), Workspace(spark, "t")).collect()
    assert len(out) == 3000
    by_tree, by_group = {}, {}
    names = {r[0]: r[1] for r in rows}
    for r in out:
        assert by_tree.setdefault(names[r.row_id], r.new_split) == r.new_split
        assert by_group.setdefault(r.group_id, r.new_split) == r.new_split


def test_dealing_meets_shares(spark):
    rnd = random.Random(3)
    groups = spark.createDataFrame([(i, rnd.choice([1, 1, 1, 2, 3, 5, 9])) for i in range(5000)] + [(9000, 3000), (9001, 700)], "group_id bigint, size bigint")
    dealt = deal_splits(groups, spark.createDataFrame(TARGETS, "split_name string, share double"))
    assert dealt.count() == 5002
    total = dealt.agg(F.sum("size")).first()[0]
    got = {r.new_split: r.n / total for r in dealt.groupBy("new_split").agg(F.sum("size").alias("n")).collect()}
    assert all(abs(got[k] - s) < 0.02 for k, s in TARGETS)


def test_empty_and_null(spark):
    empty = assign(spark.createDataFrame([], MANIFEST), spark.createDataFrame(TARGETS, "split_name string, share double"), Workspace(spark, "t"))
    assert empty.count() == 0
    one = spark.createDataFrame([(1, None, None, None, None, None, None, None, None), (2, None, None, None, "unknown", None, None, None, None)], MANIFEST)
    out = assign(one, spark.createDataFrame([], "split_name string, share double"), Workspace(spark, "t")).collect()
    assert sorted((r.row_id, r.group_id, r.new_split) for r in out) == [(1, 1, None), (2, 2, None)]


def test_one_rule_for_giants_and_single_rows(spark):
    groups = spark.createDataFrame([(i, 1) for i in range(3000)] + [(9000, 4000), (9001, 3900), (9002, 900), (9003, 50)], "group_id bigint, size bigint")
    dealt = deal_splits(groups, spark.createDataFrame(TARGETS, "split_name string, share double")).collect()
    total, got = sum(r["size"] for r in dealt), Counter()
    for r in dealt:
        got[r.new_split] += r["size"]
    assert len(dealt) == len({r.group_id for r in dealt}) == 3004
    assert all(abs(got[k] / total - s) < 0.001 for k, s in TARGETS)


def test_quotas_hold_all_groups():
    bands = [(0, 1000, 1000), (8, 31, 62), (40, 1, 500), (88, 1, 90000)]
    quotas = band_quotas(bands, dict(TARGETS))
    assert all(sum(q for _, q in quotas[b]) == n for b, n, _ in bands)
    assert dict(quotas[88])["train"] == 1 and dict(quotas[0])["train"] == 0  # the giant is more than train's share already
