import random

from grovekit.llm.components import box_matches, connected_groups
from grovekit.scale import Workspace

BOX = "box_id bigint, tree_id string, side_index int, box_index int, bunch_id string, edges string, a int, v int"
LINK = "link_id bigint, tree_id string, side_i int, i int, side_j int, j int, score double, h int"


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), []).append(x)
    return {(x, min(g)) for g in groups.values() for x in g}


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    return {(r.vertex, r.group_id) for r in connected_groups(df, Workspace(spark, "t")).collect()}


def test_random_graphs_match_brute_force(spark):
    rnd = random.Random(1)
    for n, m in ((30, 15), (200, 150), (60, 400)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        assert run(spark, pairs) == brute(pairs)


def test_chain_star_loops_nulls_and_repeats(spark):
    chain = [(i + 1, i) for i in range(200)]
    star = [(1000, 1001 + i) for i in range(300)]
    pairs = chain + star + star + [(5000, 5000), (None, 3), (4, None), (None, None)]
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, []) == set()


def test_box_matches_cases(spark):
    boxes = spark.createDataFrame([
        (1, "T1", 0, 0, "b1", "x", 1, 1), (2, "T1", 1, 0, "b1", None, 1, 1), (2, "T1", 1, 0, "b1", None, 1, 1), (3, "T2", 0, 0, "b1", None, 1, 1),
        (4, "T1", 2, 0, "-7", None, 1, 1), (5, "T1", 3, 0, "-7", None, 1, 1), (6, "T1", 4, 0, " ", None, 1, 1), (7, "T1", 5, 0, " ", None, 1, 1), (8, None, 0, 0, "b1", None, 1, 1), (None, "T1", 9, 9, "b1", None, 1, 1),
    ], BOX)
    links = spark.createDataFrame([
        (1, " t1 ", 2, 0, 1, 0, None, 1), (2, "T1", 2, 0, 2, 0, 0.5, 1), (3, "T1", 3, None, 0, 0, 0.5, 1), (4, "T1", 3, 99, 0, 0, 0.5, 1), (5, None, 0, 0, 1, 0, 0.5, 1), (6, "T2", 0, 0, 0, 0, 0.1, 1),
    ], LINK)
    got = {(r.vertex, r.group_id) for r in connected_groups(box_matches(boxes, links), Workspace(spark, "t")).collect()}
    assert got == {(1, 1), (2, 1), (4, 1)}


def test_hot_bunch(spark):
    boxes = spark.range(2000).selectExpr("id as box_id", "'T' as tree_id", "cast(id as int) as side_index", "0 as box_index", "'big' as bunch_id")
    links = spark.createDataFrame([], LINK)
    got = connected_groups(box_matches(boxes, links), Workspace(spark, "t"))
    assert got.count() == 2000 and [r.group_id for r in got.select("group_id").distinct().collect()] == [0]
