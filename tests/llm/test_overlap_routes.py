import random

import numpy as np
import pandas as pd
import pytest

from grovekit.llm import overlap
from grovekit.llm.overlap import STEPS, TOLERANCE, gap_for, gap_of, misses, near_pairs, pair_count, record_pairs, text_pairs
from grovekit.scale import Workspace

CLASSES = "id bigint, n int, boxes array<double>"


def flat(boxes):
    return [float(v) for b in sorted(boxes) for v in b]


def box(rnd, span):
    return (rnd.uniform(0.5 - span, 0.5 + span), rnd.uniform(0, 1), rnd.uniform(0.05, 0.2), rnd.uniform(0.05, 0.2))


def partners(rnd, boxes, n, span):
    """A text of ``n`` boxes: as few partners as allowed, at up to the whole tolerance, and others."""
    keep = rnd.sample(boxes, max(len(boxes), n) - misses(max(len(boxes), n)))
    return [tuple(v + rnd.choice([-TOLERANCE, TOLERANCE, rnd.uniform(-TOLERANCE, TOLERANCE)]) for v in b) for b in keep] + [box(rnd, span) for _ in range(n - len(keep))]


def met(record, text):
    e = pd.concat(record_pairs(iter([pd.DataFrame({"id": [1], "boxes": [record], "often": [[0] * (len(record) // 4)]})])))
    t = pd.concat(text_pairs(iter([pd.DataFrame({"id": [2], "boxes": [text]})])))
    for _, r in e.merge(t, on="token").iterrows():
        near = [(int(r[c]) >> (16 * d)) & 0xFFFF for c in ("near_a", "near_b") for d in range(4)]
        if all(abs(((int(r["at"]) >> (8 * d)) & (STEPS - 1)) + STEPS - v) <= 65 for d, v in enumerate(near)):
            return True
    return False


@pytest.mark.parametrize("span", [0.5, 0.05, 0.0])
def test_no_true_pair_is_without_route(span):
    rnd = random.Random(7)
    for n in [*range(6, 31), 64]:
        for other in {n, n - misses(n), n * 5 // 4}:
            if other >= 6:
                boxes = [box(rnd, span) for _ in range(n)]
                assert met(flat(boxes), flat(partners(rnd, boxes, other, span))), (n, other)


def test_boxes_that_are_no_numbers_are_misses():
    rnd = random.Random(2)
    boxes = [box(rnd, 0.5) for _ in range(10)]
    bad = [(0.2, 0.2, float("inf"), 0.1), (float("nan"), 0.2, 0.1, 0.1)]
    assert met(flat(boxes[:8]) + [v for b in bad for v in b], flat(boxes))


def test_enough_neighbours_keep_to_the_gap():
    rng = np.random.default_rng(1)
    for n in range(6, 200):
        for x in (rng.random(n), rng.random(n) ** 9, np.repeat(np.arange(n // 2 + 1) / (n // 2), 2)[1 : n + 1], np.linspace(0, 1, n)):
            x = np.sort(x)
            gaps = x[1::2] - x[: n // 2 * 2 : 2]
            assert (gaps <= gap_of(n) + 1e-9).sum() > misses(n)
        assert all(gap_for(k) >= gap_of(n) + 2 * TOLERANCE for k in (n, max(6, n - misses(n)), n * 5 // 4))


def test_texts_are_scanned_by_the_shards_that_may_match(spark, monkeypatch):
    rnd = random.Random(5)
    scanned = spark.sparkContext.accumulator(0)

    class Counted(overlap.Boxes):
        def text(self, df):
            scanned.add(len(df))
            return super().text(df)

    docs = [[box(rnd, 0.5) for _ in range(10)] for _ in range(12)]
    near = [partners(rnd, d, 10, 0.5) for d in docs] + [[box(rnd, 0.5) for _ in range(10)] for _ in range(60)]
    rows = lambda ds, at: spark.createDataFrame([(at + i, len(d), flat(d)) for i, d in enumerate(ds)], CLASSES)
    monkeypatch.setattr(overlap, "Boxes", Counted)
    monkeypatch.setattr(overlap, "SHARD_PHRASES", 100)
    got = {(r.pid, r.tid) for r in near_pairs(rows(docs, 0), rows(near, 100), Workspace(spark, "t")).collect()}
    table = lambda d: np.array(flat(d)).reshape(-1, 4)
    want = {(i, 100 + j) for i, d in enumerate(docs) for j, t in enumerate(near) if pair_count(table(d), table(t)) >= 8}
    assert got == want and len(want) == 12
    assert scanned.value == 12  # not 72 texts for every shard
