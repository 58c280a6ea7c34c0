import random

import numpy as np
from pyspark.sql import functions as F

from grovekit.llm.mixing import fit_rates, memberships, mixed, posteriors, share_report, two_likeliest
from grovekit.scale import Workspace

MIX = "mix_id int, source string, target_share double, max_repeats int, total_share_of_corpus double"
DOC = "doc_id bigint, text string, source string, copies int, q string, rate double"
WORDS = {"red": ["merah", "api", "tajuk", "sisi"], "blue": ["laut", "biru", "ombak", "sisi"], "green": ["daun", "hijau", "pohon", "sisi"]}


def corpus(n=400, seed=1, nameless=0.0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.choices(list(WORDS), [6, 3, 1])[0]
        text = " ".join(rnd.choice(WORDS[s]) for _ in range(rnd.randrange(3, 60)))
        rows.append((i, text, None if rnd.random() < nameless else rnd.choice([s, s.upper(), f" {s} "]), 0, "", 0.0, s))
    return rows


def run(spark, rows, mixes):
    copies, targets, members = mixed(spark.createDataFrame([r[:6] for r in rows], DOC), spark.createDataFrame(mixes, MIX), Workspace(spark, "t"))
    report = {(r.mix_id, r.source): r for r in share_report(copies, targets, members).collect()}
    return copies.collect(), report


def test_shares_and_repeats(spark):
    mixes = [(1, "red", 0.5, 1, 0.6), (1, "Blue ", 0.3, 2, 0.6), (1, "green", 0.2, 4, 0.6), (2, "green", 0.9, 2, 0.9), (2, "ghost", 0.1, 2, 0.9), (2, None, 0.3, 1, 0.9), (3, "red", None, 1, 0.5), (3, "red", 0.0, 1, 0.5)]
    copies, rep = run(spark, corpus(), mixes)
    for s, share in (("red", 0.5), ("blue", 0.3), ("green", 0.2)):
        assert abs(rep[1, s].actual_share - share) < 0.01
    assert rep[2, "green"].most_repeats == 2 and rep[2, "green"].missing_tokens > 0
    assert rep[2, "ghost"].actual_tokens == 0 and rep[2, "ghost"].missing_tokens > 0
    cap = {(1, "red"): 1, (1, "blue"): 2, (1, "green"): 4, (2, "green"): 2}
    assert all(0 < r.copies <= cap[r.mix_id, r.source] for r in copies)
    assert len({(r.mix_id, r.doc_id) for r in copies}) == len(copies)


def test_nameless_documents_count_by_posterior(spark):
    rows = corpus(nameless=0.4)
    mixes = [(1, "red", 0.4, 3, 0.5), (1, "blue", 0.3, 3, 0.5), (1, "green", 0.3, 3, 0.5)]
    copies, rep = run(spark, rows, mixes)
    true = {r[0]: r[6] for r in rows}
    total = sum(r.n_tokens * r.copies for r in copies)
    for s in WORDS:
        assert abs(sum(r.n_tokens * r.copies for r in copies if true[r.doc_id] == s) / total - {"red": 0.4}.get(s, 0.3)) < 0.04


def test_held_out_accuracy(spark):
    rows = corpus(600)
    lab = spark.createDataFrame([(r[1], r[6]) for r in rows[:400]], "text string, source string")
    new = spark.createDataFrame([(r[0], r[1]) for r in rows[400:]] + [(9999, None)], "doc_id bigint, text string")
    names = sorted(WORDS)
    got = {r.doc_id: list(r.p) for r in posteriors(lab, new, names).collect()}
    right = sum(names[got[r[0]].index(max(got[r[0]]))] == r[6] for r in rows[400:])
    assert right / 200 > 0.9 and abs(sum(got[9999]) - 1) < 1e-6


def test_every_document_has_a_soft_membership_and_both_totals_meet(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(WORDS[rnd.choices([t, o], [3, 2])[0]]) for _ in range(rnd.randrange(2, 9))), s, 0, "", 0.0, s)
            for i in range(600) for t in [rnd.choice(list(WORDS))] for o in [rnd.choice(list(WORDS))] for s in [t if rnd.random() < 0.7 else rnd.choice([*WORDS, "spare"])]]
    docs = spark.createDataFrame([r[:6] for r in rows], DOC)
    mixes = spark.createDataFrame([(1, "red", 0.5, 3, 0.5), (1, "blue", 0.3, 3, 0.5), (1, "green", 0.2, 3, 0.5)], MIX)
    copies, targets, members = mixed(docs, mixes, Workspace(spark, "t"))
    p = {r.doc_id: {e.source: e.share for e in r.p} for r in members.collect()}
    assert len(p) == 600 and all(abs(sum(x.values()) - 1) < 1e-9 for x in p.values())
    assert sum(len(x) > 1 for x in p.values()) > 300
    by_hand, soft = {}, {}
    for r in copies.collect():
        by_hand[r.source] = by_hand.get(r.source, 0) + r.n_tokens * r.copies
        for n, x in p[r.doc_id].items():
            soft[n] = soft.get(n, 0) + r.n_tokens * r.copies * x
    total = sum(by_hand.values())
    for r in share_report(copies, targets, members).collect():
        assert r.actual_tokens == by_hand[r.source] and abs(r.actual_share - by_hand[r.source] / total) < 1e-9 and abs(r.expected_share - soft[r.source] / total) < 1e-9
        assert abs(r.actual_share - r.target_share) < 0.01 and abs(r.expected_share - r.target_share) < 0.01
    assert by_hand.get("spare", 0) / total < 0.01  # nobody asks for it, but its documents are not shut out


def test_two_likeliest(spark):
    rows = [([0.5, 0.3, 0.2],), ([0.0, 1.0, 0.0],), ([0.34, 0.33, 0.33],), ([0.5, 0.5],), ([1.0],)]
    got = [tuple(r.x) for r in spark.createDataFrame(rows, "p array<double>").select(two_likeliest(F.col("p")).alias("x")).collect()]
    assert got == [(0, 1, 48), (1, -1, 0), (0, 1, 63), (0, 1, 64), (0, -1, 0)]


def test_rates_meet_what_can_be_met():
    u = memberships([{"first": 0, "second": 1, "part": 32, "named": 0}, {"first": 0, "second": -1, "part": 0, "named": 1}, {"first": 1, "second": -1, "part": 0, "named": 1}, {"first": 1, "second": 0, "part": 64, "named": -1}, {"first": 1, "second": -1, "part": 0, "named": -2}], 2)
    tokens = np.array([100.0, 50.0, 80.0, 40.0, 60.0])
    r = fit_rates(u, tokens, np.array([2, 2, 2, 2, 2]), np.array([60.0, 90.0, 0.0, 60.0, 90.0, 0.0]), 3)
    assert np.allclose((u * tokens[:, None]).T @ r, [60, 90, 0, 60, 90, 0], atol=0.5)
    short = fit_rates(u, tokens, np.array([1, 1, 1, 1, 1]), np.array([1e6, 10.0, 0.0, 1e6, 10.0, 0.0]), 3)
    assert short[0] == 1 and short[3] == 1  # all that there is


def test_empty(spark):
    mixes = [(1, "red", 1.0, 1, 0.5)]
    assert run(spark, [], mixes)[0] == []
    assert run(spark, corpus(20), [])[0] == []
    assert run(spark, [(1, None, "red", 0, "", 0.0, ""), (2, "", "red", 0, "", 0.0, "")], mixes)[0] == []
    only = [(1, "api api", None, 0, "", 0.0, ""), (2, "laut", None, 0, "", 0.0, "")]
    assert len(run(spark, only, [(1, "red", 1.0, 5, 1.0)])[0]) > 0


def test_third_sources_count(spark):
    """Texts that speak for three sources about alike: none of their shares is dropped."""
    rnd = random.Random(3)
    rows = corpus(300, seed=5) + [(1000 + i, " ".join(rnd.choice(["api", "laut", "daun", "sisi"]) for _ in range(6)), None, 0, "", 0.0, "") for i in range(200)]
    docs = spark.createDataFrame([r[:6] for r in rows], DOC)
    mixes = spark.createDataFrame([(1, "red", 0.4, 3, 0.5), (1, "blue", 0.3, 3, 0.5), (1, "green", 0.3, 3, 0.5)], MIX)
    copies, targets, members = mixed(docs, mixes, Workspace(spark, "t"))
    names = sorted(WORDS)
    want = {r.doc_id: r.p for r in posteriors(docs.select("text", F.lower(F.trim("source")).alias("source")), docs.select("doc_id", "text"), names).collect()}
    p = {r.doc_id: {e.source: e.share for e in r.p} for r in members.collect()}
    for i in range(1000, 1200):
        assert len(p[i]) == 3 and all(abs(p[i][n] - x) < 1e-9 for n, x in zip(names, want[i], strict=True))
    soft = {}
    for r in copies.collect():
        for n, x in p[r.doc_id].items():
            soft[n] = soft.get(n, 0) + r.n_tokens * r.copies * x
    total = sum(r.n_tokens * r.copies for r in copies.collect())
    for r in share_report(copies, targets, members).collect():
        assert abs(r.expected_share - soft[r.source] / total) < 1e-9 and abs(r.expected_share - r.target_share) < 0.02
