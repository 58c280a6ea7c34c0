from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from grovekit.llm.packing import pack_histogram, packed, slots
from grovekit.llm.tokens import VOCABULARY, encoder, sized
from grovekit.scale import Workspace


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30), st.sampled_from([0, 1, 2]))
def test_patterns_hold_the_histogram_and_fit(hist, sep):
    ps = pack_histogram(hist, 64, sep)
    got = Counter()
    for p in ps:
        n = sum(t for _, t in p.pieces)
        assert p.count > 0 and n > 0
        assert sum(le * t for le, t in p.pieces) + (n - 1) * sep <= 64
        for le, t in p.pieces:
            got[le] += t * p.count
    assert got == Counter(hist)


def test_near_the_least():
    hist = {k: 300 - k for k in range(1, 257)}
    total = sum(k * n for k, n in hist.items())
    assert sum(p.count for p in pack_histogram(hist, 256, 0)) <= total / 256 * 1.01 + 1


def test_slots_number_every_rank():
    hist = {5: 7, 3: 4, 9: 2}
    for length, t in slots(pack_histogram(hist, 10, 1)).items():
        assert t[0][0] == 0 and (t[:, 2] > 0).all() and length in hist


def test_documents_in_containers(spark):
    rows = [(i, n) for i, n in enumerate([1, 1, 5, 300, 64, 128, 63, 0, 1000, 7, 7, 7])]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([(1, 64, 1), (2, 256, 0), (None, 5, 5), (3, 0, 0), (4, None, 1), (1, 64, 1)], "pack_id int, capacity_tokens int, separator_tokens int")
    out = packed(sizes, packs, Workspace(spark, "t")).toPandas()
    for pack, cap, sep in ((1, 64, 1), (2, 256, 0)):
        o = out[out.pack_id == pack]
        g = o.groupby("container_id").agg(t=("n_tokens", "sum"), n=("n_tokens", "size"), places=("place", "nunique"))
        assert ((g.t + (g.n - 1) * sep) <= cap).all() and (g.n == g.places).all()
        per = o.groupby("doc_id").agg(t=("n_tokens", "sum"), n=("n_tokens", "size"))
        assert per.t.to_dict() == {i: n for i, n in rows if n}
        assert all(per.n[i] == -(-n // cap) for i, n in rows if n)
        for _, d in o.sort_values("start_token").groupby("doc_id"):
            assert (d.start_token.to_numpy()[1:] == (d.start_token + d.n_tokens).to_numpy()[:-1]).all()
    assert set(out.pack_id) == {1, 2}


def test_empty(spark):
    sizes = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    packs = spark.createDataFrame([(1, 8, 0)], "pack_id int, capacity_tokens int, separator_tokens int")
    assert packed(sizes, packs, Workspace(spark, "t")).count() == 0
    assert packed(spark.createDataFrame([(1, 3)], "doc_id bigint, n_tokens bigint"), spark.createDataFrame([], packs.schema), Workspace(spark, "t")).count() == 0


def test_token_counts(spark):
    texts = [(1, "Kamera mati lagi!"), (2, None), (3, ""), (4, "果串" * 2000), (None, "x"), (5, "<|endoftext|>")]
    got = {r.doc_id: r.n_tokens for r in sized(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    enc = encoder(VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in texts if i is not None}
    assert enc.decode(enc.encode_ordinary("果串 abc")) == "果串 abc"
