import random

import pandas as pd
from test_overlap import document, pairs

from grovekit.llm.overlap import TOLERANCE, Boxes


def test_every_cell_within_reach_is_listed():
    centres = [k / 100 for k in range(0, 100)]
    table = lambda vs: pd.DataFrame({"boxes": [[v, 0.25, 0.25, 0.25] for v in vs], "ords": [[0]] * len(vs)})
    codec = Boxes(TOLERANCE)
    phrases, owner, _, _ = codec.phrases(table(centres))
    listed = set(zip(owner.tolist(), phrases, strict=True))
    for shift in (-TOLERANCE, -0.005, 0.0, 0.005, TOLERANCE):
        text = codec.text(table([v + shift for v in centres]))[0]
        assert {(i, text[5 * i : 5 * i + 4]) for i in range(len(centres))} <= listed


def test_least_share_on_cell_centres(spark):
    rnd = random.Random(5)
    mid = lambda: (2 * rnd.randrange(5, 45) + 1) / 100
    for n, same in ((10, 8), (6, 5)):
        base = [(mid(), mid(), 0.11, 0.13) for _ in range(n)]
        train = base[:same] + [(0.5, 0.5, 0.9, 0.9)] * (n - same)
        fewer = base[: same - 1] + [(0.5, 0.5, 0.9, 0.9)] * (n - same + 1)
        rows = [(i, i, "uji" if i == 1 else "latih", f"T_{chr(64 + i)}1A_{i}", None, 0, 0) for i in range(1, 4)]
        assert pairs(spark, rows, [document(1, base), document(2, train), document(3, fewer)]) == {(1, 2, "boxes")}
