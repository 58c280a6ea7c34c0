from functools import cache
from itertools import combinations

import numpy as np
import pytest

from grovekit.operators import linking
from grovekit.plans import catalog


def best_value(sides, gain, most, connected):
    """Largest summed gain by trying, for the lowest node left, every set that holds it."""
    n = len(sides)

    def worth(c):
        if len({sides[i] for i in c}) < len(c) or connected and len(linking.loose_components(len(c), gain[np.ix_(c, c)])) > 1:
            return None
        return sum(gain[i, j] for i, j in combinations(c, 2))

    sets = [(c, w) for k in range(2, most + 1) for c in combinations(range(n), k) if (w := worth(c)) is not None and w > 0]

    @cache
    def go(left):
        if not left:
            return 0.0
        low = min(left)
        return max([go(left - {low}), *[w + go(left - set(c)) for c, w in sets if c[0] == low and left.issuperset(c)]])

    return go(frozenset(range(n)))


@pytest.mark.parametrize("seed", range(6))
def test_exact_beyond_the_former_limits(seed):
    rng = np.random.default_rng(seed)
    n = 14
    sides = [i % 4 for i in range(n)]
    g = np.round(rng.normal(size=(n, n)), 3)
    g = np.where(np.array(sides)[:, None] == np.array(sides)[None], -20.0, (g + g.T) / 2)
    value = lambda lab: sum(g[i, j] for i in range(n) for j in range(i) if lab[i] == lab[j])
    for (label, exact), most, connected in ((linking.cliques_checked(sides, g, 3), 3, False), (linking.sets_checked(sides, g, 4), 4, True)):
        assert all(exact) and value(label) == pytest.approx(best_value(sides, g, most, connected))


def test_what_is_not_exact_is_told():
    sides = [i % 4 for i in range(36)]
    g = np.where(np.array(sides)[:, None] == np.array(sides)[None], -20.0, 1.0)
    assert not any(linking.cliques_checked(sides, g, 3)[1])
    assert not any(linking.sets_checked(sides, g, 4, budget=0)[1])


@pytest.mark.parametrize("name", ["grp_09_clique_partition", "grp_10_set_partition"])
def test_registered_queries_are_exact(spark, name):
    rows = catalog.build().queries[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.exact for r in rows)
