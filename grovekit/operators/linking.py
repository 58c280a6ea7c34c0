"""Linking views of the same object under constraints (GRP-06..14): per tree, on nodes 0..n-1 with a side each.

A cluster never holds two nodes of one side.  Edges are (score, i, j); order is score descending, then i, then j.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np

from grovekit.operators.matching import assignment


def size_cap(sides: int) -> int:
    """Views that one object can be seen in: 3 of 4 sides, 6 of more."""
    return 3 if sides <= 4 else 6


def union_find(sides: Sequence[int], edges: Sequence[tuple[float, int, int]], cap: int, cut: float = -np.inf, stop_at: int | None = None) -> list[int]:
    """Label (smallest node) of each node: edges join two clusters if these share no side and stay within the cap.

    ``stop_at``: no more joins once so few clusters are left.
    """
    parent, mask, size, left = list(range(len(sides))), [1 << s for s in sides], [1] * len(sides), len(sides)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for score, i, j in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if score < cut or (stop_at is not None and left <= stop_at):
            break
        a, b = sorted((find(i), find(j)))
        if a == b or mask[a] & mask[b] or size[a] + size[b] > cap:
            continue
        parent[b] = a
        mask[a] |= mask[b]
        size[a] += size[b]
        left -= 1
    return [find(x) for x in range(len(sides))]


def pair_assignments(sides: Sequence[int], weight: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges of an optimal one-to-one assignment between each two sides, weight above 0."""
    by: dict[int, list[int]] = {}
    for k, s in enumerate(sides):
        by.setdefault(s, []).append(k)
    out = []
    for s, t in combinations(sorted(by), 2):
        a, b = by[s], by[t]
        to = assignment(weight[np.ix_(a, b)])
        out += [(float(weight[a[i], b[j]]), a[i], b[j]) for i, j in enumerate(to) if j >= 0 and weight[a[i], b[j]] > 0]
    return out


def assignment_grid(sides: Sequence[int], weight: np.ndarray, cuts: Sequence[float], cap: int) -> list[tuple[float, list[int]]]:
    """Clusters for every threshold from one set of assignment edges."""
    edges = pair_assignments(sides, weight)
    return [(c, union_find(sides, edges, cap, c)) for c in cuts]


def agglomerate(sides: Sequence[int], weight: np.ndarray, cut: float, cap: int, linkage: str = "mean") -> list[int]:
    """Constrained agglomeration: always the two clusters of strongest link (mean, min, or mean of the two best) of at least ``cut``."""
    groups = [[k] for k in range(len(sides))]

    def link(a: list[int], b: list[int]) -> float:
        v = np.sort(weight[np.ix_(a, b)].ravel())
        return float({"mean": v.mean(), "min": v[0], "top2": v[-2:].mean()}[linkage])

    while True:
        best = None
        for x, y in combinations(range(len(groups)), 2):
            a, b = groups[x], groups[y]
            if len(a) + len(b) > cap or {sides[i] for i in a} & {sides[i] for i in b}:
                continue
            v = link(a, b)
            if v >= cut and (best is None or (v, -x, -y) > best[0]):
                best = ((v, -x, -y), x, y)
        if best is None:
            break
        _, x, y = best
        groups[x] = sorted(groups[x] + groups.pop(y))
    out = [0] * len(sides)
    for g in groups:
        for i in g:
            out[i] = min(g)
    return out


def loose_components(n: int, gain: np.ndarray) -> list[list[int]]:
    """Components over pairs of positive gain; no optimal clique crosses them."""
    seen, out = set(), []
    for s in range(n):
        if s in seen:
            continue
        stack, comp = [s], []
        while stack:
            x = stack.pop()
            if x in seen:
                continue
            seen.add(x)
            comp.append(x)
            stack += [int(y) for y in np.flatnonzero(gain[x] > 0) if y not in seen]
        out.append(sorted(comp))
    return out


def clique_partition(sides: Sequence[int], gain: np.ndarray, cap: int, most: int = 34, budget: int = 200_000) -> list[int]:
    """Labels of ``cliques_checked``."""
    return cliques_checked(sides, gain, cap, most, budget)[0]


def cliques_checked(sides: Sequence[int], gain: np.ndarray, cap: int, most: int = 34, budget: int = 200_000) -> tuple[list[int], list[bool]]:
    """Partition into side-disjoint cliques of largest summed gain (log-odds minus threshold, may be negative), exactly.

    Branch and bound per loose component of at most ``most`` nodes, within ``budget`` steps; beyond either, average-linkage
    agglomeration, which is no worse than leaving all apart.  The second list tells of each node whether its component was
    solved exactly.
    """
    label, exact = list(range(len(sides))), [True] * len(sides)
    for comp in loose_components(len(sides), gain):
        if len(comp) == 1:
            continue
        own, g = [sides[i] for i in comp], gain[np.ix_(comp, comp)]
        chosen = _packing(len(comp), _sets(own, g, cap, False), budget) if len(comp) <= most else None
        found = agglomerate(own, g, 1e-12, cap) if chosen is None else _labels(len(comp), chosen)
        for i, x in zip(comp, found, strict=True):
            label[i], exact[i] = comp[x], chosen is not None
    return label, exact


def _labels(n: int, chosen: list[tuple[int, ...]]) -> list[int]:
    out = list(range(n))
    for c in chosen:
        for i in c:
            out[i] = c[0]
    return out


def _sets(sides: Sequence[int], gain: np.ndarray, most: int, connected: bool) -> list[tuple[float, tuple[int, ...]]]:
    """Side-disjoint sets of 2 to ``most`` nodes with summed pair gain above 0; ``connected``: over pairs of positive gain."""
    n, g = len(sides), gain.tolist()
    near = [sum(1 << j for j in range(n) if g[i][j] > 0 and j != i) for i in range(n)]
    out: list[tuple[float, tuple[int, ...]]] = []

    def whole(c: tuple[int, ...]) -> bool:
        left, reached = sum(1 << i for i in c), 1 << c[0]
        while True:
            more = reached
            for i in c:
                if reached >> i & 1:
                    more |= near[i] & left
            if more == reached:
                return reached == left
            reached = more

    def grow(c: tuple[int, ...], taken: int, v: float) -> None:
        if len(c) > 1 and v > 0 and (not connected or whole(c)):
            out.append((v, c))
        if len(c) < most:
            for j in range(c[-1] + 1, n):
                if not taken >> sides[j] & 1:
                    grow((*c, j), taken | 1 << sides[j], v + sum(g[i][j] for i in c))

    for i in range(n):
        grow((i,), 1 << sides[i], 0.0)
    return out


def _greedy(sets: list[tuple[float, tuple[int, ...]]]) -> list[tuple[int, ...]]:
    chosen, used = [], set()
    for _, c in sorted(sets, key=lambda s: (-s[0], s[1])):
        if used.isdisjoint(c):
            chosen.append(c)
            used.update(c)
    return chosen


def _packing(n: int, sets: list[tuple[float, tuple[int, ...]]], budget: int) -> list[tuple[int, ...]] | None:
    """Disjoint sets of largest summed value, exactly; None beyond ``budget`` steps.

    Each node gets a price, so that no set is worth more than its nodes' prices; the prices' sum bounds every choice.  A set
    loses its prices minus its value, a node left alone its price; the search for the least loss prunes what has lost as much
    as the best so far, or as an earlier way to the same nodes left.
    """
    if not sets:
        return []
    v, m = np.array([s[0] for s in sets]), np.zeros((len(sets), n))
    for r, (_, c) in enumerate(sets):
        m[r, list(c)] = 1
    price = (v[:, None] / m.sum(axis=1)[:, None] * m).max(axis=0)
    of, rest = [np.flatnonzero(m[:, i]) for i in range(n)], v - m @ price
    for turn in range(20):
        total = price.sum()
        for i in np.roll(np.argsort(-price, kind="stable"), turn):
            step = max(float(rest[of[i]].max()) if len(of[i]) else -np.inf, -float(price[i]))
            price[i] += step
            rest[of[i]] -= step
        if total - price.sum() < 1e-9:
            break
    rank = np.argsort(-price, kind="stable")
    place = {int(i): k for k, i in enumerate(rank)}
    options: list[list] = [[(float(price[rank[k]]), 1 << k, None)] for k in range(n)]
    for r, (_, c) in enumerate(sets):
        at = [place[i] for i in c]
        options[min(at)].append((max(0.0, -float(rest[r])), sum(1 << k for k in at), c))
    for o in options:
        o.sort(key=lambda x: (x[0], x[1]))
    first = _greedy(sets)
    value = dict((c, w) for w, c in sets)
    best = [float(price.sum()) - sum(value[c] for c in first) + 1e-9, first]
    seen: dict[int, float] = {}
    steps = 0

    def go(left: int, loss: float, chosen: list) -> bool:
        nonlocal steps
        if not left:
            best[0], best[1] = loss, [c for c in chosen if c]
            return True
        for more, mask, c in options[(left & -left).bit_length() - 1]:
            if loss + more >= best[0] - 1e-12:
                break
            if mask & left == mask and loss + more < seen.get(left & ~mask, np.inf):
                steps += 1
                if steps > budget:
                    return False
                seen[left & ~mask] = loss + more
                if not go(left & ~mask, loss + more, [*chosen, c]):
                    return False
        return True

    return best[1] if go((1 << n) - 1, 0.0, []) else None


def set_partition(sides: Sequence[int], gain: np.ndarray, most_members: int = 4, budget: int = 200_000) -> list[int]:
    """Labels of ``sets_checked``."""
    return sets_checked(sides, gain, most_members, budget)[0]


def sets_checked(sides: Sequence[int], gain: np.ndarray, most_members: int = 4, budget: int = 200_000) -> tuple[list[int], list[bool]]:
    """Choose disjoint connected, side-disjoint subsets of at most ``most_members`` nodes with the largest summed pair gain.

    Exact by branch and bound for each loose component, of any size, within ``budget`` steps; greedy by gain beyond.  The
    second list tells of each node whether its component was solved exactly.
    """
    label, exact = list(range(len(sides))), [True] * len(sides)
    for comp in loose_components(len(sides), gain):
        if len(comp) == 1:
            continue
        sets = _sets([sides[i] for i in comp], gain[np.ix_(comp, comp)], most_members, True)
        chosen = _packing(len(comp), sets, budget)
        for i, x in zip(comp, _labels(len(comp), _greedy(sets) if chosen is None else chosen), strict=True):
            label[i], exact[i] = comp[x], chosen is not None
    return label, exact


def quota_assignment(p: np.ndarray, quota: Sequence[int]) -> list[int]:
    """Class of each row with given numbers per class (summing to the rows), of largest summed log probability."""
    slots = [k for k, q in enumerate(quota) for _ in range(q)]
    weight = np.log(np.maximum(p, 1e-12))[:, slots]
    to = assignment(weight - weight.min())
    return [slots[j] if j >= 0 else -1 for j in to]


def monotone_classes(p: np.ndarray, keep_above: float = np.inf) -> list[int]:
    """Classes never rising along the rows (given from the one expected highest class down), of largest summed probability.

    Cut points are found over prefix sums; a row whose best class is surer than ``keep_above`` keeps that class.
    """
    n, k = p.shape
    pre = np.vstack([np.zeros(k), np.cumsum(p, axis=0)])
    best, cuts = -np.inf, None
    for c in _cuts(n, k - 1):
        ends = [0, *c, n]
        v = sum(pre[ends[i + 1], k - 1 - i] - pre[ends[i], k - 1 - i] for i in range(k))
        if v > best + 1e-12:
            best, cuts = v, ends
    out = [k - 1 - i for i in range(k) for _ in range(cuts[i + 1] - cuts[i])]
    return [int(np.argmax(r)) if r.max() > keep_above else o for r, o in zip(p, out, strict=True)]


def _cuts(n: int, k: int):
    if k == 0:
        yield ()
        return
    for first in range(n + 1):
        for rest in _cuts(n - first, k - 1):
            yield (first, *(first + r for r in rest))


def view_weights(rows) -> tuple[list[int], np.ndarray]:
    """Sides and pair scores of a tree's boxes: closeness in height and size, class agreement."""
    s = [r["side"] for r in rows]
    cy, h, c = (np.array([f(r) for r in rows], dtype=float) for f in (lambda r: (r["y1"] + r["y2"]) / 2, lambda r: r["y2"] - r["y1"], lambda r: r["cls"]))
    d = 0.5 * ((cy[:, None] - cy[None]) / 120) ** 2 + 0.12 * np.log(h[:, None] / h[None]) ** 2 + 0.4 * (c[:, None] != c[None])
    w = np.round(np.exp(-np.minimum(d, 40)), 9)
    apart = np.array(s)[:, None] != np.array(s)[None]
    return s, np.where(apart, w, 0.0)


def weight_edges(w: np.ndarray, least: float = 0.05) -> list[tuple[float, int, int]]:
    i, j = np.nonzero(np.triu(w, 1) >= least)
    return [(float(w[a, b]), int(a), int(b)) for a, b in zip(i, j, strict=True)]


#: Pair weights of trees that are linked at once: trees of about the same size are packed into dense arrays of so many numbers.
DENSE = 1_000_000


def dense_trees(start: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(trees, at, ok) for chunks of trees of similar size: rows of their nodes as a table (tree, node), padded where not ``ok``."""
    order = np.argsort(n, kind="stable")
    begin = 0
    while begin < len(order):
        if not n[order[begin]]:
            begin += 1
            continue
        end = begin + 1
        while end < len(order) and (end - begin + 1) * int(n[order[end]]) ** 2 <= DENSE:
            end += 1
        trees = order[begin:end]
        node = np.arange(int(n[trees].max()))
        ok = node < n[trees][:, None]
        yield trees, np.where(ok, start[trees][:, None] + node, start[trees][:, None]), ok
        begin = end


def dense_weights(side: np.ndarray, cy: np.ndarray, h: np.ndarray, cls: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """``view_weights`` of many trees at once: (tree, node, node)."""
    i, j = (slice(None), slice(None), None), (slice(None), None, slice(None))
    with np.errstate(all="ignore"):
        d = 0.5 * ((cy[i] - cy[j]) / 120) ** 2 + 0.12 * np.log(h[i] / h[j]) ** 2 + 0.4 * (cls[i] != cls[j])
        w = np.round(np.exp(-np.minimum(d, 40)), 9)
    return np.where((side[i] != side[j]) & ok[i] & ok[j], w, 0.0)


def side_bits(side: np.ndarray) -> np.ndarray:
    """A bit for each side, numbered by their values; at most 62 sides."""
    names, code = np.unique(side, return_inverse=True)
    if len(names) > 62:
        raise ValueError(f"{len(names)} sides in one batch: at most 62 have a bit of their own")
    return np.left_shift(np.int64(1), code.reshape(side.shape).astype(np.int64))


def agglomerate_many(side: np.ndarray, weight: np.ndarray, ok: np.ndarray, cut: float, cap: int) -> np.ndarray:
    """Labels (tree, node) of ``agglomerate`` by mean linkage: every tree takes its next join in the same step."""
    trees, nodes = ok.shape
    z, label = np.arange(nodes), np.tile(np.arange(nodes), (trees, 1))
    total, mask, size, alive = weight.copy(), side_bits(side), ok.astype(np.int64), ok.copy()
    able = ok[:, :, None] & ok[:, None, :] & ((mask[:, :, None] & mask[:, None, :]) == 0) & (z[:, None] < z) & (cap >= 2)
    link = np.where(able & (total >= cut), total, -np.inf)
    where = np.arange(trees)  # trees still at work
    while len(where):
        best = link.reshape(len(where), -1).argmax(axis=1)  # of equal links the first: smallest x, then y
        go = link.reshape(len(where), -1)[np.arange(len(where)), best] > -np.inf
        if go.sum() * 2 < len(where):  # most are done: go on with the rest alone
            where, total, mask, size, alive, link, best = where[go], total[go], mask[go], size[go], alive[go], link[go], best[go]
            go = np.ones(len(where), dtype=bool)
        g = np.flatnonzero(go)
        if not len(g):
            break
        x, y = np.divmod(best[g], nodes)
        total[g, x] += total[g, y]
        total[g, :, x] += total[g, :, y]
        mask[g, x] |= mask[g, y]
        size[g, x] += size[g, y]
        alive[g, y] = False
        own = label[where[g]]
        label[where[g]] = np.where(own == y[:, None], x[:, None], own)
        link[g, y], link[g, :, y] = -np.inf, -np.inf
        able = alive[g] & ((mask[g] & mask[g, x][:, None]) == 0) & (size[g] + size[g, x][:, None] <= cap)
        count = size[g] * size[g, x][:, None]
        after, before = total[g, x] / np.maximum(count, 1), total[g, :, x] / np.maximum(count, 1)
        link[g, x] = np.where(able & (z > x[:, None]) & (after >= cut), after, -np.inf)
        link[g, :, x] = np.where(able & (z < x[:, None]) & (before >= cut), before, -np.inf)
    return label


def union_find_many(side: np.ndarray, weight: np.ndarray, ok: np.ndarray, cut: float, cap: int) -> np.ndarray:
    """Labels (tree, node) of ``union_find`` over all pairs of at least ``cut``: every tree takes its next join in the same step.

    A join that is ruled out once stays so, since clusters only grow; so the next join is the strongest pair still allowed.
    """
    trees, nodes = ok.shape
    z, label = np.arange(nodes), np.tile(np.arange(nodes), (trees, 1))
    mask, size = side_bits(side), ok.astype(np.int64)  # of each node's cluster
    able = ok[:, :, None] & ok[:, None, :] & ((mask[:, :, None] & mask[:, None, :]) == 0) & (z[:, None] < z) & (cap >= 2)
    edge = np.where(able & (weight >= cut), weight, -np.inf)
    where, own = np.arange(trees), label.copy()
    while len(where):
        best = edge.reshape(len(where), -1).argmax(axis=1)  # of equal edges the first: smallest i, then j
        go = edge.reshape(len(where), -1)[np.arange(len(where)), best] > -np.inf
        label[where] = own
        where, own, mask, size, edge, best = where[go], own[go], mask[go], size[go], edge[go], best[go]
        g = np.arange(len(where))
        i, j = np.divmod(best, nodes)
        a, b = np.minimum(own[g, i], own[g, j])[:, None], np.maximum(own[g, i], own[g, j])[:, None]
        both, grown = (own == a) | (own == b), (mask[g, i] | mask[g, j])[:, None]
        own, mask, size = np.where(both, a, own), np.where(both, grown, mask), np.where(both, (size[g, i] + size[g, j])[:, None], size)
        bad = (own[:, :, None] == own[:, None, :]) | ((mask[:, :, None] & mask[:, None, :]) != 0) | (size[:, :, None] + size[:, None, :] > cap)
        edge[bad] = -np.inf
    return label
