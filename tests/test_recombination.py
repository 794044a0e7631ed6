"""Recombination search against brute force, and its filters on literal rows."""

import random

import pytest

from arborspark.operators import recombine, tree
from arborspark.plans.analog import Bundle


def random_bundle(spark, seed, n=40, sites=30):
    rng = random.Random(seed)
    parent = {f"v{i:02d}": (f"v{rng.randrange(i):02d}" if i else None) for i in range(n)}
    kids = {}
    for v, p in parent.items():
        kids.setdefault(p, []).append(v)
    order, level = [], {}

    def visit(v, k):
        level[v] = k
        order.append(v)
        for c in sorted(kids.get(v, [])):
            visit(c, k + 1)

    visit("v00", 0)
    size = {v: 1 for v in order}
    for v in reversed(order):
        if parent[v]:
            size[parent[v]] += size[v]
    state, event = {}, []
    for v in order:
        state[v] = dict(state[parent[v]]) if parent[v] else {}
        if not parent[v]:
            continue
        for pos in rng.sample(range(1, sites + 1), rng.choice([1, 2, 6])):
            mut = rng.choice([2, 4]) if rng.random() < 0.8 else 1
            if mut != state[v].get(pos, 1):
                event.append((v, pos, 1, state[v].get(pos, 1), mut))
                state[v][pos] = mut
    leaves = {v: sum(1 for w in order[i : i + size[v]] if w not in kids) for i, v in enumerate(order)}
    node = spark.createDataFrame([(v, parent[v], level[v], i, i + size[v] - 1, v not in kids, size[v], leaves[v], None, None) for i, v in enumerate(order)], "node string, parent string, level int, dfs long, dfs_end long, is_leaf boolean, size long, n_leaves long, c0 string, c1 string")
    events = spark.createDataFrame(event, "node string, pos int, ref int, par int, mut int")
    closed = tree.closure(node)
    return Bundle(node, events, closed, tree.state(closed, events)), parent, order, size, kids, event, state


def brute(parent, order, size, kids, event, state, cands, least, improvement, min_nodes):
    own = {}
    for v, pos, _, _, mut in event:
        own.setdefault(v, {})[pos] = mut
    found = []
    for c in cands:
        hap = {p: m for p, m in state[c].items() if m != 1}
        ps, orig = sorted(hap), len(own.get(c, {}))
        at = order.index(c)
        below = set(order[at : at + size[c]])
        need = {}
        for v in order:
            if v in below or size[v] < min_nodes:
                continue
            base, uniq = dict(state[parent[v]] if parent[v] else state[v]), False
            for p, m in own.get(v, {}).items():
                if hap.get(p, 1) == m:
                    base[p] = m
                else:
                    uniq = True
            need[v] = ({p for p in set(base) | set(hap) if base.get(p, 1) != hap.get(p, 1)}, v not in kids or uniq)
        rows = []
        for i in range(len(ps)):
            for j in range(i + 1, len(ps) + 1):
                if j >= len(ps) or j - i < least or len(ps) - (j - i) < least:
                    continue
                lo, hi = ps[i], ps[j - 1]
                inside = sorted((sum(lo <= p <= hi for p in s), v) for v, (s, _) in need.items())
                outside = sorted((sum(not lo <= p <= hi for p in s), v) for v, (s, _) in need.items())
                pick = next(((d, a) for d in inside for a in outside if d[1] != a[1] and d[0] + a[0] + improvement <= orig), None)
                if pick:
                    d, a = pick
                    dh = {p for p, m in state[d[1]].items() if m != 1}
                    only = dh ^ set(ps)
                    left = ps[i - 1] if i else 0
                    start = max([left] + [p for p in only if left < p <= lo])
                    end = min([recombine.OPEN] + [p for p in only if p > hi])
                    rows.append([d[1], a[1], d[0] + a[0], start, lo, hi, end])
        for x, y, same in ((5, 6, (0, 1, 2, 3, 4)), (3, 4, (0, 1, 2, 5, 6))):
            rows.sort(key=lambda r: (r[x], r[y]))
            i = 0
            while i < len(rows):
                j = i + 1
                while j < len(rows):
                    if all(rows[i][k] == rows[j][k] for k in same) and rows[i][y] == rows[j][x]:
                        rows[i][y] = rows[j][y]
                        del rows[j]
                    else:
                        j += 1
                i += 1
        found += [(c, r[3], r[4], r[5], r[6], r[0], need[r[0]][1], len(need[r[0]][0]), r[1], need[r[1]][1], len(need[r[1]][0]), orig, min(orig, len(need[r[0]][0]), len(need[r[1]][0])), r[2]) for r in rows]
    return sorted(found)


@pytest.mark.parametrize("seed", [3, 8])
def test_search_equals_brute_force(spark, seed):
    b, *plain = random_bundle(spark, seed)
    cands = plain[1][5:30]
    got = recombine.search(b, spark.createDataFrame([(c,) for c in cands], "node string"), min_events=2, improvement=1, min_nodes=2, min_range=0)
    cols = ["recomb", "start_lo", "start_hi", "end_lo", "end_hi", "donor", "donor_sibling", "donor_parsimony", "acceptor", "acceptor_sibling", "acceptor_parsimony", "original_parsimony", "min_starting_parsimony", "recomb_parsimony"]
    rows = sorted(tuple(r[c] for c in cols) for r in got.collect())
    want = brute(*plain, cands, 2, 1, 2)
    assert want and rows == want


def test_walks_and_siblings(spark):
    trios = spark.createDataFrame([("t", "r", "d", True, "a", False)], "trio string, recomb string, donor string, donor_sibling boolean, acceptor string, acceptor_sibling boolean")
    calls = spark.createDataFrame([("r", 1, 2, 1), ("d", 1, 2, 1), ("r", 30, 2, 1), ("dp", 30, 2, 1), ("r", 40, 4, 1), ("a", 40, 4, 1), ("a", 70, 8, 1), ("d", 70, 8, 1), ("d", 90, 2, 1)], "node string, pos int, mut int, ref int")
    parent = spark.createDataFrame([("d", "dp"), ("a", "ap")], "node string, parent string")
    sites = recombine.informative_sites(trios, calls, parent)
    # at 70 neither matches but the donor's parent does; at 90 the donor's parent matches too
    assert sorted(map(tuple, sites.collect())) == [("t", 1, "A"), ("t", 30, "A"), ("t", 40, "B"), ("t", 70, "A")]
    w = recombine.walks(sites).first()
    assert (w["seq"], w["n_a"], w["n_b"], w["a_span"], w["b_span"]) == ("AABA", 3, 1, 69, 0)
    assert recombine.not_clustered(recombine.walks(sites)).count() == 0


def test_empirical_p(spark):
    found = spark.createDataFrame([("x", 10, 5), ("y", 10, 1), ("z", 4, 0), ("w", 10, 8)], "recomb string, min_starting_parsimony int, recomb_parsimony int")
    null = spark.createDataFrame([(10, 0, 90), (10, 4, 6), (10, 6, 4)], "parsimony int, improvement int, n long")
    got = {r["recomb"]: (r["total"], r["tail"]) for r in recombine.empirical_p(found, null).collect()}
    assert got == {"x": (100, 4), "y": (100, 0), "z": (None, None)}


def test_circular(spark):
    rows = [("1", "a", "b", "c", 0.1, 5, 9), ("2", "b", "a", "c", 0.2, 5, 9), ("3", "a", "b", "z", 0.3, 1, 1), ("4", "q", "b", "c", 0.5, 1, 1), ("5", "e", "c", "f", 0.9, 1, 1)]
    got = recombine.drop_circular(spark.createDataFrame(rows, "trio string, recomb string, donor string, acceptor string, p double, n_sites int, leaves int"))
    # 4 loses to 2 (they share b, the recombinant of 2, and c) although 2 itself loses to 1
    assert sorted(r["trio"] for r in got.collect()) == ["1", "5"]
