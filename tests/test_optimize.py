"""Moves against recounted events, state assignment against all assignments, covers."""

import itertools
import random

from arborspark.operators import assign, optimize, select
from arborspark.plans.rebuild import rebuild
from tests.test_growth import states
from tests.test_recombination import random_bundle


def test_moves_add_up_and_keep_leaf_states(spark):
    # a and b share two events but hang apart
    edges = spark.createDataFrame([("root", None), ("x", "root"), ("a", "x"), ("c", "x"), ("y", "root"), ("b", "y"), ("e", "y")], "node string, parent string")
    event = spark.createDataFrame([("a", 1, 1, 1, 2), ("a", 2, 1, 1, 2), ("b", 1, 1, 1, 2), ("b", 2, 1, 1, 2), ("b", 3, 1, 1, 4), ("c", 5, 1, 1, 8), ("y", 9, 1, 1, 8)], "node string, pos int, ref int, par int, mut int")
    b = rebuild(edges, event)
    chosen = optimize.independent(b, optimize.moves(b, 6)).collect()
    assert [(r["s"], r["d"], r["delta"]) for r in chosen] == [("a", "b", -1)] or [(r["s"], r["d"], r["delta"]) for r in chosen] == [("b", "a", -1)]
    after = optimize.optimize(b, 6)
    assert after.event.count() == b.event.count() - 1 and states(after) == states(b)
    assert optimize.moves(b, 2).count() == 0


def test_rounds_on_a_random_tree(spark):
    b = random_bundle(spark, 12, n=25, sites=6)[0]
    chosen = optimize.independent(b, optimize.moves(b, 20)).collect()
    after = optimize.apply_moves(b, spark.createDataFrame(chosen), "m")
    assert chosen and after.event.count() == b.event.count() + sum(r["delta"] for r in chosen)
    assert states(after) == states(b)


def test_least_back_mutations(spark):
    """Every assignment of the inner nodes is tried."""
    parent = {"r": None, "u": "r", "v": "u", "w": "v", "a": "u", "b": "v", "c": "w", "d": "w", "e": "r"}
    level = {"r": 0, "u": 1, "e": 1, "v": 2, "a": 2, "w": 3, "b": 3, "c": 4, "d": 4}
    node = spark.createDataFrame([(n, p, level[n]) for n, p in parent.items()], "node string, parent string, level int")
    leaves, inner = ["a", "b", "c", "d", "e"], ["r", "u", "v", "w"]
    rng = random.Random(1)
    table = {pos: {v: rng.choice([1, 2, 1, 2, 4, 3]) for v in leaves} for pos in range(1, 25)}
    sets = spark.createDataFrame([(v, pos, 1, s) for pos, t in table.items() for v, s in t.items()], "node string, pos int, ref int, allele int")

    def cost(state):
        events = back = 0
        for v in parent:
            p = state[parent[v]] if parent[v] else 1
            if state[v] == p:
                continue
            events, at, above = events + 1, parent[v], None
            while at:
                q = state[parent[at]] if parent[at] else 1
                if state[at] != q:
                    above = q
                    break
                at = parent[at]
            back += above == state[v]
        return events, back

    got = {}
    for r in assign.least_back_mutations(node, sets).collect():
        got.setdefault(r["pos"], {})[r["node"]] = r["mut"]
    for pos, t in table.items():
        want = min(cost({**dict(zip(inner, i)), **dict(zip(leaves, j))}) for i in itertools.product([1, 2, 4, 8], repeat=4) for j in itertools.product(*([x for x in (1, 2, 4, 8) if x & t[v]] for v in leaves)))
        state = {}
        for v in sorted(parent, key=level.get):
            state[v] = got.get(pos, {}).get(v, state[parent[v]] if parent[v] else 1)
        assert all(state[v] & t[v] for v in leaves) and cost(state) == want


def test_cover_and_support(spark):
    b, parent, order, size, kids, *_ = random_bundle(spark, 3, n=25)
    leaves = [v for v in order if v not in kids]
    sets = select.cover(b, leaves, 5)
    assert all(any(q == v or v in s for q, s in sets.items()) for v in leaves) and all(len(s) <= 5 for s in sets.values())
    got = optimize.branch_support(b, b.leaf).collect()
    assert len(got) == len(leaves) and all(r["support"] >= 1 for r in got)
