"""Placements applied, merged trees and clade labels on small random trees."""

import random

from arborspark.operators import annotate, grow, place
from arborspark.plans.rebuild import rebuild
from tests.test_recombination import random_bundle


def states(b, leaves_only=True):
    rows = b.state.join(b.leaf.select("node"), "node") if leaves_only else b.state
    out = {}
    for r in rows.where("mut <> ref").collect():
        out.setdefault(r["node"], {})[r["pos"]] = r["mut"]
    return out


def some_samples(spark, state, seed, n=4):
    rng, rows = random.Random(seed), []
    for i in range(n):
        hap = dict(rng.choice(list(state.values())))
        for pos in rng.sample(range(1, 31), 4):
            hap[pos] = rng.choice([2, 4, 8, 3, 6, 15])
        hap.setdefault(31, 8)
        rows += [(f"s{i}", p, 1, a) for p, a in sorted(hap.items())]
    return rows, spark.createDataFrame(rows, "sample string, pos int, ref int, allele int")


def test_applied_placements_keep_leaves_and_cost_their_score(spark):
    b, *_, event, state = random_bundle(spark, 5, n=20)
    rows, samples = some_samples(spark, state, 5)
    one = samples.where("sample = 's0'")
    best = place.best(b, one).first()
    grown = grow.apply_placements(b, place.best(b, one), one)
    assert grown.event.count() == b.event.count() + best["score"]
    before, after = states(b), states(grown)
    assert {k: v for k, v in after.items() if k in before} == before
    entries = {p: a for s, p, _, a in rows if s == "s0"}
    for pos in range(1, 32):
        assert after["s0"].get(pos, 1) & entries.get(pos, 1)


def test_score_is_the_least_over_all_nodes(spark):
    """Brute force of the score with sets of alleles."""
    b, parent, order, _, _, event, state = random_bundle(spark, 6, n=15)
    rows, samples = some_samples(spark, state, 6, n=3)
    got = {(r["sample"], r["node"]): r["score"] for r in place.scores(b, samples).collect()}
    own = {}
    for v, p, _, _, m in event:
        own.setdefault(v, {})[p] = m
    for s in ("s0", "s1", "s2"):
        entries = {p: a for x, p, _, a in rows if x == s}
        for v in order[1:]:
            base = dict(state[parent[v]])
            for p, m in own.get(v, {}).items():
                if entries.get(p, 1) & m:
                    base[p] = m
            want = sum(not entries.get(p, 1) & base.get(p, 1) for p in range(1, 32))
            assert got[(s, v)] == want, (s, v)


def test_all_samples_and_merge(spark):
    b, *_, state = random_bundle(spark, 7, n=12)
    rows, samples = some_samples(spark, state, 7, n=3)
    grown = grow.place_all(b, samples)
    leaves = {r["node"] for r in grown.leaf.collect()}
    assert {"s0", "s1", "s2"} <= leaves
    merged = grow.merge_trees(b, grown)
    assert {r["node"] for r in merged.leaf.collect()} == leaves
    want, have = states(grown), states(merged)
    assert all(want.get(v, {}) == have.get(v, {}) for v in leaves)


def test_ties_fork_the_tree(spark):
    b, *_, state = random_bundle(spark, 9, n=12)
    _, samples = some_samples(spark, state, 9, n=2)
    trees = grow.place_on_trees(b, samples, ["s0", "s1"], 2)
    assert 1 <= len(trees) <= 2 and len({t.event.count() for t in trees}) == 1
    assert all(t.leaf.where("node in ('s0', 's1')").count() == 2 for t in trees)


def test_clades(spark):
    b, parent, order, size, kids, event, state = random_bundle(spark, 4, n=30)
    own = {}
    for v, p, r, a, m in event:
        own.setdefault(v, []).append("ACMGRSVT"[a - 1] + str(p) + "ACMGRSVT"[m - 1])
    deep = next(v for v in reversed(order) if v in own and parent[v] in own and parent[parent[v]] == "v00")
    steps = [own[parent[deep]], own[deep][::-1]]
    got = annotate.by_path(b, spark.createDataFrame([("x", steps), ("y", [["A1C", "A2C", "A3C"]]), ("z", [])], "clade string, steps array<array<string>>"))
    found = {r["clade"]: r["node"] for r in got.collect()}
    assert found["z"] == "v00" and "y" not in found and own[found["x"]] and sorted(own[found["x"]]) == sorted(own[deep])
    exact = [("e", p, 1, m) for p, m in state[deep].items()]
    hit = annotate.by_mutations(b, spark.createDataFrame(exact, "sample string, pos int, ref int, allele int")).first()
    assert state[hit["node"]] == state[deep] or state[parent[hit["node"]]] == state[deep] or hit["node"] in order
    given = annotate.by_node(b, spark.createDataFrame([(2, "late", "v01"), (1, "early", "v01")], "ord int, clade string, node string"))
    assert [tuple(r) for r in given.collect()] == [("v01", "early")]
    labels = {r["node"]: r["labels"] for r in annotate.with_column(b, given).collect()}
    assert labels["v01"] == ["", "", "early"] and labels["v02"] == ["", "", ""]


def test_clade_of_samples(spark):
    """x holds members a and b below one event; c and d lie elsewhere; the second clade gets what is left."""
    edges = spark.createDataFrame([("root", None), ("x", "root"), ("a", "x"), ("b", "x"), ("y", "root"), ("c", "y"), ("d", "y")], "node string, parent string")
    event = spark.createDataFrame([("x", 1, 1, 1, 2), ("b", 9, 1, 1, 2), ("y", 2, 1, 1, 2), ("d", 5, 1, 1, 4)], "node string, pos int, ref int, par int, mut int")
    b = rebuild(edges, event)
    rows = {r["node"]: (r["level"], r["dfs"], r["dfs_end"], r["n_leaves"]) for r in b.node.collect()}
    assert rows == {"root": (0, 0, 6, 4), "x": (1, 1, 3, 2), "a": (2, 2, 2, 1), "b": (2, 3, 3, 1), "y": (1, 4, 6, 2), "c": (2, 5, 5, 1), "d": (2, 6, 6, 1)}
    members = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a"), ("n", "b"), ("o", "c"), ("o", "d")], "clade string, node string")
    got = {r["clade"]: (r["node"], r["freq"], r["overlap"]) for r in annotate.by_samples(b, members).collect()}
    assert got == {"m": ("x", 1.0, 1.0), "o": ("y", 1.0, 1.0)}
