"""Regional confidences and the density filter against recursion."""

import random

import pytest
from pyspark.sql import functions as F

from arborspark.operators import regions
from tests.test_recombination import random_bundle


def pruned(order, kids, n, labelled, leaves, most, small):
    """The filter as a recursion over the tree."""
    exempt, gone = set(), set()

    def all_inner(v):
        if v in kids:
            exempt.add(v)
            for c in kids[v]:
                all_inner(c)

    def chop(v):
        if v in labelled or v in exempt:
            return
        if v not in kids:
            gone.add(v)
        for c in kids.get(v, []):
            chop(c)

    def visit(v):
        if v not in kids:
            return 1, n[v]
        if v in labelled and leaves[v] < small:
            all_inner(v)
        safe, count, events = v in exempt, 0, 0
        for c in kids[v]:
            if not safe and c not in kids:
                if n[c] > most:
                    gone.add(c)
                    continue
                a, e = 1, n[c]
            else:
                a, e = visit(c)
            count, events = count + a, events + e
        if not count:
            return 0, 0
        density = (n[v] / count + events) / count
        if density > most:
            chop(v)
            return 0, 0
        if density < 1 / most:
            exempt.add(v)
        return count, events + n[v]

    visit(order[0])
    return gone


@pytest.mark.parametrize("seed,most", [(1, 2.0), (2, 3.0), (3, 1.0)])
def test_density(spark, seed, most):
    b, parent, order, size, kids, event, _ = random_bundle(spark, seed, n=40)
    rng = random.Random(seed)
    labelled = set(rng.sample(order[1:], 4))
    n = {v: sum(1 for e in event if e[0] == v) for v in order}
    leaves = {v: sum(1 for w in order[i : i + size[v]] if w not in kids) for i, v in enumerate(order)}
    marked = type(b)(b.node.withColumn("c0", F.when(F.col("node").isin(sorted(labelled)), "L")), b.event, b.closure, b.state)
    got = {r["node"] for r in regions.dense_leaves(marked, most, small=6).collect()}
    assert got == pruned(order, {k: v for k, v in kids.items() if k}, n, labelled, leaves, most, 6)


def test_introductions(spark):
    from arborspark.plans.rebuild import rebuild

    edges = spark.createDataFrame([("root", None), ("x", "root"), ("a", "x"), ("b", "x"), ("c", "root"), ("d", "root")], "node string, parent string")
    event = spark.createDataFrame([("x", 1, 1, 1, 2), ("c", 2, 1, 1, 2)], "node string, pos int, ref int, par int, mut int")
    b = rebuild(edges, event)
    members = spark.createDataFrame([("a",), ("b",)], "node string")
    conf = {r["node"]: r["confidence"] for r in regions.confidences(b, members).collect()}
    # below the root: members at distance 1, another leaf (d) at 0
    assert conf == {"root": 0.0, "x": 1.0, "a": 1.0, "b": 1.0, "c": 0.0, "d": 0.0}
    assert {tuple(r) for r in regions.introductions(b, members).collect()} == {("a", "x"), ("b", "x")}
