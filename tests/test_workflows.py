"""Trios, the optimizer's outer loop, growing service and workflows."""

import os

import pytest
from pyspark.sql import functions as F

from arborspark.operators import optimize, trios
from arborspark.plans import store, workflows
from arborspark.plans.analog import bundle
from arborspark.plans.rebuild import rebuild
from arborspark.streaming import service
from tests.test_tree_engine import ANIMALS, NEWICK, SITES, vcf_text, write

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def animals(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("animals")
    return workflows.tree_from_text(spark, write(d / "t.nwk", NEWICK), write(d / "t.vcf", vcf_text()))


def test_tree_from_text(animals):
    assert animals.leaf.count() == len(ANIMALS) and sorted(r["pos"] for r in animals.event.collect()) == SITES


def test_place_extract_and_summarize(spark, animals, tmp_path):
    new = spark.createDataFrame([("ibis", p, 1, 8) for p in (30, 31, 40)] + [("ibis", 60, 1, 2), ("jay", 3, 1, 9)], "sample string, pos int, ref int, allele int")
    grown = workflows.placed(animals, new, f"file://{tmp_path}/placed")
    assert {r["node"] for r in grown.leaf.collect()} == {*ANIMALS, "ibis", "jay"}
    assert sorted(r["value"].split("\t")[:3] for r in spark.read.text(f"{tmp_path}/placed/placement_stats").collect())[0] == ["ibis", "1", "1"]
    assert {r["value"].split("\t")[0] for r in spark.read.text(f"{tmp_path}/placed/clades").collect()} == {"ibis", "jay"}
    assert store.load(spark, f"file://{tmp_path}/placed/tree").leaf.count() == 10
    part = workflows.extracted(grown, spark.createDataFrame([("ibis",), ("hen",), ("dog",)], "node string"), f"file://{tmp_path}/part")
    assert {r["node"] for r in part.leaf.collect()} == {"ibis", "hen", "dog"}
    workflows.summarized(grown, f"file://{tmp_path}/summary")
    assert spark.read.csv(f"{tmp_path}/summary/samples", sep="\t", header=True).count() == 10
    none = workflows.placed(animals, new, f"file://{tmp_path}/strict", max_parsimony=0)
    assert {r["node"] for r in none.leaf.collect()} - set(ANIMALS) <= {"jay"}
    hidden = workflows.masked(grown, spark.createDataFrame([(40,)], "pos int"))
    assert hidden.state.where("pos = 40").count() == 0 and hidden.event.where("pos = -40").count() >= 1


def test_optimizer_options(spark):
    """A leaf in the wrong place comes back; drift and doubling keep the score; a callback may forbid moves."""
    edges = spark.createDataFrame([("top", None), ("x", "top"), ("y", "top"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("e", "y")], "node string, parent string")
    events = spark.createDataFrame([("x", p, 1, 1, 2) for p in (1, 2, 3)] + [("e", p, 1, 1, 2) for p in (1, 2, 3)], "node string, pos int, ref int, par int, mut int")
    b = rebuild(edges, events)
    best = optimize.optimize(b, 1, rounds=6, doubling=True, drift=1)
    assert best.event.count() == 3
    assert optimize.optimize(b, 4, accept=lambda found: found.where("s <> 'e'")).event.count() in (3, 6)
    assert optimize.optimize(b, 4, accept=lambda found: found.limit(0)).event.count() == 6
    assert optimize.reassign(b).event.count() == 6
    assert optimize.optimize(b, 4, seconds=0.0).event.count() == 6


def test_interleaved_placement(spark, animals):
    new = spark.createDataFrame([("ibis", 30, 1, 8), ("jay", 3, 1, 8), ("kit", 10, 1, 8)], "sample string, pos int, ref int, allele int")
    grown = optimize.interleaved(animals, new, per_round=2)
    assert grown.leaf.count() == len(ANIMALS) + 3


def test_trio_merging(spark):
    rows = [("r", "d", "a", 1, 5, 10, 20), ("r", "d", "a", 4, 8, 15, 30), ("r", "d", "a", 8, 9, 28, 40), ("r", "d", "a", 100, 110, 10, 20), ("r", "d", "z", 1, 5, 10, 20)]
    got = trios.merge_overlapping(spark.createDataFrame(rows, "recomb string, donor string, acceptor string, start_lo int, start_hi int, end_lo int, end_hi int"))
    assert {tuple(r) for r in got.collect()} == {("r", "d", "a", 1, 9, 10, 40), ("r", "d", "a", 100, 110, 10, 20), ("r", "d", "z", 1, 5, 10, 20)}


def test_simulated_recombinants(spark):
    b = bundle(spark, SF)
    for cuts in (1, 3):
        found, states = trios.simulated(b, 12, cuts, 97, seed=3)
        rows = found.collect()
        assert len(rows) == 12 and all(len(r["cuts"]) == cuts and list(r["cuts"]) == sorted(r["cuts"]) for r in rows)
        assert [tuple(r) for r in trios.simulated(b, 12, cuts, 97, seed=3)[0].orderBy("recomb").collect()] == [tuple(r) for r in found.orderBy("recomb").collect()]
        hap = {}
        for r in b.state.where("mut <> ref").join(b.leaf.select("node"), "node").collect():
            hap.setdefault(r["node"], {})[r["pos"]] = r["mut"]
        want = {(r["recomb"], p, m) for r in rows for odd, leaf in ((1, r["donor"]), (0, r["acceptor"])) for p, m in hap.get(leaf, {}).items() if sum(c <= p for c in r["cuts"]) % 2 == odd}
        assert {(r["recomb"], r["pos"], r["allele"]) for r in states.collect()} == want
    with pytest.raises(ValueError):
        trios.simulated(b, 1, 5, 97)
    assert trios.simulated(b, 5, 1, 97, extra=4)[1].where("allele = ref").count() == 0


def test_growing_service(spark, animals, tmp_path):
    versions, inbox, outbox = f"file://{tmp_path}/trees", str(tmp_path / "in"), str(tmp_path / "out")
    store.save(animals, f"{versions}/version=0")
    os.makedirs(inbox)
    for name, pos in (("ibis", 30), ("jay", 3)):
        spark.createDataFrame([(name, pos, 1, 8)], service.SAMPLES).coalesce(1).write.mode("append").parquet(inbox)
    service.growing_service(spark, versions, inbox, outbox, str(tmp_path / "cp"), files_per_batch=1).awaitTermination(240)
    last = store.latest(spark, versions)
    assert last >= 2 and {r["node"] for r in store.load(spark, f"{versions}/version={last}").leaf.collect()} == {*ANIMALS, "ibis", "jay"}


def test_requests_and_time_limit(spark):
    lines = spark.createDataFrame([(0, "usher"), (1, "-v"), (2, ""), (3, "matutil"), (4, ""), (5, ""), (6, "stop")], "at int, value string")
    assert [r["words"] for r in service.requests(lines).orderBy("request").collect()] == [["usher", "-v"], ["matutil"], ["stop"]]
    assert service.within_time(spark, "quick", 60, lambda: spark.range(10).count()) == 10
    slow = F.udf(lambda x: __import__("time").sleep(20) or x, "long")
    with pytest.raises(TimeoutError):
        service.within_time(spark, "slow", 2, lambda: spark.range(4).select(slow("id")).collect())
