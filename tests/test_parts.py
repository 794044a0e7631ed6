"""Parts of trees, placement outputs, clade files, text sinks and stored bundles, on small own trees."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from arborspark.functions import nucleotides as nuc
from arborspark.operators import assign, calls, extract, place, select, tree
from arborspark.plans import store
from arborspark.plans.analog import bundle
from arborspark.plans.rebuild import rebuild
from arborspark.sinks import text as sink
from arborspark.sources import text as source

SF = "/root/testdata/sf0.001"
EDGES = [("top", None), ("u", "top"), ("v", "top"), ("w", "u"), ("k1", "w"), ("k2", "w"), ("k3", "u"), ("k4", "v"), ("k5", "v"), ("k6", "top")]
EVENTS = [("u", 5, 1, 1, 2), ("w", 6, 1, 1, 4), ("k1", 5, 1, 2, 1), ("k1", 9, 2, 2, 8), ("v", 7, 4, 4, 1), ("k5", 7, 4, 1, 4), ("k5", 8, 1, 1, 2)]


@pytest.fixture(scope="module")
def small(spark):
    edges = spark.createDataFrame([(n, p, "C1" if n == "u" else "C2" if n == "v" else None, "D" if n == "w" else None) for n, p in EDGES], "node string, parent string, c0 string, c1 string")
    return rebuild(edges, spark.createDataFrame(EVENTS, "node string, pos int, ref int, par int, mut int"))


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_prune_and_restrict(spark, small):
    keep = spark.createDataFrame([("k1",), ("k3",), ("k5",)], "node string")
    edges, events = extract.prune(small, keep, keep=True)
    assert pairs(edges, "node", "parent") == {("top", None), ("u", "top"), ("k1", "u"), ("k3", "u"), ("k5", "top")}
    assert pairs(events, "node", "pos", "par", "mut") == {("u", 5, 1, 2), ("k1", 5, 2, 1), ("k1", 6, 1, 4), ("k1", 9, 2, 8), ("k5", 8, 1, 2)}
    assert pairs(extract.prune(small, keep)[0].where("node like 'k%'"), "node") == {("k2",), ("k4",), ("k6",)}
    assert pairs(extract.restrict(small, keep.withColumnRenamed("node", "sample"))[0], "node", "parent") == pairs(edges, "node", "parent")


def test_reroot_keeps_every_leaf_sequence(small):
    """States of all leaves stay the same when the root moves; a leaf stays a leaf."""
    want = pairs(small.state.join(small.leaf.select("node"), "node"), "node", "pos", "mut")
    for root in ("w", "v", "k5"):
        edges, events = tree.reroot(small.node, small.closure, small.event, root, "former")
        again = rebuild(edges, events)
        assert again.event.where("par = mut").count() == 0 and pairs(again.leaf, "node") >= pairs(small.leaf, "node")
        full = again.leaf.select("node").crossJoin(again.event.select("pos", "ref").distinct()).join(again.state.select("node", "pos", "mut"), ["node", "pos"], "left").withColumn("mut", F.coalesce("mut", "ref"))
        assert pairs(full.join(small.leaf.select("node"), "node", "left_semi"), "node", "pos", "mut") >= want, root


def test_sparse_fitch_is_least_with_ambiguous_leaves(spark, small):
    rng = random.Random(11)
    leaves = [n for n, _ in EDGES if n.startswith("k")]
    inner = [n for n, _ in EDGES if not n.startswith("k")]
    rows = [(leaf, pos, 2, rng.choice((1, 2, 2, 3, 6, 8, 15))) for leaf in leaves for pos in range(12)]
    table = spark.createDataFrame(rows, "node string, pos int, ref int, allele int")
    got = {r["pos"]: r["count"] for r in assign.fitch(small.node, table).groupBy("pos").count().collect()}
    for pos in range(12):
        own = {leaf: a for leaf, p, _, a in rows if p == pos}
        best = min(sum((s[p] if p else 2) & s.get(n, own.get(n)) == 0 for n, p in EDGES) for pick in itertools.product((1, 2, 4, 8), repeat=len(inner)) for s in [dict(zip(inner, pick))])
        assert got.get(pos, 0) == best, pos
    bounds = assign.boundary_alleles(small.node, table).collect()
    assert bounds and all(r["major"] & r["boundary"] == 0 and r["major"] for r in bounds)
    changed = spark.createDataFrame([(3,), (4,)], "pos int")
    event = assign.fitch(small.node, table).withColumn("ref", F.lit(2)).select("node", "pos", "ref", "par", "mut")
    assert pairs(assign.reassign(small.node, small.closure, event, changed, table), "node", "pos", "par", "mut") == pairs(event, "node", "pos", "par", "mut")


def test_bounded_search_equals_all_scores(spark):
    b = bundle(spark, SF)
    rng = random.Random(5)
    rows = {(f"s{i}", rng.randrange(97)): rng.choice((1, 2, 4, 8, 5, 15)) for i in range(30) for _ in range(i % 9 + 1)}
    samples = spark.createDataFrame([(s, p, 1 << p % 4, a) for (s, p), a in rows.items()], "sample string, pos int, ref int, allele int")
    scored = place.admissible(b, place.scores(b, samples))
    least = {r["sample"]: r["m"] for r in scored.groupBy("sample").agg(F.min("score").alias("m")).collect()}
    want = {(r["sample"], r["node"], r["score"], r["n_common"], r["n_unique"]) for r in scored.collect() if r["score"] == least[r["sample"]]}
    assert pairs(place.minima(b, samples), "sample", "node", "score", "n_common", "n_unique") == want


def test_neighbourhood_of_existing_samples(small):
    got = {r["sample"]: (r["epp"], r["neighbourhood"]) for r in calls.neighbourhoods(small, small.leaf.select("node")).collect()}
    assert set(got) == {f"k{i}" for i in range(1, 7)} and all(n >= 1 and (w > 0) == (n > 1) for n, w in got.values())


def test_cover_and_nearest_each(spark):
    b = bundle(spark, SF)
    targets = [r["node"] for r in b.leaf.orderBy("dfs").limit(40).collect()][::4]
    each = select.nearest_each(b, spark.createDataFrame([(t,) for t in targets], "target string"), 6)
    for t in targets[:3]:
        assert pairs(each.where(F.col("target") == t), "node") == pairs(select.nearest(b, t, 6), "node")
    found = select.cover(b, targets, 6)
    assert all(t in found or any(t in v for v in found.values()) for t in targets)


def test_subtrees(spark):
    b = bundle(spark, SF)
    targets = select.first(b.leaf, 2).select(F.col("node").alias("target"))
    anchor = spark.createDataFrame([("anchor",)], "node string")
    got = extract.subtree_members(b, targets, 10, anchors=anchor)
    assert {r["n"] for r in got.groupBy("subtree").agg(F.count(F.lit(1)).alias("n")).collect()} == {11}
    assert pairs(extract.subtree_members(b, targets, 10), "subtree", "node") == pairs(extract.subtree_members(b, targets, 10), "subtree", "node")


def test_clade_files(spark, tmp_path):
    def file(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert pairs(source.read_clade_samples(spark, file("s", "A\tx\n\nB\ty\n")), "clade", "sample") == {("A", "x"), ("B", "y")}
    with pytest.raises(Exception, match="two fields expected"):
        source.read_clade_nodes(spark, file("n", "A\tx\tz\n")).collect()
    paths = source.read_clade_paths(spark, file("p", "A\tA1C > C2G,T3A\n")).first()
    assert (paths["clade"], paths["steps"]) == ("A", [["A1C"], ["C2G", "T3A"]])
    text = "# comment\nA\tA1C > C2G,T3A\nB\tA C1G > A9T\nC\tB G1A\nroot\t\n"
    got = pairs(source.read_clade_mutations(spark, file("m", text)), "clade", "pos", "par", "mut")
    a = {(2, 2, 4), (3, 8, 1)}
    assert got == {("A", 1, 1, 2), *(("A", *x) for x in a), ("B", 1, 1, 4), ("B", 9, 1, 8), *(("B", *x) for x in a), ("C", 9, 1, 8), *(("C", *x) for x in a)}
    for bad, why in (("A\tA1C\nA\tA2C\n", "several lines"), ("A\tnonsense9\n", "no mutation")):
        with pytest.raises(Exception, match=why):
            source.read_clade_mutations(spark, file("b", bad)).collect()
    names = source.read_rename_map(spark, file("r", "k1\tone\nk9\tnine\n"))
    assert pairs(extract.rename(spark.createDataFrame([("k1", "k2")], "node string, parent string"), names, "node", "parent"), "node", "parent") == {("one", "k2")}


def test_metadata(spark):
    one = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "", "3")], "strain string, place string, n string")
    two = spark.createDataFrame([("a", "", "q"), ("c", "z", "r")], "strain string, place string, other string")
    got = extract.merge_metadata(one.coalesce(1), two)
    assert pairs(got, "strain", "place", "n", "other") == {("a", "x", "1", "q"), ("b", None, "3", None), ("c", "z", None, "r")}
    with pytest.raises(ValueError):
        extract.merge_metadata(one.withColumnRenamed("strain", "id"))
    joined = extract.with_metadata(spark.createDataFrame([("a", 1), ("d", 2)], "sample string, n int"), one.coalesce(1))
    assert pairs(joined, "sample", "n", "place", "n_meta") == {("a", 1, "x", "1"), ("d", 2, None, None)}


def test_edits_and_clean_up(spark, small):
    edges = small.node.select("node", "parent")
    rooted = extract.with_artificial_root(edges, small.event)
    assert rooted.count() == edges.count()  # the root carries no event
    assert pairs(extract.with_artificial_root(edges, small.event.withColumn("node", F.lit("top"))).where("parent is null"), "node") == {("root_above",)}
    nodes, events = extract.above_condensed(edges, small.event, spark.createDataFrame([("k1",), ("k2",)], "node string"))
    assert pairs(nodes.where("node like 'k1%'"), "node", "parent") == {("k1", "k1_above"), ("k1_above", "w")}
    assert events.where("node = 'k1'").count() == 0 and events.where("node = 'k1_above'").count() == 2
    blurred = small.event.withColumn("mut", F.when(F.col("node") == "k1", F.col("mut").bitwiseOR(F.when(F.col("pos") == 5, 2).otherwise(4))).otherwise(F.col("mut")))
    assert pairs(extract.clean_events(small.node, blurred).where("node = 'k1'"), "pos", "mut") == {(9, 4)}


def test_sequences_and_fasta(spark, small):
    leaf = small.state.where("node = 'k1' and mut <> ref").select(F.col("node").alias("sample"), "pos", F.col("mut").alias("allele"))
    assert pairs(sink.sequences("AAAAAAAAAA", leaf), "name", "seq") == {("k1", "AAAAAGAATA")}
    assert sink.rooted_reference("ACGT", spark.createDataFrame([(2, 8)], "pos int, mut int")).first()["seq"] == "ATGT"
    seqs = spark.createDataFrame([("a", "AC"), ("b", "AC"), ("c", "GT")], "name string, seq string")
    condensed = spark.createDataFrame([("ab", ["a", "b"])], "node string, members array<string>")
    assert pairs(sink.renamed_fasta(seqs, condensed), "name", "seq") == {("ab", "AC"), ("c", "GT")}


def test_stored_bundle(spark, small, tmp_path):
    path = f"file://{tmp_path}/version=0"
    assert store.latest(spark, f"file://{tmp_path}") == -1
    with pytest.raises(FileNotFoundError):
        store.load(spark, path)
    store.save(small, path)
    again = store.load(spark, path)
    assert pairs(again.event, "node", "pos", "mut") == pairs(small.event, "node", "pos", "mut") and store.latest(spark, f"file://{tmp_path}") == 0


def test_scalars(spark):
    row = spark.range(1).select(nuc.split_chars(F.lit("a,,b,"), ","), nuc.split_words(F.lit("  a \t b ")), nuc.is_valid(F.lit(1), F.lit(1)), nuc.log10_ratio(F.lit(100.0), F.lit(10.0))).first()
    assert (row[0], row[1], row[2], row[3]) == (["a", "", "b", ""], ["a", "b"], False, 1.0)
    points = spark.createDataFrame([(3, "A"), (5, "C")], "pos int, base string")
    assert [r["base"] for r in source.filled(points, 2, 6).orderBy("pos").collect()] == ["N", "A", "N", "C", "N"]


def test_within_radius(spark, small):
    assert pairs(tree.within(small.closure, spark.createDataFrame([("k3",)], "node string"), 2), "node") == {("k3",), ("u",), ("w",), ("top",)}


def test_enrichment_matches_an_exact_test_by_hand(spark):
    from fractions import Fraction
    from math import comb

    from arborspark.operators import report

    b = bundle(spark, SF)
    total = b.event.count()
    got = report.enrichment(b, 20, 3).collect()
    tests = report.literal_inside_outside(b, 20, 3).count()
    assert got and len({r["branch"] for r in got}) == len(got)
    for r in got[:20]:
        x, y, t, u = r["inside"], r["outside"], r["local_total"], total - r["local_total"]
        p = {k: comb(x + y, k) * comb(t + u, x + t - k) for k in range(max(0, x + t - t - u), min(x + y, x + t) + 1)}
        want = float(Fraction(sum(v for v in p.values() if v <= p[x]), comb(x + y + t + u, x + t)))
        assert abs(r["pvalue"] - want) < 1e-6 and abs(r["corrected_pvalue"] - want * tests) < 1e-4


def test_subtrees_as_text(spark, small, tmp_path):
    members = spark.createDataFrame([("A", "k1"), ("A", "k2"), ("A", "k5"), ("B", "k3"), ("B", "k6")], "subtree string, node string")
    edges = extract.induced_each(small, members)
    for name in "AB":
        alone = tree.induced(small.node, small.closure, small.event, members.where(F.col("subtree") == name).select("node"))[0]
        assert pairs(edges.where(F.col("subtree") == name), "node", "parent") == pairs(alone, "node", "parent")
    texts = {r["subtree"]: r["value"] for r in sink.newick_each(edges).collect()}
    assert texts == {"A": "(k5,(k1,k2));", "B": "(k6,k3);"} or texts == {"A": "(k5,(k1,k2));", "B": "(k3,k6);"}
    sink.write_subtrees(small.event, members, sink.newick_each(edges), f"file://{tmp_path}/s")
    assert {r["value"] for r in spark.read.text(f"{tmp_path}/s/trees/subtree=A").collect()} == {"(k5,(k1,k2));"}
    assert spark.read.text(f"{tmp_path}/s/mutations").where("subtree = 'A'").count() == 4
