"""Small literal fixtures for comparison, translation and revision operators."""

import pytest
from pyspark.sql import functions as F

from arborspark.operators import compare, revise, translate, tree


def test_reversion_moves_to_great_grandparent(spark):
    # n > a > b > r with r undoing a; x hangs below r
    node = spark.createDataFrame([("n", None, 5), ("a", "n", 4), ("b", "a", 3), ("r", "b", 2), ("x", "r", 1)], "node string, parent string, size long")
    event = spark.createDataFrame([("a", 7, 1, 1, 2), ("b", 9, 4, 4, 8), ("r", 7, 1, 2, 1), ("x", 3, 1, 1, 8)], "node string, pos int, ref int, par int, mut int")
    moved, events = revise.fix_reversions(node, event)
    assert {r["node"]: r["parent"] for r in moved.collect()} == {"n": None, "a": "n", "b": "a", "r": "n", "x": "r"}
    assert sorted(tuple(r)[:2] + tuple(r)[3:] for r in events.collect()) == [("a", 7, 1, 2), ("b", 9, 4, 8), ("r", 9, 4, 8), ("x", 3, 1, 8)]
    assert revise.grandparent_reversions(node, event, min_below=2).count() == 0


def test_reversion_rows_at_a_table(spark):
    """The query's SQL has rows only where such chains exist; two planted chains, one short of an event."""
    node = spark.createDataFrame([("n", None, 9), ("a", "n", 8), ("b", "a", 7), ("r", "b", 1), ("s", "b", 1)], "node string, parent string, size long")
    event = spark.createDataFrame([("a", 7, 1, 1, 2), ("b", 9, 4, 4, 8), ("r", 7, 1, 2, 1), ("s", 7, 1, 2, 1), ("s", 8, 1, 1, 2)], "node string, pos int, ref int, par int, mut int")
    assert [r["node"] for r in revise.grandparent_reversions(node, event).collect()] == ["r"]


def test_amino_changes_on_both_strands(spark):
    # ATGGCC: forward M A; the reverse gene reads GGC CAT
    sites = translate.codon_sites(spark.createDataFrame([("f", 1, 1, 6, "+"), ("v", 1, 1, 6, "-")], "gene string, ord int, start int, stop int, strand string"))
    reference = spark.createDataFrame([(i + 1, 1 << "ACGT".index(c)) for i, c in enumerate("ATGGCC")], "pos int, ref int")
    node = spark.createDataFrame([("root", None), ("p", "root"), ("q", "p")], "node string, parent string")
    event = spark.createDataFrame([("p", 1, 1, 1, 4), ("q", 1, 1, 4, 1), ("q", 2, 8, 8, 2)], "node string, pos int, ref int, par int, mut int")
    state = tree.state(tree.closure(node), event)
    got = {(r["node"], r["gene"]): (r["codon"], r["old_codon"], r["new_codon"], r["old_aa"], r["new_aa"]) for r in translate.amino_changes(node, event, state, sites, reference).collect()}
    assert got == {
        ("p", "f"): (1, "ATG", "GTG", "M", "V"),
        ("p", "v"): (2, "CAT", "CAC", "H", "H"),
        ("q", "f"): (1, "GTG", "ACG", "V", "T"),
        ("q", "v"): (2, "CAC", "CGT", "H", "R"),
    }


def test_codon_numbers_run_on_and_cut_codons_go(spark):
    sites = translate.codon_sites(spark.createDataFrame([("g", 1, 10, 16, "+"), ("g", 2, 30, 32, "+")], "gene string, ord int, start int, stop int, strand string"))
    assert sorted((r["codon"], r["i"], r["pos"]) for r in sites.collect()) == [(1, 0, 10), (1, 1, 11), (1, 2, 12), (2, 0, 13), (2, 1, 14), (2, 2, 15), (3, 0, 30), (3, 1, 31), (3, 2, 32)]


def test_dictionary_leaves_out_empty(spark):
    got = translate.dictionary(spark.createDataFrame([("b",), (None,), ("",), ("a",), ("b",)], "v string"), "v")
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("b", 2)]


def test_genotypes(spark):
    rows = "sample string, pos int, allele int"
    a = spark.createDataFrame([("s", 1, 1), ("s", 2, 3), ("t", 1, 1)], rows)
    b = spark.createDataFrame([("s", 1, 2), ("s", 2, 2), ("u", 1, 1)], rows)
    assert [tuple(r) for r in compare.genotype_conflicts(a, b).collect()] == [("s", 1, 1, 2)]
    assert sorted(map(tuple, compare.missing_samples(a, b).collect())) == [("t", "right"), ("u", "left")]


def test_regions_and_masks(spark):
    # ((a, b)x, (c, d)y)root with regions 1 1 2 1
    node = spark.createDataFrame([("root", None, False, 4), ("x", "root", False, 2), ("y", "root", False, 2), ("a", "x", True, 1), ("b", "x", True, 1), ("c", "y", True, 1), ("d", "y", True, 1)], "node string, parent string, is_leaf boolean, n_leaves long")
    closed = tree.closure(node)
    regions = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2"), ("d", "1")], "node string, region string")
    assert revise.association_index(node, closed, regions).first()[0] == pytest.approx(0.5 / 2 + 0.25 / 8)
    assert dict(map(tuple, revise.monophyletic_sizes(node, closed, regions).collect())) == {"1": 2, "2": 1}
    event = spark.createDataFrame([("x", 1), ("root", 2), ("d", 3)], "node string, pos int")
    masked = revise.mask_private(node, closed, event, regions.where("node in ('a', 'b')"))
    assert {r["pos"] for r in masked.where("masked").collect()} == {1}
    assert masked.agg(F.count(F.lit(1))).first()[0] == 3
