"""WF-1: end-to-end chains of operators. Alignment, downloads and external time trees are out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.operators import annotate, assign, calls, extract, grow, optimize, place, regions, report, translate, tree
from arborspark.plans import store
from arborspark.plans.analog import Bundle
from arborspark.plans.rebuild import rebuild
from arborspark.sinks import text as sink
from arborspark.sources import text as source


def tree_from_text(spark: SparkSession, newick: str, vcf: str) -> Bundle:
    """A tree and genotypes as text -> a bundle with assigned events."""
    node = source.levelled(source.read_newick(spark, newick))
    sites, genotypes = source.read_vcf(spark, vcf, changes_only=True)
    sets = source.leaf_states(sites, genotypes)
    events = assign.fitch(node, sets).join(sets.select("pos", "ref").distinct(), "pos")
    return rebuild(node.select("node", "parent"), events.select("node", "pos", "ref", "par", "mut"))


def placed(b: Bundle, samples: DataFrame, out: str, max_uncertainty: int = 1_000_000, max_parsimony: int = 1_000_000) -> Bundle:
    """New samples: statistics and clades as text, rejected ones left out, the others added to the tree, which is saved."""
    best = place.best(b, samples)
    judged = calls.verdicts(best, max_uncertainty, max_parsimony)
    calls.statistics_lines(best, calls.imputed_bases(b, samples, best)).select("value").write.text(f"{out}/placement_stats")
    calls.clade_lines(calls.clade_calls(b, place.minima(b, samples), best)).select("value").write.text(f"{out}/clades")
    grown = grow.place_all(b, samples.join(judged.where("not rejected").select("sample"), "sample", "left_semi"))
    store.save(grown, f"{out}/tree")
    return grown


def optimized(b: Bundle, radius: int = 4, rounds: int = 3) -> Bundle:
    """Placed trees are optimized and their states assigned anew."""
    return optimize.reassign(optimize.optimize(b, radius, rounds))


def extracted(b: Bundle, samples: DataFrame, out: str) -> Bundle:
    """A selection as a tree of its own, with its text formats."""
    edges, events = extract.prune(b, samples, keep=True)
    part = rebuild(edges, events.join(b.event.select("pos", "ref").distinct(), "pos").select("node", "pos", "ref", "par", "mut"))
    rows = tree.rotate(part.node).join(part.node.select("node", "level"), "node").select("node", "parent", "level", "child_ord")
    top = part.node.where("parent is null").select("node", "parent", "level", F.lit(1).alias("child_ord"))
    sink.newick(rows.union(top)).write.text(f"{out}/newick")
    sink.diff_lines(part.state.where("mut <> ref").join(part.leaf.select("node"), "node", "left_semi")).select("value").write.text(f"{out}/diff")
    return part


def summarized(b: Bundle, out: str) -> None:
    """The report tables as tab-separated text."""
    for name, table in (("samples", report.samples(b)), ("clades", report.clades(b)), ("mutations", report.mutations(b)), ("haplotypes", report.haplotypes(b)), ("node_stats", report.node_stats(b)), ("sample_clades", report.sample_clades(b))):
        sink.write_report(table, f"{out}/{name}")


def annotated(b: Bundle, members: DataFrame) -> DataFrame:
    """Clades given by samples -> the nodes they begin at, with their mutation paths."""
    found = annotate.by_samples(b, members)
    own = report.paths(Bundle(b.node.withColumn("is_leaf", F.lit(True)), b.event, b.closure, b.state))
    return found.join(own, "node", "left").select("clade", "node", F.coalesce("path", F.lit("")).alias("path"))


def introduced(b: Bundle, region: DataFrame) -> DataFrame:
    """Introductions of a region with the region's confidence at each."""
    return regions.introductions(b, region).join(regions.confidences(b, region).withColumnRenamed("node", "introduction"), "introduction")


def translated(b: Bundle, genes: DataFrame, reference: DataFrame) -> DataFrame:
    """Amino-acid changes of every node."""
    return translate.amino_changes(b.node, b.event, b.state, translate.codon_sites(genes), reference)


def masked(b: Bundle, sites: DataFrame) -> Bundle:
    """Sites masked everywhere; the tree's other tables follow."""
    event = extract.mask_sites(b.event, sites)
    return Bundle(b.node, event, b.closure, tree.state(b.closure, event.where("pos >= 0")))
