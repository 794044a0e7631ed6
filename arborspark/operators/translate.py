"""Codons of genes on a reference, amino-acid changes of events, dictionary codes of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions import nucleotides as nuc
from arborspark.operators import tree


def codon_sites(genes: DataFrame) -> DataFrame:
    """TL-1: ``genes(gene, ord, start, stop, strand)`` -> (gene, strand, codon, i, pos).

    Positions count from 1. Forward codons go up from start, reverse ones down from stop; a codon that
    the segment cuts off is left out. Numbers run on over the segments of a gene in ``ord``.
    """
    sized = genes.withColumn("_n", F.expr("(stop - start + 1) div 3").cast("int"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("gene").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    each = sized.withColumn("_first", before).where("_n > 0").withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = each.withColumn("i", F.explode(F.array(*map(F.lit, range(3)))))
    step = F.col("_k") * 3 + F.col("i")
    pos = F.when(F.col("strand") == "-", F.col("stop") - step).otherwise(F.col("start") + step)
    return at.select("gene", "strand", (F.col("_first") + F.col("_k") + 1).cast("int").alias("codon"), "i", pos.cast("int").alias("pos"))


def amino_changes(node: DataFrame, event: DataFrame, state: DataFrame, sites: DataFrame, reference: DataFrame) -> DataFrame:
    """TL-2: (node, gene, codon, old_codon, new_codon, old_aa, new_aa); all events of a node in one codon count together.

    ``reference(pos, ref)`` gives the state where no event lies above. Silent changes are kept.
    """
    hit = event.select("node", "pos").join(sites.select("pos", "gene", "codon"), "pos").select("node", "gene", "codon").distinct()
    bases = hit.join(sites, ["gene", "codon"]).join(event.select("node", "pos", "par", "mut"), ["node", "pos"], "left")
    held = bases.join(node.select("node", "parent"), "node").join(reference.select("pos", F.col("ref").alias("_ref")), "pos")
    above = state.select(F.col("node").alias("parent"), "pos", F.col("mut").alias("_above"))
    known = held.join(above, ["parent", "pos"], "left").withColumn("_base", F.coalesce("_above", "_ref"))

    def side(allele: str) -> Column:
        letter = nuc.letter(F.coalesce(allele, "_base"))
        return F.when(F.col("strand") == "-", nuc.complement(letter)).otherwise(letter)

    def joined(name: str) -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", name))), lambda s: s[name]), "")

    codons = known.withColumns({"_old": side("par"), "_new": side("mut")}).groupBy("node", "gene", "codon").agg(joined("_old").alias("old_codon"), joined("_new").alias("new_codon"))
    return codons.withColumns({"old_aa": nuc.amino_acid(F.col("old_codon")), "new_aa": nuc.amino_acid(F.col("new_codon"))})


def dictionary(values: DataFrame, column: str) -> DataFrame:
    """TL-3: (value, code) with codes from 1 in the order of the distinct values; null and empty are 0."""
    distinct = values.select(F.col(column).alias("value")).where("value <> ''").distinct()
    return tree.ordered_index(distinct, ["value"], "code").select("value", (F.col("code") + 1).alias("code"))
