"""Text sinks: lines as tables, ready for ``write.text``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions.nucleotides import letter, literal
from arborspark.plans.scratch import materialize
from arborspark.sources.text import levelled


def vcf_lines(genotypes: DataFrame, chrom: str = "chr1", with_genotypes: bool = True) -> DataFrame:
    """SK-1: ``genotypes(sample, ord, pos, ref, allele)`` -> (pos, value); sites without alternatives are left out.

    Alternatives stand in order of their code (QX-1); columns in order of ``ord``; AC and AN count samples. QX-18: the
    reference column is the stored reference. Without genotypes a line ends after the counts.
    """
    alts = genotypes.where("allele <> ref and allele <> 15").groupBy("pos").agg(F.array_sort(F.collect_set("allele")).alias("alts"))
    counts = genotypes.where("allele <> ref and allele <> 15").groupBy("pos", "allele").agg(F.count(F.lit(1)).alias("n")).groupBy("pos").agg(F.array_sort(F.collect_list(F.struct("allele", "n"))).alias("ac"))
    call = F.when(F.col("allele") == 15, ".").when(F.col("allele") == F.col("ref"), "0").otherwise(F.array_position("alts", F.col("allele")).cast("string"))
    rows = genotypes.join(alts, "pos").groupBy("pos", "ref", "alts").agg(F.array_sort(F.collect_list(F.struct("ord", call.alias("gt")))).alias("g")).join(counts, "pos")
    text = F.array_join(F.transform("alts", letter), ",")
    ids = F.array_join(F.transform("alts", lambda a: F.concat(letter(F.col("ref")), F.col("pos").cast("string"), letter(a))), ",")
    info = F.concat(F.lit("AC="), F.array_join(F.transform("ac", lambda x: x["n"].cast("string")), ","), F.lit(";AN="), F.size("g"))
    cells = [F.lit(chrom), F.col("pos").cast("string"), ids, letter(F.col("ref")), text, F.lit("."), F.lit("."), info]
    if with_genotypes:
        cells += [F.lit("GT"), F.array_join(F.transform("g", lambda x: x["gt"]), "\t")]
    return rows.select("pos", F.concat_ws("\t", *cells).alias("value"))


def write_vcf(genotypes: DataFrame, path: str, chrom: str = "chr1", with_genotypes: bool = True, compressed: bool = False) -> None:
    """SK-1: lines sorted by position below one header, as text files in order of their names; gzip if asked."""
    spark = genotypes.sparkSession
    names = genotypes.select("sample", "ord").distinct().agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sample"))), lambda s: s["sample"]), "\t").alias("n"))
    fixed = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"
    title = F.concat(F.lit(fixed + "\tFORMAT\t"), "n") if with_genotypes else F.lit(fixed)
    head = names.select(F.explode(F.array(F.struct(F.lit(-2).alias("pos"), F.lit("##fileformat=VCFv4.2").alias("value")), F.struct(F.lit(-1).alias("pos"), title.alias("value")))).alias("r")).select("r.*")
    lines = head.unionByName(materialize(vcf_lines(genotypes, chrom, with_genotypes), "vcf-lines"))
    lines.repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.option("compression", "gzip" if compressed else "none").text(path)


def write_report(table: DataFrame, path: str, *order: str) -> None:
    """SK-7: tab-separated text with a header, sorted if asked."""
    rows = table.orderBy(*order) if order else table
    rows.write.csv(path, sep="\t", header=True, emptyValue="")


def diff_lines(haplotypes: DataFrame) -> DataFrame:
    """SK-2: ``(node, pos, mut)`` -> (node, value): a header and a line for each change, by position."""
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mut"))), lambda s: F.concat(F.lower(letter(s["mut"])), F.lit("\t"), s["pos"].cast("string"))), "\n")
    return haplotypes.groupBy("node").agg(line.alias("l")).select("node", F.concat(F.lit(">"), "node", F.lit("\n"), "l").alias("value"))


def newick(node: DataFrame, lengths: str | None = None, inner_labels: bool = False) -> DataFrame:
    """SK-4: (node, parent, level, child_ord[, length]) -> one row (value), folded by level from the leaves.

    ``lengths`` names the column of branch lengths (event counts, or those that were read); inner names are
    written if asked.
    """
    top = node.agg(F.max("level")).first()[0]
    tail = F.when(F.col(lengths).isNotNull(), F.concat(F.lit(":"), F.format_string("%s", lengths))).otherwise("") if lengths else F.lit("")
    below = None
    for level in range(top, -1, -1):
        here = node.where(F.col("level") == level).withColumn("_tail", tail).select("node", "parent", "child_ord", "_tail")
        if below is None:
            here = here.select("node", "parent", "child_ord", F.concat("node", "_tail").alias("value"))
        else:
            kids = below.groupBy(F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_ord", "value"))), lambda s: s["value"]), ",").alias("k"))
            inner = F.concat(F.lit("("), "k", F.lit(")"), F.col("node") if inner_labels else F.lit(""))
            here = here.join(kids, "node", "left").select("node", "parent", "child_ord", F.concat(F.when(F.col("k").isNull(), F.col("node")).otherwise(inner), "_tail").alias("value"))
        below = materialize(here, "newick")
    return below.select(F.concat("value", F.lit(";")).alias("value"))


def newick_each(edges: DataFrame) -> DataFrame:
    """SK-10: ``edges(subtree, node, parent)`` -> (subtree, value): the newick text of each subtree, children by name; names hold no slash."""
    name = lambda c: F.when(F.col(c).isNotNull(), F.concat("subtree", F.lit("/"), c)).alias(c)
    rows = levelled(edges.select(name("node"), name("parent")))
    order = F.row_number().over(W.partitionBy("parent").orderBy("node"))
    text = newick(rows.withColumn("child_ord", F.when(F.col("parent").isNull(), 1).otherwise(order)))
    return text.select(F.regexp_extract("value", r"([^(),:;/]+)/", 1).alias("subtree"), F.regexp_replace("value", r"[^(),:;/]+/", "").alias("value"))


def sequences(reference: str, alleles: DataFrame) -> DataFrame:
    """SK-11: ``alleles(sample, pos, allele)`` (positions from 1) -> (name, seq): the reference with each sample's letters put in."""
    held = alleles.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("pos", letter(F.col("allele")).alias("c")))).alias("m"))
    base = F.transform(F.split(F.lit(reference), ""), lambda c, i: F.coalesce(F.element_at("m", i + 1), c))
    return held.select(F.col("sample").alias("name"), F.array_join(base, "").alias("seq"))


def rooted_reference(reference: str, root_events: DataFrame) -> DataFrame:
    """SK-12: one row (name, seq): the reference with the events of the root."""
    return sequences(reference, root_events.select(F.lit("root").alias("sample"), "pos", F.col("mut").alias("allele")))


def renamed_fasta(seqs: DataFrame, condensed: DataFrame) -> DataFrame:
    """SK-12: sequences of ``condensed(node, members)`` once per condensed leaf under its name, others as they are."""
    first = condensed.select(F.col("node").alias("new"), F.explode("members").alias("name")).withColumn("one", F.min("name").over(W.partitionBy("new")))
    return seqs.join(first, "name", "left").where("new is null or name = one").select(F.coalesce("new", "name").alias("name"), "seq")


def write_subtrees(event: DataFrame, members: DataFrame, trees: DataFrame, path: str) -> None:
    """SK-10: below ``path``, in folders by subtree: newick text of ``trees(subtree, value)``, the events on it, and which sample is in which subtree."""
    trees.write.partitionBy("subtree").text(f"{path}/trees")
    line = F.concat_ws("\t", "node", literal(F.col("par"), F.col("pos"), F.col("mut")))
    event.join(members, "node").select("subtree", line.alias("value")).write.partitionBy("subtree").text(f"{path}/mutations")
    write_report(members.select("node", "subtree"), f"{path}/assignments", "node", "subtree")


def node_names(node: DataFrame) -> DataFrame:
    """SK-13: (value): names in dfs order."""
    return node.orderBy("dfs").select(F.col("node").alias("value"))


def fasta_lines(seqs: DataFrame, width: int = 120) -> DataFrame:
    """SK-12: (name, seq) -> (name, value) wrapped at ``width``."""
    return seqs.select("name", F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")).alias("value"))
