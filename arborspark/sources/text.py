"""Text sources: each reads lines with Spark and returns long tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions.nucleotides import allele, letter, parse_literal
from arborspark.plans.scratch import materialize


#: Tables of sample names of at most so many rows are broadcast.
NAMES = 200_000


def read_vcf(spark: SparkSession, path: str, changes_only: bool = False, skip: DataFrame | None = None, prefix: str = "") -> tuple[DataFrame, DataFrame]:
    """SC-1..4: (sites(pos, chrom, ref, alts), genotypes(pos, sample, allele)); plain or gzip text.

    Genotype 0 is the reference, k the k-th alternative, all else (``.``, out of range) is 15. With
    ``changes_only`` reference calls are dropped before samples are named, so rows grow with the changes. Samples
    of ``skip(sample)`` (known ones) are left out, names get ``prefix``.
    """
    lines = spark.read.text(path)
    header = lines.where("value like '#CHROM%'").select(F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 30)).alias("i", "sample"))
    cells = F.split("value", "\t")
    rows = lines.where("value not like '#%' and value <> ''").select(cells.alias("c"))
    sites = rows.select(F.col("c")[1].cast("int").alias("pos"), F.col("c")[0].alias("chrom"), F.col("c")[3].alias("ref"), F.split(F.col("c")[4], ",").alias("alts"))
    calls = rows.select(F.col("c")[1].cast("int").alias("pos"), F.col("c")[3].alias("ref"), F.split(F.col("c")[4], ",").alias("alts"), F.posexplode(F.slice("c", 10, 1 << 30)).alias("i", "gt"))
    k = F.regexp_extract("gt", r"^(\d+)", 1)
    if changes_only:
        calls = calls.where(k != "0")
    base = F.when(k == "", "N").when(k == "0", F.col("ref")).otherwise(F.coalesce(F.get("alts", k.cast("int") - 1), F.lit("N")))
    names = header.where("sample <> ''")
    if skip is not None:
        names = names.join(skip.select("sample"), "sample", "left_anti")
    names = names.withColumn("sample", F.concat(F.lit(prefix), "sample"))
    small = names.count() <= NAMES
    return sites, calls.join(F.broadcast(names) if small else names, "i").select("pos", "sample", allele(base).alias("allele"))


def unclear_calls(genotypes: DataFrame) -> DataFrame:
    """SC-3: (sample, unclear): calls of each sample that are no single base."""
    return genotypes.groupBy("sample").agg(F.sum((F.bit_count("allele") != 1).cast("long")).alias("unclear"))


def leaf_states(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """SC-4: (node, pos, ref, allele) for state assignment: each call with its site's reference."""
    return genotypes.join(sites.select("pos", allele(F.col("ref")).alias("ref")).distinct(), "pos").select(F.col("sample").alias("node"), "pos", "ref", "allele")


def normalized(sites: DataFrame, genotypes: DataFrame) -> DataFrame:
    """FN-15: (pos, alts, calls): alternatives in order of their letters, ``sample=base`` in order of the sample."""
    each = F.array_sort(F.collect_list(F.struct("sample", letter(F.col("allele")).alias("base"))))
    called = genotypes.groupBy("pos").agg(F.transform(each, lambda s: F.concat(s["sample"], F.lit("="), s["base"])).alias("calls"))
    return sites.select("pos", F.array_sort("alts").alias("alts")).join(called, "pos")


def filled(points: DataFrame, first: int, last: int) -> DataFrame:
    """FN-16: ``points(pos, base)`` -> every position of the range, N where there is no base."""
    spark = points.sparkSession
    every = spark.range(first, last + 1).select(F.col("id").cast("int").alias("pos"))
    return every.join(points, "pos", "left").select("pos", F.coalesce("base", F.lit("N")).alias("base"))


def read_records(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """SC-18: (record array<string>) of each line, read by fields and not by columns."""
    return spark.read.text(path).select(F.split("value", "\\Q" + sep + "\\E", -1).alias("record"))


def read_rename_map(spark: SparkSession, path: str) -> DataFrame:
    """SC-17: (old, new); blank lines are left out, a line of other than two fields is an error."""
    return _pairs(spark, path, "old", "new")


def _pairs(spark: SparkSession, path: str, one: str, two: str) -> DataFrame:
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.rtrim("value"), "\t", -1).alias("c"))
    cell = lambda i: F.when(F.size("c") == 2, F.col("c")[i]).otherwise(F.raise_error(F.concat(F.lit("two fields expected: "), F.array_join("c", "|"))))
    return rows.select(cell(0).alias(one), cell(1).alias(two))


def read_clade_samples(spark: SparkSession, path: str) -> DataFrame:
    """SC-14: (clade, sample)."""
    return _pairs(spark, path, "clade", "sample")


def read_clade_nodes(spark: SparkSession, path: str) -> DataFrame:
    """SC-14: (ord, clade, node) in order of the file."""
    return _pairs(spark, path, "clade", "node").select(F.monotonically_increasing_id().alias("ord"), "clade", "node")


def read_clade_paths(spark: SparkSession, path: str) -> DataFrame:
    """SC-14: (clade, steps): lists of literals, one per branch of the path."""
    steps = F.filter(F.transform(F.split("path", r"\s*>\s*"), lambda p: F.filter(F.split(F.trim(p), r"\s*,\s*"), lambda m: m != "")), lambda p: F.size(p) > 0)
    return _pairs(spark, path, "clade", "path").select("clade", steps.alias("steps"))


def read_clade_mutations(spark: SparkSession, path: str) -> DataFrame:
    """SC-14: (clade, pos, par, mut): the net changes of each clade.

    Lines are ``clade TAB [lineage] m1,m2 > m3``; lines with # are comments. Where the first word is a clade of an
    earlier line, that one's changes come first, through any number of such steps. At one site
    the first parent and the last allele hold; a site that ends where it began is no change. A clade
    on two lines, and a word that is no mutation, are errors.
    """
    from arborspark.operators.tree import closure

    lines = spark.read.text(path).where("value not like '#%'").where(F.trim("value") != "").withColumn("ord", F.monotonically_increasing_id())
    c = F.split("value", "\t", -1)
    rows = lines.select("ord", c[0].alias("clade"), F.when(F.size(c) == 2, c[1]).otherwise(F.raise_error(F.concat(F.lit("two fields expected: "), "value"))).alias("text"))
    twice = rows.groupBy("clade").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("ord"), F.first("text").alias("text"))
    once = materialize(twice.select("ord", F.when(F.col("n") == 1, F.col("clade")).otherwise(F.raise_error(F.concat(F.lit("clade on several lines: "), "clade"))).alias("clade"), F.filter(F.split(F.trim("text"), r"[\s>]+"), lambda w: w != "").alias("words")), "clade-lines")
    earlier = once.select(F.col("clade").alias("base"), F.col("ord").alias("_o"))
    based = once.join(earlier, (F.get("words", F.lit(0)) == F.col("base")) & (F.col("_o") < F.col("ord")), "left")
    based = materialize(based.select("ord", "clade", "base", F.when(F.col("base").isNull(), F.col("words")).otherwise(F.slice("words", 2, 1 << 30)).alias("words")), "clade-based")
    words = based.select("clade", F.posexplode(F.flatten(F.transform("words", lambda w: F.filter(F.split(w, ","), lambda m: m != "")))).alias("i", "m"))
    parsed = words.withColumn("p", parse_literal(F.col("m"))).select("clade", "i", F.coalesce("p", F.when(F.col("p").isNull(), F.raise_error(F.concat(F.lit("no mutation: "), "m")).cast("struct<par:int,pos:int,mut:int>"))).alias("p"))
    up = closure(based.select(F.col("clade").alias("node"), F.col("base").alias("parent")))
    path_ = up.join(parsed.withColumnRenamed("clade", "anc"), "anc").select(F.col("node").alias("clade"), F.struct((-F.col("dist")).alias("d"), "i").alias("at"), "p.pos", "p.par", "p.mut")
    return path_.groupBy("clade", "pos").agg(F.min_by("par", "at").alias("par"), F.max_by("mut", "at").alias("mut")).where("par <> mut")


def read_sample_list(spark: SparkSession, path: str) -> DataFrame:
    """SC-13: first word of each line that is not blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+")[0].alias("sample"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """SC-11, QX-2: header line, all strings, empty cells are null; comma for .csv, else tab."""
    return spark.read.csv(path, header=True, sep="," if path.endswith(".csv") else "\t")


def restricted(metadata: DataFrame, samples: DataFrame) -> DataFrame:
    """SC-11: rows of ``samples(sample)`` only; the first column names the sample."""
    return metadata.join(samples.select(F.col("sample").alias(metadata.columns[0])).distinct(), metadata.columns[0], "left_semi")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """SC-8: (name, seq) in upper case, any line width."""
    whole = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    head = F.substring_index("value", "\n", 1)
    return whole.select(F.split(F.trim(head), r"\s+")[0].alias("name"), F.upper(F.regexp_replace(F.substr("value", F.char_length(head) + 1), r"\s", "")).alias("seq"))


def read_diff(spark: SparkSession, path: str) -> DataFrame:
    """SC-7: (sample, start, stop, allele): points, and runs of n or - as closed intervals."""
    whole = spark.read.text(path, lineSep=">").where(F.trim("value") != "")
    lines = whole.select(F.split("value", "\n").alias("l")).select(F.trim(F.col("l")[0]).alias("sample"), F.explode(F.slice("l", 2, 1 << 30)).alias("line")).where(F.trim("line") != "")
    c = F.split("line", "\t")
    n = F.coalesce(F.get(c, F.lit(2)).cast("int"), F.lit(1))
    start = F.get(c, F.lit(1)).cast("int")
    return lines.select("sample", start.alias("start"), (start + n - 1).alias("stop"), allele(F.replace(F.get(c, F.lit(0)), F.lit("-"), F.lit("N"))).alias("allele"))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """SC-9: CDS rows whose attributes start with gene_id."""
    rows = spark.read.csv(path, sep="\t", comment="#", quote="").where("_c2 = 'CDS' and _c8 like 'gene_id%'")
    return rows.select(F.regexp_extract("_c8", r'^gene_id\s+"?([^";]+)', 1).alias("gene"), F.col("_c3").cast("int").alias("start"), F.col("_c4").cast("int").alias("stop"), F.col("_c6").alias("strand"))


def parse_newick(text: str) -> list[tuple]:
    """(node, parent, child_ord, branch_length) rows; inner names are generated, the root is node_1."""
    rows, stack, made, i = [], [], 0, 0
    kids: dict[str, int] = {}

    def add(name: str, length) -> None:
        parent = stack[-1] if stack else None
        order = kids[parent] = kids.get(parent, 0) + 1
        rows.append((name, parent, order, length))

    pending: list[tuple[str, int]] = []
    text = text.strip().rstrip(";")
    while i < len(text):
        c = text[i]
        if c == "(":
            made += 1
            name = f"node_{made}"
            add(name, None)
            pending.append((name, len(rows) - 1))
            stack.append(name)
            i += 1
        elif c == ",":
            i += 1
        else:
            closed = None
            if c == ")":
                if not stack:
                    raise ValueError("unbalanced parentheses")
                stack.pop()
                closed = pending.pop()
                i += 1
            j = i
            while j < len(text) and text[j] not in ",()":
                j += 1
            label, _, length = text[i:j].strip().partition(":")
            size = float(length) if length else None
            if closed:
                name, at = closed
                rows[at] = (*rows[at][:3], size)
            else:
                add(label.strip("'"), size)
            i = j
    if stack:
        raise ValueError("unbalanced parentheses")
    return rows


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """SC-6: one tree per file; a file is one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                yield pd.DataFrame(parse_newick(text), columns=["node", "parent", "child_ord", "branch_length"])

    return spark.read.text(path, wholetext=True).mapInPandas(run, "node string, parent string, child_ord int, branch_length double")


def levelled(edges: DataFrame) -> DataFrame:
    """Adds level and is_leaf to (node, parent, ...) by a level loop."""
    inner = edges.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    rows = materialize(edges.join(inner, "node", "left").withColumn("is_leaf", F.col("_inner").isNull()).drop("_inner"), "edges")
    done = front = materialize(rows.where("parent is null").withColumn("level", F.lit(0)), "level")
    level = 0
    while True:
        level += 1
        front = materialize(rows.join(front.select(F.col("node").alias("parent")), "parent").select(*rows.columns).withColumn("level", F.lit(level)), "level")
        if not front.take(1):
            return done
        done = done.union(front)
