"""Reports over a bundle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions.nucleotides import fisher_exact, letter, literal
from arborspark.operators.select import event_counts
from arborspark.plans.analog import Bundle


def samples(b: Bundle) -> DataFrame:
    """AG-1."""
    return event_counts(b).where("is_leaf").select(F.col("node").alias("sample"), F.col("n").alias("parsimony"), "parent")


def labels(b: Bundle) -> DataFrame:
    return b.node.select(F.col("node").alias("anc"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("c0").alias("clade")), F.struct(F.lit(1).alias("k"), F.col("c1").alias("clade")))).alias("x")).select("anc", "x.k", "x.clade").where("clade is not null")


def clades(b: Bundle) -> DataFrame:
    """AG-2: leaves below each label, and leaves whose nearest label of its column it is; a leaf's own labels do not count."""
    path = b.closure.where("dist > 0").join(labels(b), "anc").join(b.leaf.select("node"), "node")
    near = F.row_number().over(W.partitionBy("node", "k").orderBy("dist")) == 1
    return path.withColumn("near", near).groupBy("clade").agg(F.count(F.lit(1)).alias("inclusive"), F.sum(F.col("near").cast("long")).alias("exclusive"))


def mutations(b: Bundle) -> DataFrame:
    """AG-3: occurrences of each mutation over all branches, masked ones left out."""
    return b.event.where("pos >= 0").groupBy(literal(F.col("par"), F.col("pos"), F.col("mut")).alias("mutation")).agg(F.count(F.lit(1)).alias("occurrence"))


def haplotypes(b: Bundle) -> DataFrame:
    """AG-4: distinct leaf haplotypes and their samples; the empty one is ``reference``."""
    sites = b.state.where("mut <> ref").groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref", "mut"))), lambda s: literal(s["ref"], s["pos"], s["mut"])), ",").alias("h"))
    return b.leaf.select("node").join(sites, "node", "left").groupBy(F.coalesce("h", F.lit("reference")).alias("haplotype")).agg(F.count(F.lit(1)).alias("samples"))


def spectrum(b: Bundle) -> DataFrame:
    """AG-5: 4 x 4 substitution counts with zeros (16 fixed rows)."""
    bases = F.explode(F.array(*map(F.lit, (1, 2, 4, 8))))
    grid = b.node.sparkSession.range(1).select(bases.alias("par")).withColumn("mut", F.explode(F.array(*map(F.lit, (1, 2, 4, 8)))))
    found = b.event.groupBy("par", "mut").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(found, ["par", "mut"], "left").select(letter(F.col("par")).alias("from_base"), letter(F.col("mut")).alias("to_base"), F.coalesce("n", F.lit(0)).alias("n"))


def aberrant(b: Bundle, annotations: DataFrame | None = None) -> DataFrame:
    """AG-6: duplicate ids, internal non-root nodes without an event, and nodes of ``annotations(node, labels)`` whose
    number of labels is not the most common one."""
    twice = b.node.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node", F.lit("duplicate-node-id").alias("issue"))
    empty = event_counts(b).where("n = 0 and not is_leaf and parent is not null").select("node", F.lit("internal-no-mutations").alias("issue"))
    out = twice.union(empty)
    if annotations is not None:
        usual = annotations.groupBy(F.size("labels").alias("_n")).agg(F.count(F.lit(1)).alias("_k")).agg(F.max_by("_n", F.struct("_k", "_n")).alias("_n"))
        wrong = annotations.join(F.broadcast(usual)).where(F.size("labels") != F.col("_n")).select("node", F.lit("annotation-count").alias("issue"))
        out = out.union(wrong)
    return out


def sample_clades(b: Bundle) -> DataFrame:
    """AG-7: nearest label of each column above every leaf, ``None`` where there is none."""
    near = b.closure.where("dist > 0").join(labels(b), "anc").groupBy("node", "k").agg(F.min_by("clade", "dist").alias("clade"))
    wide = near.groupBy("node").pivot("k", [0, 1]).agg(F.first("clade"))
    return b.leaf.select("node").join(wide, "node", "left").select(F.col("node").alias("sample"), F.coalesce("0", F.lit("None")).alias("annotation_1"), F.coalesce("1", F.lit("None")).alias("annotation_2"))


def roho(b: Bundle, least: int = 5) -> DataFrame:
    """AG-8: for each mutation on exactly one inner child, its child's leaves against the median of its siblings'."""
    inner = b.node.where("not is_leaf and parent is not null").select("node", "parent", "n_leaves", "dfs")
    named = b.event.select("node", "pos", literal(F.col("par"), F.col("pos"), F.col("mut")).alias("mutation"))
    kids = inner.groupBy("parent").agg(F.count(F.lit(1)).alias("child_count"), F.sum((F.col("n_leaves") > 1).cast("long")).alias("big")).where("big >= 2")
    cand = named.join(inner, "node").groupBy("parent", "mutation").agg(F.max_by("node", "dfs").alias("node"))
    below = b.closure.where("dist > 1").select("node", F.col("anc").alias("parent")).join(named.select("node", "mutation"), "node").select("parent", "mutation").distinct()
    cand = cand.join(below, ["parent", "mutation"], "left_anti").join(kids, "parent")
    carrier = cand.join(inner.select("node", F.col("n_leaves").alias("with_count")), "node").where(F.col("with_count") > least)
    sibs = inner.where(F.col("n_leaves") > least).select("parent", F.col("node").alias("sib"), "n_leaves")
    others = carrier.join(sibs, "parent").where("sib <> node").groupBy("parent", "mutation", "child_count", "with_count").agg(F.sort_array(F.collect_list("n_leaves")).alias("o"))
    n = F.size("o")
    median = F.when(n % 2 == 1, F.element_at("o", ((n + 1) / 2).cast("int"))).otherwise(F.floor((F.element_at("o", (n / 2).cast("int")) + F.element_at("o", F.greatest(F.lit(1), (n / 2).cast("int") + 1))) / 2))
    return others.select("mutation", "parent", "child_count", "with_count", median.cast("long").alias("median_without")).withColumn("log10_ratio", F.round(F.log10(F.col("with_count") / F.col("median_without")), 9))


def reversions(b: Bundle) -> DataFrame:
    """AG-9: (node, reversions): events since the last labelled node above (none at or without one) that go back to the reference
    at a site that differs at that node. QX-15: a later event at the site counts as well."""
    labelled = b.node.where("c0 is not null or c1 is not null").select(F.col("node").alias("anc"))
    last = b.closure.join(labelled, "anc").groupBy("node").agg(F.min("dist").alias("up"), F.min_by("anc", "dist").alias("clade")).where("up > 0")
    off = b.state.where("mut <> ref").select(F.col("node").alias("clade"), "pos")
    since = last.join(b.closure, "node").where("dist < up").select("node", "clade", "anc")
    back = b.event.where("mut = ref").select(F.col("node").alias("anc"), "pos")
    return since.join(back, "anc").join(off, ["clade", "pos"]).groupBy("node").agg(F.count(F.lit(1)).alias("reversions"))


def node_stats(b: Bundle) -> DataFrame:
    """AG-9: leaves, events at and below each node, their ratio, and reversions since the last label."""
    n = b.closure.join(b.event.groupBy("node").agg(F.count(F.lit(1)).alias("k")), "node").groupBy(F.col("anc").alias("node")).agg(F.sum("k").alias("mut_count"))
    out = b.node.select("node", F.col("n_leaves").alias("leaf_count")).join(n, "node", "left").select("node", "leaf_count", F.coalesce("mut_count", F.lit(0)).alias("mut_count")).withColumn("mut_density", F.round(F.col("mut_count") / F.col("leaf_count"), 9))
    return out.join(reversions(b), "node", "left").withColumn("reversions", F.coalesce("reversions", F.lit(0)))


def totals(b: Bundle, condensed: DataFrame | None = None) -> DataFrame:
    """AG-10: one row for the tree; ``condensed(node, n)`` adds condensed nodes and the samples in them."""
    nodes = b.node.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum(F.col("is_leaf").cast("long")).alias("samples"),
        F.max(F.when(F.col("is_leaf"), F.col("level"))).cast("long").alias("max_depth"),
        F.round(F.avg(F.when(F.col("is_leaf"), F.col("level"))), 9).alias("mean_depth"),
        (F.countDistinct("c0") + F.countDistinct("c1")).alias("labels"),
    )
    out = nodes.join(b.event.agg(F.count(F.lit(1)).alias("parsimony")))
    if condensed is None:
        return out
    return out.join(condensed.agg(F.count(F.lit(1)).alias("condensed_nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("condensed_samples")))


def allele_counts(b: Bundle) -> DataFrame:
    """AG-11: alternative alleles, their counts and the number of samples per site, alleles by code (QX-1)."""
    n = b.leaf.count()
    alt = b.state.where("mut <> ref").join(b.leaf.select("node"), "node", "left_semi").groupBy("pos", "mut").agg(F.count(F.lit(1)).alias("c"))
    held = F.array_sort(F.collect_list(F.struct("mut", "c")))
    return alt.groupBy("pos").agg(held.alias("x")).select("pos", F.array_join(F.transform("x", lambda s: letter(s["mut"])), ",").alias("alt"), F.array_join(F.transform("x", lambda s: s["c"].cast("string")), ",").alias("ac"), F.lit(n).cast("long").alias("an"))


def clade_frequencies(b: Bundle, least: float) -> DataFrame:
    """AG-12: alleles carried by at least a share of a clade's leaves (reversions to the reference left out)."""
    inside = b.closure.join(labels(b), "anc").join(b.leaf.select("node"), "node").select("clade", "node").distinct()
    size = inside.groupBy("clade").agg(F.count(F.lit(1)).alias("size"))
    hits = inside.join(b.state.where("mut <> ref"), "node").groupBy("clade", "pos", "mut").agg(F.count(F.lit(1)).alias("n"))
    return hits.join(size, "clade").where(F.col("n") >= least * F.col("size")).select("clade", "pos", "mut", "n", "size")


def literal_inside_outside(b: Bundle, min_total: int = 50, min_count: int = 10) -> DataFrame:
    """AG-14 (counts): each mutation inside and outside every subtree with enough events."""
    named = b.event.select("node", literal(F.col("par"), F.col("pos"), F.col("mut")).alias("mutation"))
    inside = b.closure.join(named, "node").groupBy(F.col("anc").alias("branch"), "mutation").agg(F.count(F.lit(1)).alias("inside"))
    local = inside.groupBy("branch").agg(F.sum("inside").alias("local_total")).where(F.col("local_total") >= min_total)
    total = named.groupBy("mutation").agg(F.count(F.lit(1)).alias("everywhere"))
    return inside.where(F.col("inside") >= min_count).join(local, "branch").join(total, "mutation").select("branch", "mutation", "inside", (F.col("everywhere") - F.col("inside")).alias("outside"), "local_total")


def enrichment(b: Bundle, min_total: int = 50, min_count: int = 10) -> DataFrame:
    """AG-14 with the exact test: adds pvalue, corrected_pvalue, and per branch keeps the mutation of the least p.

    QX-9: the table is (inside, outside; events of the subtree, events elsewhere), totals and not complements, and the
    corrected p, p times the number of tests, is not capped at 1.
    """
    rows = literal_inside_outside(b, min_total, min_count)
    everything = b.event.agg(F.count(F.lit(1)).alias("_all"))
    tested = fisher_exact(rows.join(F.broadcast(everything)).withColumn("_rest", F.col("_all") - F.col("local_total")), "inside", "outside", "local_total", "_rest")
    number = rows.agg(F.count(F.lit(1)).alias("_tests"))
    corrected = tested.join(F.broadcast(number)).withColumn("corrected_pvalue", F.col("pvalue") * F.col("_tests"))
    first = F.row_number().over(W.partitionBy("branch").orderBy("pvalue", "mutation"))
    return corrected.withColumn("_i", first).where("_i = 1").select("branch", "mutation", "inside", "outside", "local_total", "pvalue", "corrected_pvalue")


def back_mutations(b: Bundle) -> DataFrame:
    """AG-15, WN-2: events that return to the parent allele of the previous event at their site."""
    above = b.event.select("node", "pos", "mut").join(b.closure.where("dist > 0"), "node").join(b.event.select(F.col("node").alias("anc"), "pos", F.col("par").alias("p")), ["anc", "pos"])
    last = above.groupBy("node", "pos", "mut").agg(F.min_by("p", "dist").alias("p"))
    return last.where("p = mut").groupBy("pos").agg(F.count(F.lit(1)).alias("n"))


def paths(b: Bundle) -> DataFrame:
    """DE-1, SK-8: root-to-leaf mutation paths, branches without events skipped."""
    own = b.event.groupBy(F.col("node").alias("anc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "par", "mut"))), lambda s: literal(s["par"], s["pos"], s["mut"])), ",").alias("m"))
    steps = b.closure.join(b.leaf.select("node"), "node").join(own, "anc").withColumn("step", F.concat("anc", F.lit(":"), "m"))
    return steps.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "step"))), lambda s: s["step"]), " ").alias("path"))


def labelled_paths(b: Bundle) -> DataFrame:
    """DE-2: (clade, path): the mutation path from the root to the first node in breadth-first order with each label."""
    named = b.node.select("node", "level", "dfs", F.explode(F.array("c0", "c1")).alias("clade")).where("clade is not null")
    at = named.groupBy("clade").agg(F.min_by("node", F.struct("level", "dfs")).alias("node"))
    own = b.event.groupBy(F.col("node").alias("anc")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "par", "mut"))), lambda s: literal(s["par"], s["pos"], s["mut"])), ",").alias("m"))
    steps = at.join(b.closure, "node").join(own, "anc")
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "m"))), lambda s: s["m"]), " > ")
    return at.join(steps.groupBy("clade").agg(path.alias("path")), "clade", "left").select("clade", "node", F.coalesce("path", F.lit("")).alias("path"))


def leaves_per_node(b: Bundle) -> DataFrame:
    """AG-16: (node, parent, leaves)."""
    return b.node.select("node", "parent", F.col("n_leaves").alias("leaves"))


def events_per_sample(before: Bundle, after: Bundle) -> DataFrame:
    """AG-17: parsimony and samples of two trees, events per sample, and events per added sample."""
    one, two = (t.node.agg(F.sum(F.col("is_leaf").cast("long")).alias(f"samples_{s}")).join(t.event.agg(F.count(F.lit(1)).alias(f"parsimony_{s}"))) for t, s in ((before, "before"), (after, "after")))
    rate = lambda s: F.round(F.col(f"parsimony_{s}") / F.col(f"samples_{s}"), 9).alias(f"rate_{s}")
    added = F.col("samples_after") - F.col("samples_before")
    return one.join(two).select("*", rate("before"), rate("after"), F.when(added > 0, F.round((F.col("parsimony_after") - F.col("parsimony_before")) / added, 9)).alias("rate_added"))


def recurrent(b: Bundle, least: int = 2) -> DataFrame:
    """AG-20, AG-22: mutations on at least so many branches, with the nodes' exact and approximate number (partial sums per task, then final)."""
    named = b.event.where("pos >= 0").select("node", literal(F.col("par"), F.col("pos"), F.col("mut")).alias("mutation"))
    return named.groupBy("mutation").agg(F.countDistinct("node").alias("branches")).where(F.col("branches") >= least)


def running_totals(b: Bundle) -> DataFrame:
    """WN-3: (node, anc, total): events from the root down to and including each ancestor-or-self of a leaf."""
    n = event_counts(b).select(F.col("node").alias("anc"), "n")
    path = b.closure.join(b.leaf.select("node"), "node").join(n, "anc")
    return path.select("node", "anc", F.sum("n").over(W.partitionBy("node").orderBy(F.col("dist").desc()).rowsBetween(W.unboundedPreceding, 0)).alias("total"))
