"""What a placement tells: clades, imputed bases, statistics, rejection, neighbourhoods, order of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions.nucleotides import impute, is_ambiguous, letter
from arborspark.operators import place, report
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize

UNDEFINED = "UNDEFINED"


def clade_calls(b: Bundle, minima: DataFrame, chosen: DataFrame) -> DataFrame:
    """PL-9: (sample, annotation, best, histogram) for both label columns.

    A placement has the nearest label above its node; the node's own counts where the sample becomes a
    child of an inner node. ``best`` is the chosen placement's, the histogram ``label(k/n)`` over all minima, by label.
    """
    rows = minima.select("sample", "node", "is_leaf", "n_unique").withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    path = rows.join(b.closure, "node").where((F.col("dist") > 0) | (~F.col("is_leaf") & (F.col("n_unique") == 0)))
    near = path.join(report.labels(b), ["anc", "k"]).groupBy("sample", "node", "k").agg(F.min_by("clade", "dist").alias("clade"))
    named = materialize(rows.select("sample", "node", "k").join(near, ["sample", "node", "k"], "left").withColumn("clade", F.coalesce("clade", F.lit(UNDEFINED))), "clade-calls")
    size = W.partitionBy("sample", "k")
    counts = named.groupBy("sample", "k", "clade").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.sum("n").over(size))
    item = F.transform(F.array_sort(F.collect_list(F.struct("clade", "n", "all"))), lambda s: F.concat(s["clade"], F.lit("("), s["n"].cast("string"), F.lit("/"), s["all"].cast("string"), F.lit(")")))
    histogram = counts.groupBy("sample", "k").agg(F.array_join(item, ",").alias("histogram"))
    best = named.join(chosen.select("sample", "node"), ["sample", "node"]).select("sample", "k", F.col("clade").alias("best"))
    return best.join(histogram, ["sample", "k"]).select("sample", (F.col("k") + 1).alias("annotation"), "best", "histogram")


def imputed_bases(b: Bundle, samples: DataFrame, chosen: DataFrame) -> DataFrame:
    """PL-10: (sample, imputed): ``pos:base`` of each ambiguous entry, by position; unknown bases (N) are not imputed.

    The base is what the entry shares with the state at the chosen placement, else its lowest allele. That
    state is the node's where the sample shares the node's event, else its parent's.
    """
    up = chosen.select("sample", "node").join(b.node.select("node", F.coalesce("parent", "node").alias("up")), "node")
    unclear = samples.where(is_ambiguous(F.col("allele")) & (F.col("allele") != 15))
    up = materialize(up, "chosen")
    above = b.state.join(up.select(F.col("up").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("up"), "pos", F.col("mut").alias("base"))
    own = b.event.join(up.select("node").distinct(), "node", "left_semi").select("node", "pos", F.col("mut").alias("here"))
    rows = unclear.join(up, "sample").join(above, ["up", "pos"], "left").join(own, ["node", "pos"], "left")
    shared = F.when(F.col("here").bitwiseAND(F.col("allele")) != 0, F.col("here"))
    base = impute(F.coalesce(shared, "base", "ref"), F.col("allele"))
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", base.alias("base")))), lambda s: F.concat(s["pos"].cast("string"), F.lit(":"), letter(s["base"])))
    return rows.groupBy("sample").agg(F.array_join(text, ";").alias("imputed"))


def verdicts(best: DataFrame, max_uncertainty: int, max_parsimony: int) -> DataFrame:
    """SE-14, SE-15: adds low_confidence (several minima) and rejected (too many of them, or too high a score)."""
    return best.withColumns({"low_confidence": F.col("epp") > 1, "rejected": (F.col("epp") > max_uncertainty) | (F.col("score") > max_parsimony)})


def at_most_placements(best: DataFrame, most: int) -> DataFrame:
    """SE-14: samples with at most so many equally parsimonious placements."""
    return best.where(F.col("epp") <= most)


def statistics_lines(best: DataFrame, imputed: DataFrame) -> DataFrame:
    """SK-9: (sample, value): name, score, number of placements, imputed bases."""
    bases = F.when(F.col("imputed").isNull(), "").otherwise(F.concat("imputed", F.lit(";")))
    return best.join(imputed, "sample", "left").select("sample", F.concat_ws("\t", "sample", F.col("score").cast("string"), F.col("epp").cast("string"), bases).alias("value"))


def clade_lines(calls: DataFrame, detailed: bool = True) -> DataFrame:
    """SK-9: (sample, value): name, then ``best*|histogram`` for each label column."""
    cell = F.concat("best", F.lit("*|"), F.col("histogram") if detailed else F.lit(""))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("annotation", cell.alias("cell")))), lambda s: s["cell"])
    return calls.groupBy("sample").agg(cells.alias("c")).select("sample", F.concat_ws("\t", "sample", F.array_join("c", "\t")).alias("value"))


def placement_order(best: DataFrame, samples: DataFrame, by: str = "score", reverse: bool = False) -> DataFrame:
    """SO-1, QX-4: (sample, place): ascending by score then placements, by placements then score, or by unclear entries; reversed if asked; ties by name."""
    unclear = samples.groupBy("sample").agg(F.sum(is_ambiguous(F.col("allele")).cast("long")).alias("unclear"))
    rows = best.join(unclear, "sample", "left")
    keys = {"score": ["score", "epp"], "epp": ["epp", "score"], "ambiguity": ["unclear"]}[by]
    order = [F.col(k).desc() if reverse else F.col(k) for k in keys]
    return rows.orderBy(*order, "sample").select("sample", *keys)


def neighbourhoods(b: Bundle, leaves: DataFrame) -> DataFrame:
    """PL-14: ``leaves(node)`` -> (sample, epp, neighbourhood): placements of an existing sample apart from itself, and the
    longest way in edges between two of them.

    QX-5: ways are those over the lowest common ancestor of two different placements. The longest is the
    largest sum of the two deepest placements below different children of an ancestor (itself included).
    """
    mine = leaves.select(F.col("node").alias("sample"))
    entries = mine.join(b.state.where("mut <> ref").withColumnRenamed("node", "sample"), "sample").select("sample", "pos", "ref", F.col("mut").alias("allele"))
    bare = mine.join(entries.select("sample").distinct(), "sample", "left_anti").select("sample", F.lit(-1).alias("pos"), F.lit(1).alias("ref"), F.lit(1).alias("allele"))
    samples = materialize(entries.unionByName(bare), "existing")
    scored = place.admissible(b, place.scores(b, samples)).where("node <> sample")
    best = materialize(scored.withColumn("r", F.rank().over(W.partitionBy("sample").orderBy("score"))).where("r = 1").select("sample", "node"), "existing-best")
    path = best.join(b.closure, "node")
    step = path.join(path.select("sample", "node", F.col("anc").alias("branch"), (F.col("dist") + 1).alias("dist")), ["sample", "node", "dist"], "left")
    deepest = step.groupBy("sample", "anc", "branch").agg(F.max("dist").alias("d"))
    two = deepest.withColumn("i", F.row_number().over(W.partitionBy("sample", "anc").orderBy(F.col("d").desc(), "branch"))).where("i <= 2")
    wide = two.groupBy("sample", "anc").agg(F.sum("d").alias("way"), F.count(F.lit(1)).alias("k")).where("k = 2").groupBy("sample").agg(F.max("way").alias("way"))
    return best.groupBy("sample").agg(F.count(F.lit(1)).alias("epp")).join(wide, "sample", "left").select("sample", "epp", F.coalesce("way", F.lit(0)).alias("neighbourhood"))


def merge_visit(samples: DataFrame, events: DataFrame) -> DataFrame:
    """UD-2: ``samples(sample, pos, allele)`` against ``events(sample, node, pos, mut)``: each site with the case it is:
    sample, node, both, or unknown (the sample has N there)."""
    both = samples.join(events, ["sample", "pos"], "full")
    case = F.when(F.col("allele") == 15, "unknown").when(F.col("mut").isNull(), "sample").when(F.col("allele").isNull(), "node").otherwise("both")
    return both.select("sample", "node", "pos", "allele", "mut", case.alias("visit"))
