"""Trees that grow: placements are applied, samples follow each other, trees are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions.nucleotides import first_allele
from arborspark.operators import place
from arborspark.plans.analog import Bundle
from arborspark.plans.rebuild import rebuild
from arborspark.plans.scratch import materialize


def split_events(b: Bundle, chosen: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PL-6, PL-7: ``chosen(sample, node)`` -> (node events with ``shared``), (events the sample needs below them).

    An ambiguous allele becomes the base state's if it holds that one, else the reference if it holds
    it, else its lowest; sites of allele 15 need nothing.
    """
    entries = samples.select("sample", "pos", "allele")
    own = chosen.join(b.event, "node").join(entries, ["sample", "pos"], "left")
    shared = F.when(F.col("allele").isNotNull(), F.col("allele").bitwiseAND(F.col("mut")) != 0).otherwise(F.col("mut") == F.col("ref"))
    own = own.select("sample", "node", "pos", "ref", "par", "mut", shared.alias("shared"))
    up = b.node.select("node", F.coalesce("parent", "node").alias("up"))
    above = chosen.join(up, "node").join(b.state.select(F.col("node").alias("up"), "pos", "ref", F.col("mut").alias("base")), "up").select("sample", "pos", "ref", "base")
    joined = own.where("shared").select("sample", "pos", "ref", F.col("mut").alias("base"))
    base = above.join(joined.select("sample", "pos"), ["sample", "pos"], "left_anti").unionByName(joined)
    mine = chosen.select("sample").join(samples.select("sample", "pos", "allele", F.col("ref").alias("_ref")), "sample")
    both = base.join(mine, ["sample", "pos"], "full").withColumns({"ref": F.coalesce("ref", "_ref")})
    par, allele = F.coalesce("base", "ref"), F.coalesce("allele", "ref")
    target = F.when(allele.bitwiseAND(par) != 0, par).when(allele.bitwiseAND(F.col("ref")) != 0, F.col("ref")).otherwise(first_allele(allele))
    need = both.select("sample", "pos", "ref", par.alias("par"), target.alias("mut")).where("par <> mut")
    return own, need


def apply_placements(b: Bundle, chosen: DataFrame, samples: DataFrame) -> Bundle:
    """PL-6: the tree with each of ``chosen(sample, node)`` added; at most one sample per node.

    At an inner node whose events the sample shares in full it becomes a child, else a new node
    ``<sample>_split`` takes the shared events and holds the old node and the sample.
    """
    chosen = materialize(chosen.select("sample", "node"), "chosen")
    own, need = (materialize(t, "split") for t in split_events(b, chosen, samples))
    unique = own.groupBy("sample").agg(F.max((~F.col("shared")).cast("int")).alias("u"))
    mode = chosen.join(unique, "sample", "left").join(b.node.select("node", "parent", "is_leaf"), "node").withColumn("sibling", F.col("parent").isNotNull() & (F.col("is_leaf") | (F.coalesce("u", F.lit(0)) == 1)))
    mode = materialize(mode.withColumn("split", F.when(F.col("sibling"), F.concat("sample", F.lit("_split")))), "mode")
    none = F.lit(None).cast("string")
    moved = mode.where("sibling").select("node", "split")
    old = b.node.select("node", "parent", "c0", "c1").join(moved, "node", "left").select("node", F.coalesce("split", "parent").alias("parent"), "c0", "c1")
    new = mode.where("sibling").select(F.col("split").alias("node"), "parent", none.alias("c0"), none.alias("c1"))
    leaf = mode.select(F.col("sample").alias("node"), F.coalesce("split", "node").alias("parent"), none.alias("c0"), none.alias("c1"))
    lifted = own.where("shared").join(moved, "node").select("node", "pos", "split")
    events = b.event.join(lifted, ["node", "pos"], "left").select(F.coalesce("split", "node").alias("node"), "pos", "ref", "par", "mut")
    return rebuild(old.union(new).union(leaf), events.union(need.select(F.col("sample").alias("node"), "pos", "ref", "par", "mut")))


def place_all(b: Bundle, samples: DataFrame) -> Bundle:
    """PL-8, PL-13: places all samples in rounds; of those that choose one node the first by name is added and the rest see the new tree."""
    left = materialize(samples, "samples")
    while left.take(1):
        best = place.best(b, left).withColumn("i", F.row_number().over(W.partitionBy("node").orderBy("sample"))).where("i = 1").select("sample", "node")
        best = materialize(best, "round")
        b = apply_placements(b, best, left)
        left = materialize(left.join(best.select("sample"), "sample", "left_anti"), "samples")
    return b


def place_on_trees(b: Bundle, samples: DataFrame, names: list[str], most: int) -> list[Bundle]:
    """PL-11: places ``names`` one by one; a tie forks the tree, up to ``most`` trees, and trees above the least score go, all of them (QX-12)."""
    trees = [b]
    for name in names:
        one = materialize(samples.where(F.col("sample") == name), "sample")
        options = []
        for t in trees:
            top = place.minima(t, one).orderBy(F.col("n_leaves").desc(), F.col("dfs").desc()).select("score", "node").limit(most).collect()
            options += [(r["score"], t, r["node"]) for r in top]
        least = min(o[0] for o in options)
        chosen = [(t, node) for score, t, node in options if score == least][:most]
        trees = [apply_placements(t, one.select("sample").distinct().withColumn("node", F.lit(node)), one) for t, node in chosen]
    return trees


def new_leaves(one: Bundle, two: Bundle) -> DataFrame:
    """JO-7: leaves of the second tree that the first one lacks."""
    return two.leaf.select("node").join(one.leaf.select("node"), "node", "left_anti")


def merge_trees(one: Bundle, two: Bundle) -> Bundle:
    """PL-15: the first tree with the second one's other leaves placed on it; a leaf without changes has one entry of the reference."""
    leaves = new_leaves(one, two)
    haps = two.state.join(leaves, "node").select(F.col("node").alias("sample"), "pos", "ref", F.col("mut").alias("allele"))
    bare = leaves.select(F.col("node").alias("sample")).join(haps.select("sample").distinct(), "sample", "left_anti").select("sample", F.lit(0).alias("pos"), F.lit(1).alias("ref"), F.lit(1).alias("allele"))
    return place_all(one, haps.unionByName(bare))
