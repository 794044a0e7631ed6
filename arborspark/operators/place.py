"""Sample placement by maximum parsimony.

A placement's score is the number of changes on the sample's new branch. At a node whose events the
sample shares, they join the base state; elsewhere the state above the node holds. ``scores`` has a row for every
(sample, node); the search for the best placements (``minima``) keeps those rows alone. Both go over the nodes once
for all samples (``scan``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.operators import scan, tree
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize

#: Up to so many rows are broadcast by operators that join by hand.
BATCH = 4096
#: So many sample names are broadcast against all nodes at once.
NAMES = 500_000


def _grid(b: Bundle, samples: DataFrame) -> DataFrame:
    """(sample, node, is_leaf, score, n_common, n_unique) of every sample and node but the root."""
    named, kinds = scan.profiles(samples)
    nodes = b.branches()
    runs = 1 + named.count() // NAMES
    out = []
    for block in scan.blocks(b, kinds):
        at = named.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(block.ids)], "profile long, i int")
        wide = scan.grid(nodes, block).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(block.n - 1))))
        cells = wide.select("node", "is_leaf", "i", *(F.get(c, F.col("i")).cast("long").alias(c) for c in ("score", "n_common", "n_unique")))
        mine = named.join(F.broadcast(at), "profile").select("sample", "i")
        for run in range(runs):
            part = mine if runs == 1 else mine.where(F.pmod(F.xxhash64("sample"), F.lit(runs)) == run)
            out.append(cells.join(F.broadcast(part), "i").select("sample", "node", "is_leaf", "score", "n_common", "n_unique"))
    if not out:
        return named.select("sample").join(nodes.select("node", "is_leaf")).select("*", *(F.lit(0).cast("long").alias(c) for c in ("score", "n_common", "n_unique")))
    return reduce(DataFrame.union, out)


def scores(b: Bundle, samples: DataFrame) -> DataFrame:
    """PL-1: ``samples(sample, pos, ref, allele)`` -> (sample, node, score, n_common, n_unique)."""
    return _grid(b, samples).drop("is_leaf")


def _kind() -> Column:
    return (~F.col("is_leaf") & (F.col("n_unique") > 0) & (F.col("n_common") > 0)) | (F.col("is_leaf") & (F.col("n_common") > 0)) | (~F.col("is_leaf") & (F.col("n_unique") == 0))


def admissible(b: Bundle, scored: DataFrame) -> DataFrame:
    """PL-2: internal nodes with a part of their events shared, leaves with any, internal nodes with all."""
    return scored.join(b.node.select("node", "is_leaf", "n_leaves", "dfs"), "node").where(_kind())


def _least(b: Bundle, samples: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """named(sample, profile) and every admissible placement with the profile's least score, or of at most ``most`` changes."""
    named, kinds = scan.profiles(samples)
    nodes, found = b.branches(), []
    for block in scan.blocks(b, kinds):
        rows = materialize(scan.least(nodes, block, most), "placements")
        least = rows.groupBy("profile").agg(F.min("score").alias("_least"))
        found.append(rows.join(least, "profile").where(F.col("score") == F.col("_least")).drop("_least"))
    if not found:
        return named, nodes.where("false").selectExpr("0L profile", "node", "0L score", "0L n_common", "0L n_unique", "is_leaf", "n_leaves", "dfs")
    return named, reduce(DataFrame.union, found)


def minima(b: Bundle, samples: DataFrame, most: int | None = None) -> DataFrame:
    """WN-8, PL-4: every admissible placement with the sample's least score: (sample, node, score, n_common, n_unique, is_leaf, n_leaves, dfs);
    if ``most`` is given, only of samples placed with so many changes."""
    named, rows = _least(b, samples, most)
    return rows.join(named, "profile").select("sample", "node", "score", "n_common", "n_unique", "is_leaf", "n_leaves", "dfs")


def largest(b: Bundle, samples: DataFrame, most: int | None = None) -> DataFrame:
    """(sample, node, score, epp): of the minima the one with most leaves, then the larger dfs, chosen once for samples of the same entries."""
    named, rows = _least(b, samples, most)
    one = rows.groupBy("profile").agg(F.max_by("node", F.struct("n_leaves", "dfs")).alias("node"), F.min("score").alias("score"), F.count(F.lit(1)).alias("epp"))
    return named.join(one, "profile").select("sample", "node", "score", "epp")


def best(b: Bundle, samples: DataFrame, distance: DataFrame | None = None) -> DataFrame:
    """PL-3: (sample, node, score, epp): the chosen minimum and the number of minima.

    QX-6 (the first entry is not the best one by rule): a minimum at a smaller ``distance(sample, node, distance)``
    comes first, then one with more leaves, then the larger dfs. New samples have no distance; a
    sample placed again has that from where it was.
    """
    if distance is None:
        return largest(b, samples)
    w = W.partitionBy("sample")
    rows = minima(b, samples).join(distance, ["sample", "node"], "left")
    order = w.orderBy(F.col("distance").asc_nulls_last(), F.col("n_leaves").desc(), F.col("dfs").desc())
    ranked = rows.withColumn("i", F.row_number().over(order)).withColumn("epp", F.count(F.lit(1)).over(w))
    return ranked.where("i = 1").select("sample", "node", "score", "epp")


def per_node(b: Bundle, samples: DataFrame) -> DataFrame:
    """PL-12: (sample, node, score) of every node without adding the sample; a placement equal to one at a neighbour costs 1 more."""
    return _grid(b, samples).select("sample", "node", (F.col("score") + (~_kind()).cast("long")).alias("score"))


def with_runs(b: Bundle, samples: DataFrame, runs: DataFrame, width: int = 1024) -> DataFrame:
    """JO-2: ``samples(sample, pos, ref, allele)`` and ``runs(sample, start, stop)`` of unknown bases -> samples.

    Unknown bases match every state, so only sites of the tree matter: these are range-joined with the
    runs and become entries of allele 15, in place of a point entry there.
    """
    sites = b.event.select(F.col("pos").alias("x"), "ref").distinct()
    hit = tree.range_join(sites, runs.select("sample", F.col("start").alias("lo"), F.col("stop").alias("hi")), width)
    unknown = hit.select("sample", F.col("x").alias("pos"), "ref", F.lit(15).alias("allele")).distinct()
    return samples.select("sample", "pos", "ref", "allele").join(unknown.select("sample", "pos"), ["sample", "pos"], "left_anti").union(unknown)


def index(b: Bundle) -> DataFrame:
    """PL-5, OP-4: (pos, mut, dfs, dfs_end, node, level): where each allele of a site begins, as dfs intervals."""
    return b.event.join(b.node.select("node", "dfs", "dfs_end", "level"), "node").select("pos", "mut", "dfs", "dfs_end", "node", "level")


def shared_events(b: Bundle, samples: DataFrame) -> DataFrame:
    """PL-5: (sample, node, shared): for nodes with an event that the sample shares, how many of the events above or
    at the node it shares; by the index, without a row for other nodes."""
    hits = index(b).join(samples.where("allele <> ref").select("sample", "pos", "allele"), "pos").where(F.col("allele").bitwiseAND(F.col("mut")) != 0)
    at = hits.select("sample", "node").distinct()
    above = hits.select("sample", F.col("node").alias("anc"), "pos").distinct()
    return at.join(b.closure.select("node", "anc"), "node").join(above, ["sample", "anc"]).groupBy("sample", "node").agg(F.countDistinct("pos").alias("shared"))
