"""Clade labels: given by node, by path, by mutations or by samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions import nucleotides as nuc
from arborspark.operators import place
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize


def by_node(b: Bundle, given: DataFrame) -> DataFrame:
    """AN-1: ``given(ord, clade, node)`` -> (node, clade), the first of each node; a node that the tree lacks is an error."""
    known = given.join(b.node.select("node", F.lit(True).alias("_k")), "node", "left")
    name = F.when(F.col("_k"), F.col("clade")).otherwise(F.raise_error(F.concat(F.lit("no such node: "), "node")))
    return known.select("node", "ord", name.alias("clade")).groupBy("node").agg(F.min_by("clade", "ord").alias("clade"))


def with_column(b: Bundle, labels: DataFrame, clear: bool = False) -> DataFrame:
    """AN-5: (node, labels): the node's labels, or none of them, and one more from ``labels(node, clade)``; empty where there is none."""
    old = F.array() if clear else F.array(F.coalesce("c0", F.lit("")), F.coalesce("c1", F.lit("")))
    return b.node.join(labels, "node", "left").select("node", F.array_append(old.cast("array<string>"), F.coalesce("clade", F.lit(""))).alias("labels"))


def by_path(b: Bundle, paths: DataFrame) -> DataFrame:
    """AN-2: ``paths(clade, steps)`` of lists of literals -> (clade, node): from the root to the first child with just those events, step by step."""
    literal = nuc.literal(F.col("par"), F.col("pos"), F.col("mut"))
    key = b.event.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list(literal)), ",").alias("key"))
    kids = materialize(b.node.where("parent is not null").join(key, "node").groupBy("parent", "key").agg(F.min_by("node", "dfs").alias("next")), "kids")
    at = paths.join(b.node.where("parent is null").select("node")).select("clade", "node", "steps")
    deepest = paths.agg(F.max(F.size("steps"))).first()[0] or 0
    for k in range(deepest):
        here = at.where(F.size("steps") > k).withColumn("key", F.array_join(F.array_sort(F.get("steps", F.lit(k))), ","))
        went = here.join(kids, (F.col("node") == F.col("parent")) & (here["key"] == kids["key"])).select("clade", F.col("next").alias("node"), "steps")
        at = materialize(went.union(at.where(F.size("steps") <= k)), "path")
    return at.select("clade", "node")


def by_mutations(b: Bundle, sets: DataFrame) -> DataFrame:
    """AN-3: ``sets(sample, pos, ref, allele)`` by clade -> (clade, node) of a placement without changes; most leaves, then larger dfs."""
    return place.largest(b, sets, 0).select(F.col("sample").alias("clade"), "node")


def consensus(b: Bundle, members: DataFrame, keep: float, mask: float) -> DataFrame:
    """AG-12: ``members(clade, node)`` -> (sample, pos, ref, allele): alleles of a share of ``keep`` or more; from ``mask`` up to it N."""
    size = members.groupBy("clade").agg(F.count(F.lit(1)).alias("size"))
    share = members.join(b.state.where("mut <> ref"), "node").groupBy("clade", "pos", "ref", "mut").agg(F.count(F.lit(1)).alias("n")).join(size, "clade").withColumn("f", F.col("n") / F.col("size"))
    most = share.where(F.col("f") >= mask).groupBy("clade", "pos", "ref").agg(F.max(F.struct("f", "mut")).alias("m"))
    return most.select(F.col("clade").alias("sample"), "pos", "ref", F.when(F.col("m.f") >= keep, F.col("m.mut")).otherwise(15).alias("allele"))


def _climb(walk: Column, least_overlap: float) -> Column:
    """The accepted steps of a walk sorted by (at, dist): a path ends at its first step below the best share so far, which holds over all paths (QX-19)."""
    kind = "array<struct<at:long,dist:int,freq:double,overlap:double,dfs:long,node:string>>"
    start = F.struct(F.lit(-1.0).alias("best"), F.lit(-1).cast("long").alias("ended"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        good = (acc["ended"] != x["at"]) & (x["freq"] >= acc["best"]) & (x["overlap"] >= least_overlap)
        kept = F.when(good, F.concat(acc["kept"], F.array(x).cast(kind))).otherwise(acc["kept"])
        return F.struct(F.when(good, x["freq"]).otherwise(acc["best"]).alias("best"), F.when(good, acc["ended"]).otherwise(x["at"]).alias("ended"), kept.alias("kept"))

    return F.aggregate(walk, start, step, lambda acc: acc["kept"])


def by_samples(b: Bundle, members: DataFrame, keep: float = 0.8, mask: float = 0.2, least_overlap: float = 0.6, clip: float = 0.1) -> DataFrame:
    """AN-4, AG-13, SO-5: ``members(clade, node)`` -> (clade, node, freq, overlap); no node gets two clades.

    The consensus is placed; from each best node the path climbs while the share of members among the
    leaves does not fall and enough of the clade lies below. Candidates rank by min(freq, clip) *
    overlap^2, then dfs. Clades with fewer candidates choose first, then larger ones, then by name.
    """
    members = materialize(members.select("clade", "node").distinct(), "members")
    size = members.groupBy("clade").agg(F.count(F.lit(1)).alias("size"))
    start = place.minima(b, consensus(b, members, keep, mask)).select(F.col("sample").alias("clade"), F.col("node").alias("start"))
    inside = members.join(b.closure, "node").groupBy("clade", "anc").agg(F.count(F.lit(1)).alias("k"))
    up = start.join(b.closure.withColumnRenamed("node", "start"), "start").join(inside, ["clade", "anc"], "left").join(size, "clade").join(b.node.select(F.col("node").alias("anc"), "n_leaves", "dfs"), "anc")
    rated = up.withColumns({"freq": F.coalesce("k", F.lit(0)) / F.col("n_leaves"), "overlap": F.coalesce("k", F.lit(0)) / F.col("size")})
    walk = rated.join(b.node.select(F.col("node").alias("start"), F.col("dfs").alias("at")), "start").groupBy("clade", "size").agg(F.array_sort(F.collect_list(F.struct("at", "dist", "freq", "overlap", "dfs", F.col("anc").alias("node")))).alias("walk"))
    cands = walk.withColumn("x", F.explode(_climb(F.col("walk"), least_overlap))).groupBy("clade", "x.node").agg(F.first("x.freq").alias("freq"), F.first("x.overlap").alias("overlap"), F.first("x.dfs").alias("dfs"), F.first("size").alias("size"))
    score = F.least("freq", F.lit(clip)) * F.col("overlap") * F.col("overlap")
    ranked = cands.withColumns({"i": F.row_number().over(W.partitionBy("clade").orderBy(score.desc(), "dfs")), "n": F.count(F.lit(1)).over(W.partitionBy("clade"))})
    left = materialize(ranked, "clade-candidates")
    done = None
    while left.take(1):
        # a clade is settled where it comes first in order among all that want its best free node
        first = left.withColumn("_b", F.min("i").over(W.partitionBy("clade"))).withColumn("_w", F.row_number().over(W.partitionBy("node").orderBy("n", F.col("size").desc(), "clade")))
        won = materialize(first.where("i = _b and _w = 1").select("clade", "node", "freq", "overlap"), "clade-won")
        done = won if done is None else done.union(won)
        left = materialize(left.join(won.select("clade"), "clade", "left_anti").join(won.select("node"), "node", "left_anti"), "clade-candidates")
    return done if done is not None else ranked.select("clade", "node", "freq", "overlap").limit(0)
