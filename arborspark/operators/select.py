"""Sample selections: every operator returns a table ``(node)`` of leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions.nucleotides import matches
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize


def in_clade(b: Bundle, label: str) -> DataFrame:
    """SE-1: leaves below the first node in dfs that carries the label."""
    at = b.node.where((F.col("c0") == label) | (F.col("c1") == label)).agg(F.min_by("node", "dfs").alias("anc"))
    return b.closure.join(F.broadcast(at), "anc").join(b.leaf.select("node"), "node").select("node")


def with_mutation(b: Bundle, pos: int, mut: int) -> DataFrame:
    """SE-2: leaves whose nearest event at the site has the allele."""
    return b.state.where((F.col("pos") == pos) & (F.col("mut") == mut)).join(b.leaf.select("node"), "node", "left_semi").select("node")


def event_counts(b: Bundle) -> DataFrame:
    return b.node.join(b.event.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def max_parsimony(b: Bundle, most: int) -> DataFrame:
    """SE-3: leaves with at most so many terminal events."""
    return event_counts(b).where(F.col("is_leaf") & (F.col("n") <= most)).select("node")


def representatives(b: Bundle, per_clade: int, seed: int = 1) -> DataFrame:
    """SE-4: (clade, node): a seeded pick of leaves for each label of either column; all of them if there are no more."""
    labels = b.node.select(F.col("node").alias("anc"), F.explode(F.array("c0", "c1")).alias("clade")).where("clade is not null")
    rank = F.row_number().over(W.partitionBy("clade").orderBy(seeded("node", seed), "node"))
    return b.closure.join(labels, "anc").join(b.leaf.select("node"), "node").select("node", "clade").distinct().withColumn("i", rank).where(F.col("i") <= per_clade).select("clade", "node")


def seeded(name: str, seed: int):
    """QX-11: an order by an explicit seed."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(name)))


def both(one: DataFrame, two: DataFrame) -> DataFrame:
    """SE-5, ST-1."""
    return one.join(two, "node", "left_semi")


def path_totals(b: Bundle) -> DataFrame:
    """TR-6: (node, total, longest): events on the root path, and the most on one branch; the root's own left out."""
    counts = event_counts(b).where("parent is not null").select(F.col("node").alias("anc"), F.col("n"))
    return b.closure.join(counts, "anc", "left").groupBy("node").agg(F.sum(F.coalesce("n", F.lit(0))).alias("total"), F.max(F.coalesce("n", F.lit(0))).alias("longest"))


def short_branches(b: Bundle, most: int) -> DataFrame:
    """SE-7: leaves with no branch of more events on the root path."""
    return b.leaf.select("node").join(path_totals(b).where(F.col("longest") <= most), "node").select("node")


def short_paths(b: Bundle, most: int) -> DataFrame:
    """SE-8: leaves with a root path of at most so many events."""
    return b.leaf.select("node").join(path_totals(b).where(F.col("total") <= most), "node").select("node")


def by_name(b: Bundle, pattern: str) -> DataFrame:
    """SE-10: full match of the leaf's name."""
    return b.leaf.where(matches(F.col("node"), pattern)).select("node")


def thin(samples: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """SE-11, SO-7: seeded thinning to n samples."""
    return samples.orderBy(seeded("node", seed), "node").limit(n)


def fill(b: Bundle, samples: DataFrame, n: int, seed: int = 1, below_lca: bool = False) -> DataFrame:
    """SE-11: the samples and seeded others up to n, of the whole tree or of what lies below their common ancestor; thinned if there are more."""
    pool = under_lca(b, samples) if below_lca else b.leaf.select("node")
    first = samples.select("node").distinct().withColumn("own", F.lit(0))
    ranked = first.unionByName(pool.join(first, "node", "left_anti").withColumn("own", F.lit(1)))
    return ranked.orderBy("own", seeded("node", seed), "node").limit(n).select("node")


def sampled(nodes: DataFrame, share: float, seed: int = 1, blacklist: DataFrame | None = None) -> DataFrame:
    """SE-18: a seeded share of the nodes, none of the blacklist."""
    kept = nodes if blacklist is None else nodes.join(blacklist.select("node"), "node", "left_anti")
    return kept if share >= 1 else kept.where(F.substring(seeded("node", seed), 1, 8) < f"{int(share * 2**32):08x}")


def informative(genotypes: DataFrame) -> DataFrame:
    """SE-19: sites at which not every sample is unknown."""
    return genotypes.groupBy("pos").agg(F.max((F.col("allele") != 15).cast("int")).alias("_k")).where("_k = 1").select("pos")


def union(*selections: DataFrame) -> DataFrame:
    """ST-4: nodes of any selection, once."""
    out = selections[0].select("node")
    for s in selections[1:]:
        out = out.union(s.select("node"))
    return out.distinct()


def first(samples: DataFrame, n: int, by: str = "dfs") -> DataFrame:
    """SO-6."""
    return samples.orderBy(by, "node").limit(n).select("node")


def nearest_each(b: Bundle, targets: DataFrame, k: int) -> DataFrame:
    """SE-6 for every one of ``targets(target)`` at once: (target, node, place). QX-16: all leaves if there are no more than k."""
    path = targets.select("target").distinct().join(b.closure.withColumnRenamed("node", "target"), "target").join(b.node.select(F.col("node").alias("anc"), "n_leaves"), "anc")
    top = path.groupBy("target").agg(F.max(F.when(F.col("n_leaves") <= k, F.struct("dist", "anc")))["anc"].alias("last"), F.min(F.when(F.col("n_leaves") > k, F.struct("dist", "anc")))["anc"].alias("wide"))
    top = top.withColumn("top", F.coalesce("wide", "last"))
    below = top.join(b.closure.select("node", F.col("anc").alias("top"), F.col("dist").alias("up")), "top").join(b.leaf.select("node", "dfs"), "node")
    inside = top.join(b.closure.select("node", F.col("anc").alias("last")), "last").select("target", "node", F.lit(0).alias("outer"))
    total = path_totals(b).select("node", "total")
    far = below.join(total, "node").join(total.select(F.col("node").alias("top"), F.col("total").alias("base")), "top").join(inside, ["target", "node"], "left")
    order = W.partitionBy("target").orderBy(F.coalesce("outer", F.lit(1)), F.col("total") - F.col("base"), "dfs")
    return far.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("target", "node", "place")


def nearest(b: Bundle, target: str, k: int) -> DataFrame:
    """SE-6: k leaves: the largest ancestor with at most k leaves, then those nearest below the next one (ties: dfs)."""
    path = b.closure.where(F.col("node") == target).join(b.node.select(F.col("node").alias("anc"), "n_leaves"), "anc")
    last = path.where(F.col("n_leaves") <= k).agg(F.max_by("anc", "dist").alias("last"))
    wide = path.where(F.col("n_leaves") > k).agg(F.min_by("anc", "dist").alias("wide"))
    inside = b.closure.join(F.broadcast(last), F.col("anc") == F.col("last")).select("node").withColumn("inside", F.lit(1))
    outer = wide.join(last).select(F.coalesce("wide", "last").alias("top"))
    below = b.closure.join(F.broadcast(outer), F.col("anc") == F.col("top")).select("node", F.col("dist").alias("up")).join(b.leaf.select("node", "dfs"), "node")
    cost = b.closure.join(below, "node").where("dist < up").select("node", F.col("anc").alias("a")).join(event_counts(b).select(F.col("node").alias("a"), "n"), "a").groupBy("node").agg(F.sum("n").alias("far"))
    ranked = below.join(inside, "node", "left").join(cost, "node", "left").orderBy(F.coalesce("inside", F.lit(0)).desc(), F.coalesce("far", F.lit(0)), "dfs").limit(k)
    return ranked.select("node")


def under_lca(b: Bundle, samples: DataFrame) -> DataFrame:
    """SE-12: all leaves below the deepest common ancestor of the samples, by dfs intervals."""
    span = samples.join(b.node.select("node", "dfs"), "node").agg(F.min("dfs").alias("lo"), F.max("dfs").alias("hi"))
    top = b.node.join(F.broadcast(span), (F.col("dfs") <= F.col("lo")) & (F.col("dfs_end") >= F.col("hi"))).agg(F.max_by(F.struct("dfs", "dfs_end"), "level").alias("t")).select("t.*")
    return b.leaf.select("node", F.col("dfs").alias("at")).join(F.broadcast(top), F.col("at").between(F.col("dfs"), F.col("dfs_end"))).select("node")


def distances(b: Bundle, target: str) -> DataFrame:
    """SE-13, QX-3 (no early stop): (node, distance) in events between the target and every other leaf, exact over the path through the LCA."""
    total = path_totals(b).select("node", "total")
    mine = b.closure.where(F.col("node") == target).select("anc", F.col("dist").alias("up"))
    joint = b.closure.join(F.broadcast(mine), "anc").join(b.leaf.select("node"), "node").where(F.col("node") != target).groupBy("node").agg(F.min_by("anc", "up").alias("lca"))
    t = total.where(F.col("node") == target).select(F.col("total").alias("t"))
    return joint.join(total, "node").join(total.select(F.col("node").alias("lca"), F.col("total").alias("l")), "lca").join(F.broadcast(t)).select("node", (F.col("total") + F.col("t") - 2 * F.col("l")).alias("distance"))


def candidates(b: Bundle, min_events: int, min_leaves: int) -> DataFrame:
    """SE-16, RC-1: branches with enough events and leaves, not the root."""
    return event_counts(b).where((F.col("n") >= min_events) & (F.col("n_leaves") >= min_leaves) & F.col("parent").isNotNull()).select("node", "n", "n_leaves")


def cover(b: Bundle, queries: list[str], k: int) -> dict[str, list[str]]:
    """TR-29: {query: leaves}: for each query in order that no earlier set holds, its k nearest leaves.

    The sets of all queries are found in one job. Only which queries lie in which set goes to the driver
    for the greedy choice (queries times k rows at most), then the chosen sets.
    """
    spark = b.node.sparkSession
    names = spark.createDataFrame([(q,) for q in dict.fromkeys(queries)], "target string")
    sets = materialize(nearest_each(b, names, k), "cover-sets")
    inside: dict[str, set[str]] = {}
    for r in sets.join(names.withColumnRenamed("target", "node"), "node").select("target", "node").collect():
        inside.setdefault(r["target"], set()).add(r["node"])
    held: set[str] = set()
    chosen = []
    for q in dict.fromkeys(queries):
        if q not in held:
            chosen.append(q)
            held |= {q} | inside.get(q, set())
    found: dict[str, list[str]] = {q: [] for q in chosen}
    for r in sets.where(F.col("target").isin(chosen)).collect():
        found[r["target"]].append(r["node"])
    return {q: sorted(v) for q, v in found.items()}
