"""Parts and edits of a tree: pruning, subtrees, node edits, clean-up before placement, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.functions.nucleotides import first_allele
from arborspark.operators import select, tree
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize


def prune(b: Bundle, samples: DataFrame, keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """TR-14: (node, parent) and events without the listed samples, or with these alone; nodes of one child are spliced."""
    rest = b.leaf.select("node").join(samples.select("node"), "node", "left_semi" if keep else "left_anti")
    return tree.induced(b.node, b.closure, b.event, rest)


def restrict(b: Bundle, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TR-15: the tree of the leaves that ``present(sample)`` names; absent ones go, nodes of one child are spliced."""
    return prune(b, present.select(F.col("sample").alias("node")).distinct(), keep=True)


def subtree_members(b: Bundle, targets: DataFrame, size: int, seed: int = 1, anchors: DataFrame | None = None, near: float = 0.8) -> DataFrame:
    """TR-28: (subtree, node): for each of ``targets(target)`` a share ``near`` of its nearest leaves, seeded others up to ``size``, and the anchors.

    The others of a subtree are the first leaves in an order of its own seed, so a bounded run of them
    (``size`` from a common seeded order) is enough for all subtrees.
    """
    close = materialize(select.nearest_each(b, targets, max(1, int(size * near))).select(F.col("target").alias("subtree"), "node"), "subtree-near")
    pool = select.thin(b.leaf.select("node"), 2 * size, seed)  # at most 2 * size rows
    names = targets.select(F.col("target").alias("subtree")).distinct()
    others = names.join(F.broadcast(pool)).join(close, ["subtree", "node"], "left_anti")
    order = F.md5(F.concat(F.lit(f"{seed}:"), "subtree", F.lit(":"), "node"))
    from pyspark.sql.window import Window as W

    room = close.groupBy("subtree").agg((F.lit(size) - F.count(F.lit(1))).alias("room"))
    picked = others.withColumn("i", F.row_number().over(W.partitionBy("subtree").orderBy(order, "node"))).join(room, "subtree").where("i <= room").select("subtree", "node")
    out = close.union(picked)
    if anchors is not None:
        out = out.union(names.join(F.broadcast(anchors.select("node"))).select("subtree", "node"))
    return out.distinct()


def induced_each(b: Bundle, members: DataFrame) -> DataFrame:
    """TR-13 for every subtree of ``members(subtree, node)`` at once: (subtree, node, parent)."""
    members = members.select("subtree", "node").distinct()
    paths = members.join(b.closure, "node").select("subtree", F.col("anc").alias("node")).distinct().join(b.node.select("node", "parent"), "node")
    branching = paths.where("parent is not null").groupBy("subtree", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("subtree", "node")
    kept = materialize(branching.union(members).distinct(), "induced-each")
    up = kept.join(b.closure.where("dist > 0"), "node").join(kept.select("subtree", F.col("node").alias("anc")), ["subtree", "anc"]).groupBy("subtree", "node").agg(F.min_by("anc", "dist").alias("parent"))
    return kept.join(up, ["subtree", "node"], "left")


def random_subtree(b: Bundle, samples: DataFrame, size: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """TR-28: one tree of the samples and seeded others up to ``size``."""
    return tree.induced(b.node, b.closure, b.event, select.fill(b, samples, size, seed))


def move(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """TR-21: (node, parent) with one node below another parent."""
    return edges.withColumn("parent", F.when(F.col("node") == node, parent).otherwise(F.col("parent")))


def create(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """TR-21: one more node."""
    return edges.select("node", "parent").union(edges.sparkSession.createDataFrame([(node, parent)], "node string, parent string"))


def remove(edges: DataFrame, node: str) -> DataFrame:
    """TR-21: without one node; its children go to its parent."""
    gone = edges.where(F.col("node") == node).select(F.col("node").alias("parent"), F.col("parent").alias("_up"))
    rest = edges.where(F.col("node") != node).select("node", "parent")
    return rest.join(F.broadcast(gone), "parent", "left").select("node", F.when(F.col("parent") == node, F.col("_up")).otherwise(F.col("parent")).alias("parent"))


def rename(table: DataFrame, names: DataFrame, *columns: str) -> DataFrame:
    """TR-21, SC-17: node names of ``names(old, new)`` put in place in the given columns; others stay."""
    out = table
    for c in columns:
        out = out.join(names.select(F.col("old").alias(c), F.col("new").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return out.select(*table.columns)


def copy_subtree(edges: DataFrame, event: DataFrame, closed: DataFrame, node: str, parent: str, prefix: str) -> tuple[DataFrame, DataFrame]:
    """TR-21: edges and events with a copy of a node and all below it, under ``parent``; copies are named prefix + name."""
    below = closed.where(F.col("anc") == node).select("node")
    name = lambda c: F.concat(F.lit(prefix), c)
    new = edges.join(below, "node").select(name("node").alias("node"), F.when(F.col("node") == node, F.lit(parent)).otherwise(name("parent")).alias("parent"))
    events = event.join(below, "node").select(name("node").alias("node"), *[c for c in event.columns if c != "node"])
    return edges.select("node", "parent").union(new), event.select("node", *[c for c in event.columns if c != "node"]).union(events)


def with_artificial_root(edges: DataFrame, event: DataFrame, name: str = "root_above") -> DataFrame:
    """TR-30: (node, parent) with a new root above one that carries events; else as given."""
    top = edges.where("parent is null").select("node")
    mutated = top.join(event.select("node").distinct(), "node", "left_semi")
    new = mutated.select(F.lit(name).alias("node"), F.lit(None).cast("string").alias("parent"))
    lifted = edges.select("node", "parent").join(mutated.withColumn("_m", F.lit(True)), "node", "left")
    return lifted.select("node", F.when(F.col("_m"), F.lit(name)).otherwise(F.col("parent")).alias("parent")).union(new)


def above_condensed(edges: DataFrame, event: DataFrame, condensed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TR-30: a node ``<name>_above`` over each of ``condensed(node)`` that carries events; it takes the events, the condensed leaf has none."""
    mutated = condensed.select("node").distinct().join(event.select("node").distinct(), "node", "left_semi")
    name = F.concat("node", F.lit("_above"))
    held = mutated.withColumn("_above", name)
    lifted = edges.select("node", "parent").join(held, "node", "left")
    new = lifted.where("_above is not null").select(F.col("_above").alias("node"), "parent")
    out = lifted.select("node", F.coalesce("_above", "parent").alias("parent")).union(new)
    return out, event.join(held, "node", "left").withColumn("node", F.coalesce("_above", "node")).select(*event.columns)


def clean_events(node: DataFrame, event: DataFrame) -> DataFrame:
    """TR-31: leaf events that the parent's allele fits go, the rest take their lowest allele; inner no-ops go."""
    rows = event.join(node.select("node", "is_leaf"), "node")
    kept = F.when(F.col("is_leaf"), F.col("par").bitwiseAND(F.col("mut")) == 0).otherwise(F.col("par") != F.col("mut"))
    return rows.where(kept).withColumn("mut", F.when(F.col("is_leaf"), first_allele(F.col("mut"))).otherwise(F.col("mut"))).select(*event.columns)


def with_metadata(samples: DataFrame, metadata: DataFrame, key: str = "sample") -> DataFrame:
    """JO-6: samples with the columns of the first row of their name in ``metadata``; clashing names get the suffix ``_meta``."""
    given = metadata.columns[0]
    names = {c: f"{c}_meta" for c in metadata.columns[1:] if c in samples.columns}
    once = metadata.withColumn("_at", F.monotonically_increasing_id())
    first = once.groupBy(F.col(given).alias("_key")).agg(*(F.min_by(c, "_at").alias(names.get(c, c)) for c in metadata.columns[1:]))
    return samples.join(first, F.col(key) == F.col("_key"), "left").drop("_key")


def merge_metadata(*tables: DataFrame, key: str = "strain") -> DataFrame:
    """SC-12: one row per key over several tables: the first row of a key in each, later tables' filled cells over earlier ones."""
    out = None
    for t in tables:
        if key not in t.columns:
            raise ValueError(f"metadata without a column {key}")
        rows = t.withColumn("_at", F.monotonically_increasing_id()).groupBy(key).agg(*(F.min_by(F.nullif(c, F.lit("")), "_at").alias(c) for c in t.columns if c != key))
        if out is None:
            out = rows
            continue
        both = [c for c in rows.columns if c in out.columns and c != key]
        joined = out.join(rows.withColumnsRenamed({c: f"_new_{c}" for c in both}), key, "full")
        for c in both:
            joined = joined.withColumn(c, F.coalesce(f"_new_{c}", c)).drop(f"_new_{c}")
        out = joined
    return out


def mask_sites(event: DataFrame, sites: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """MA-1: events at ``sites(pos)`` get the negative of their position, everywhere or at ``nodes(node)`` only."""
    hit = event.join(sites.select("pos").distinct().withColumn("_m", F.lit(True)), "pos", "left")
    if nodes is not None:
        hit = hit.join(nodes.select("node").distinct().withColumn("_n", F.lit(True)), "node", "left").withColumn("_m", F.col("_m") & F.col("_n")).drop("_n")
    return hit.withColumn("pos", F.when(F.col("_m"), -F.abs("pos")).otherwise(F.col("pos"))).select(*event.columns)


def local_mask(event: DataFrame, closed: DataFrame, pairs: DataFrame, missing: DataFrame, most: int, width: int = 1024) -> DataFrame:
    """MA-2: events of a sample at positions that a near sample does not know.

    ``pairs(a, z, distance)`` are sample pairs, ``missing(sample, start, stop)`` unknown ranges. An event of
    ``a`` is masked where some ``z`` at most ``most`` changes away has no base at its position.
    """
    near = pairs.where(F.col("distance") <= most)
    near = near.select(F.col("a").alias("node"), F.col("z").alias("sample")).union(near.select(F.col("z").alias("node"), F.col("a").alias("sample"))).distinct()
    gaps = near.join(missing, "sample").select(F.col("node").alias("_s"), F.col("start").alias("lo"), F.col("stop").alias("hi"))
    points = event.select(F.col("node").alias("_e"), F.col("pos").alias("x")).distinct()
    hit = tree.range_join(points, gaps, width).where("_s = _e").select(F.col("_e").alias("node"), F.col("x").alias("pos")).distinct().withColumn("_m", F.lit(True))
    return event.join(hit, ["node", "pos"], "left").withColumn("masked", F.coalesce("_m", F.lit(False))).drop("_m")
