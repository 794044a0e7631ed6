"""Tree operators on plain tables.

node(node, parent, level, dfs, dfs_end, is_leaf, c0, c1), event(node, pos, ref, par, mut). Paths are
held as a closure table (node, anc, dist), built in log2(depth) joins; subtree tests on large trees
use the dfs interval, bucketed to an equi-join by ``range_join``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.plans.scratch import materialize


def closure(node: DataFrame) -> DataFrame:
    """TR-3: every (node, ancestor-or-self, distance), by pointer doubling."""
    known = node.select("node", F.col("node").alias("anc"), F.lit(0).alias("dist")).union(node.where("parent is not null").select("node", F.col("parent").alias("anc"), F.lit(1).alias("dist")))
    known = materialize(known, "closure")
    reach = 1
    while True:
        far = known.where(F.col("dist") == reach).select("node", F.col("anc").alias("mid"))
        more = far.join(known.where("dist > 0").select(F.col("node").alias("mid"), "anc", "dist"), "mid").select("node", "anc", (F.col("dist") + reach).alias("dist"))
        new = materialize(more, "closure")
        if not new.take(1):
            return known
        known, reach = materialize(known.union(new), "closure"), reach * 2


def ordered_index(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Adds the 0-based rank by ``keys``: range partitions are sorted apart, then shifted by their counts."""
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))  # one row per partition
    before = counts.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return rows.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn(out, (F.col("_base") + F.col("_at").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_at", "_p", "_base")


def running_sum(df: DataFrame, keys: list[str], weight: str, out: str, parts: int) -> DataFrame:
    """Adds the sum of ``weight`` over the rows before each by ``keys`` (nulls last): like ``ordered_index``, with sums in place of counts."""
    order = [F.asc_nulls_last(k) for k in keys]
    rows = materialize(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")
    rows = rows.withColumn("_p", F.shiftright("_at", 33))
    sums = rows.groupBy("_p").agg(F.sum(weight).alias("_n"))  # one row per partition
    before = sums.select("_p", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.coalesce(F.sum(weight).over(W.partitionBy("_p").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(before), "_p").withColumn(out, (F.col("_base") + within).cast("long")).drop("_at", "_p", "_base")


def with_intervals(node: DataFrame, closed: DataFrame) -> DataFrame:
    """TR-1, TR-5, TR-33: adds dfs_end and n_leaves from the closure."""
    size = closed.join(node.select("node", "is_leaf"), "node").groupBy(F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("size"), F.sum(F.col("is_leaf").cast("long")).alias("n_leaves"))
    return node.join(size, "node").withColumn("dfs_end", F.col("dfs") + F.col("size") - 1)


def range_join(inner: DataFrame, outer: DataFrame, width: int) -> DataFrame:
    """JO-1: ``inner(x)`` in ``outer(lo, hi)`` as an equi-join on buckets of ``width`` plus a filter."""
    left = inner.withColumn("_b", F.floor(F.col("x") / width))
    right = outer.withColumn("_b", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))))
    return left.join(right, "_b").where(F.col("x").between(F.col("lo"), F.col("hi"))).drop("_b")


def path_events(closed: DataFrame, event: DataFrame) -> DataFrame:
    """Events on the root path of every node: (node, dist, pos, ref, par, mut)."""
    return closed.join(event.withColumnRenamed("node", "anc"), "anc").select("node", "dist", "pos", "ref", "par", "mut")


def state(closed: DataFrame, event: DataFrame) -> DataFrame:
    """TR-9, WN-1: state of every node at every site with an event above it: the nearest one's allele."""
    return path_events(closed, event).groupBy("node", "pos").agg(F.min_by("mut", "dist").alias("mut"), F.first("ref").alias("ref"))


def haplotype(closed: DataFrame, event: DataFrame) -> DataFrame:
    """TR-9: sites whose state differs from the reference."""
    return state(closed, event).where("mut <> ref")


def repair(closed: DataFrame, event: DataFrame) -> DataFrame:
    """TR-25: parent states from the nearest ancestor event, no-op events dropped."""
    above = event.select("node", "pos").join(closed.where("dist > 0"), "node").join(event.select(F.col("node").alias("anc"), "pos", F.col("mut").alias("m")), ["anc", "pos"])
    near = above.groupBy("node", "pos").agg(F.min_by("m", "dist").alias("par"))
    return event.drop("par").join(near, ["node", "pos"], "left").withColumn("par", F.coalesce("par", "ref")).where("par <> mut").select("node", "pos", "ref", "par", "mut")


def compose(closed: DataFrame, event: DataFrame) -> DataFrame:
    """TR-10: net change per (node, site): parent of the earliest event, allele of the latest; no-ops dropped."""
    return path_events(closed, event).groupBy("node", "pos").agg(F.max_by("par", "dist").alias("par"), F.min_by("mut", "dist").alias("mut")).where("par <> mut")


def merge_events(mine: DataFrame, theirs: DataFrame, policy: str) -> DataFrame:
    """TR-11 on (node, pos, par, mut): keep_self, keep_other, no_duplicate (fails), merge (chains), invert_merge."""
    a = mine.select("node", "pos", F.col("par").alias("p1"), F.col("mut").alias("m1"))
    b = theirs.select("node", "pos", *((F.col("mut").alias("p2"), F.col("par").alias("m2")) if policy == "invert_merge" else (F.col("par").alias("p2"), F.col("mut").alias("m2"))))
    both = a.join(b, ["node", "pos"], "full")
    if policy == "no_duplicate":
        clash = F.when(F.col("m1").isNotNull() & F.col("m2").isNotNull(), F.raise_error(F.lit("two events at one site")).cast("int"))
        return both.select("node", "pos", F.coalesce("p1", "p2", clash).alias("par"), F.coalesce(clash, "m1", "m2").alias("mut"))
    if policy in ("keep_self", "keep_other"):
        one, two = ("1", "2") if policy == "keep_self" else ("2", "1")
        return both.select("node", "pos", F.coalesce(f"p{one}", f"p{two}").alias("par"), F.coalesce(f"m{one}", f"m{two}").alias("mut"))
    return both.select("node", "pos", F.coalesce("p1", "p2").alias("par"), F.coalesce("m2", "m1").alias("mut")).where("par <> mut")


def three_way(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """TR-12: (pos, side) with side mine, theirs or common."""
    a, b = mine.select("pos", F.col("mut").alias("a")), theirs.select("pos", F.col("mut").alias("b"))
    side = F.when(F.col("b").isNull(), "mine").when(F.col("a").isNull(), "theirs").when(F.col("a") == F.col("b"), "common")
    return a.join(b, "pos", "full").select("pos", F.coalesce(side, F.lit("both")).alias("side"))


def lca(closed: DataFrame, groups: DataFrame) -> DataFrame:
    """TR-7: ``groups(grp, node)`` -> the deepest node that is an ancestor-or-self of all members."""
    sizes = groups.groupBy("grp").agg(F.countDistinct("node").alias("n"))
    level = closed.groupBy("node").agg(F.max("dist").alias("level"))
    hit = groups.distinct().join(closed, "node").groupBy("grp", "anc").agg(F.count(F.lit(1)).alias("k")).join(sizes, "grp").where("k = n")
    return hit.join(level.withColumnRenamed("node", "anc"), "anc").groupBy("grp").agg(F.max_by("anc", "level").alias("lca"))


def induced(node: DataFrame, closed: DataFrame, event: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TR-13: (node, parent) and composed events of the subtree that joins ``samples(node)``.

    Kept are samples, and ancestors with two or more children that lead to samples.
    """
    paths = samples.select("node").join(closed, "node").select(F.col("anc").alias("node")).distinct().join(node.select("node", "parent"), "node")
    branching = paths.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("node")
    kept = materialize(branching.union(samples.select("node")).distinct(), "induced")
    up = kept.join(closed.where("dist > 0"), "node").join(kept.select(F.col("node").alias("anc")), "anc").groupBy("node").agg(F.min_by("anc", "dist").alias("parent"), F.min("dist").alias("gap"))
    edges = kept.join(up, "node", "left")
    between = edges.join(closed, "node").where("gap is null or dist < gap").select("node", "anc", "dist")
    return edges.select("node", "parent"), compose(between, event)


def collapse(node: DataFrame, closed: DataFrame, event: DataFrame) -> DataFrame:
    """TR-16: (node, parent) without internal nodes that carry no event; the root stays."""
    kept = node.where("is_leaf or parent is null").select("node").union(event.select("node")).distinct()
    up = kept.join(closed.where("dist > 0"), "node").join(kept.select(F.col("node").alias("anc")), "anc").groupBy("node").agg(F.min_by("anc", "dist").alias("parent"))
    return kept.join(up, "node", "left")


def condense(node: DataFrame, event: DataFrame) -> DataFrame:
    """TR-17: (node, members) for parents with two or more leaves without an event."""
    plain = node.where("is_leaf").join(event.select("node").distinct(), "node", "left_anti")
    groups = plain.groupBy("parent").agg(F.array_sort(F.collect_list("node")).alias("members"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    return groups.select(F.concat(F.lit("node_"), "parent", F.lit("_condensed_"), "n", F.lit("_leaves")).alias("node"), "parent", "members", "n")


def uncondense(condensed: DataFrame) -> DataFrame:
    """TR-18: one row per member."""
    return condensed.select("parent", F.explode("members").alias("node"))


def resolve_polytomies(node: DataFrame) -> DataFrame:
    """TR-19: (node, parent) with at most two children each: n children need n - 2 new nodes in a caterpillar."""
    w = W.partitionBy("parent").orderBy("dfs")
    kids = node.where("parent is not null").withColumn("i", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("parent")))
    name = lambda i: F.concat(F.col("parent"), F.lit("_polytomy_"), i.cast("string"))
    hang = F.when((F.col("n") <= 2) | (F.col("i") == 1), F.col("parent")).otherwise(name(F.least(F.col("i") - 1, F.col("n") - 2)))
    moved = kids.select("node", hang.alias("parent"))
    wide = kids.where("n > 2 and i between 2 and n - 1")
    new = wide.select(name(F.col("i") - 1).alias("node"), F.when(F.col("i") == 2, F.col("parent")).otherwise(name(F.col("i") - 2)).alias("parent"))
    return moved.union(new).union(node.where("parent is null").select("node", F.lit(None).cast("string").alias("parent")))


def reroot(node: DataFrame, closed: DataFrame, event: DataFrame, new_root: str, old_name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """TR-20: (node, parent) and events (node, pos, ref, par, mut) with ``new_root`` on top.

    The edges of the root path are turned round and their events inverted. The reference of a site
    becomes the state at the new root. A leaf stays a leaf: its parent becomes the root then. The former
    root gets ``old_name`` if given; without it and with one child left, it keeps its place.
    """
    at = node.where(F.col("node") == new_root).select("is_leaf", "parent").first()
    top = at["parent"] if at["is_leaf"] and at["parent"] is not None else new_root
    path = closed.where(F.col("node") == top).select(F.col("anc").alias("node"), "dist")
    turned = path.where("dist > 0").join(path.select(F.col("node").alias("child"), (F.col("dist") + 1).alias("dist")), "dist").select("node", F.col("child").alias("to"))
    edges = node.select("node", "parent").join(turned, "node", "left").select("node", F.when(F.col("node") == top, None).otherwise(F.coalesce("to", "parent")).alias("parent"))
    up = turned.select(F.col("to").alias("node"), F.col("node").alias("carrier"))
    net = state(closed.where(F.col("node") == top), event).select("pos", F.col("mut").alias("_ref"))
    own = event.join(node.where("parent is null").select("node"), "node", "left_anti")  # events above the root only change its reference
    moved = own.join(up, "node", "left").join(net, "pos", "left").select(F.coalesce("carrier", "node").alias("node"), "pos", F.coalesce("_ref", "ref").alias("ref"), F.when(F.col("carrier").isNull(), F.col("par")).otherwise(F.col("mut")).alias("par"), F.when(F.col("carrier").isNull(), F.col("mut")).otherwise(F.col("par")).alias("mut"))
    if old_name:
        old = node.where("parent is null").first()["node"]
        name = lambda c: F.when(F.col(c) == old, old_name).otherwise(F.col(c)).alias(c)
        edges, moved = edges.select(name("node"), name("parent")), moved.select(name("node"), "pos", "ref", "par", "mut")
    return edges, moved


def rotate(node: DataFrame) -> DataFrame:
    """TR-22: place of each child under its parent by descending subtree size, then dfs."""
    w = W.partitionBy("parent").orderBy(F.col("size").desc(), "dfs")
    return node.where("parent is not null").select("node", "parent", F.row_number().over(w).alias("child_ord"))


def islands(points: DataFrame, key: str, pos: str) -> DataFrame:
    """TR-26, WN-6, WN-7: runs of consecutive positions per key."""
    grp = F.col(pos) - F.row_number().over(W.partitionBy(key).orderBy(pos))
    return points.select(key, pos).distinct().withColumn("_g", grp).groupBy(key, "_g").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count(F.lit(1)).alias("n")).drop("_g")


def descendant_alleles(closed: DataFrame, event: DataFrame) -> DataFrame:
    """TR-27: union of alleles that events put below or at each node, per site."""
    return closed.join(event, "node").groupBy(F.col("anc").alias("node"), "pos").agg(F.bit_or("mut").alias("alleles"))


def fold_up(node: DataFrame, leaf_value: str, merge, out: str) -> DataFrame:
    """TR-4: bottom-up fold by level for rules that are no plain aggregate: parent value = merge(children); one table per level."""
    top = node.agg(F.max("level")).first()[0]
    below = done = None
    for level in range(top, -1, -1):
        now = node.where(F.col("level") == level).select("node", "parent", "is_leaf", F.expr(leaf_value).alias(out))
        if below is not None:
            kids = below.groupBy(F.col("parent").alias("node")).agg(merge(F.col(out)).alias("_v"))
            now = now.join(kids, "node", "left").select("node", "parent", "is_leaf", F.when(F.col("is_leaf"), F.col(out)).otherwise(F.col("_v")).alias(out))
        below = materialize(now.select("node", "parent", out), "fold")
        done = below if done is None else done.union(below)
    return done.select("node", out)


def node_distances(b_node: DataFrame, closed: DataFrame, pairs: DataFrame) -> DataFrame:
    """FN-14, TR-8: ``pairs(a, z)`` -> (a, z, distance) in edges, over the lowest common ancestor."""
    up = pairs.select("a", "z").distinct().join(closed.select(F.col("node").alias("a"), "anc", F.col("dist").alias("da")), "a")
    both = up.join(closed.select(F.col("node").alias("z"), "anc", F.col("dist").alias("dz")), ["z", "anc"])
    return both.groupBy("a", "z").agg(F.min(F.col("da") + F.col("dz")).alias("distance"))


def parsimony_score(event: DataFrame) -> DataFrame:
    """TR-8: the valid events of the whole tree (masked ones included, no-ops left out)."""
    return event.where("par <> mut").agg(F.count(F.lit(1)).alias("parsimony"))


def within(closed: DataFrame, changed: DataFrame, radius: int) -> DataFrame:
    """SE-17: nodes within ``radius`` edges of any of ``changed(node)``, these included."""
    up = changed.select("node").distinct().join(closed.where(F.col("dist") <= radius), "node").groupBy("anc").agg(F.min("dist").alias("up"))
    return up.join(closed.where(F.col("dist") <= radius), "anc").where(F.col("up") + F.col("dist") <= radius).select("node").distinct()


def other_preorder(node: DataFrame) -> DataFrame:
    """TR-24: (node, dfs, stack_dfs): the preorder that takes the last child first, beside dfs.

    Before a node stand its ancestors, and the subtrees of later siblings of them and of itself: its number is
    its level and all nodes that come after its subtree in dfs.
    """
    total = node.agg(F.count(F.lit(1)).alias("n"))
    return node.join(F.broadcast(total)).select("node", "dfs", (F.col("n") - F.col("size") - F.col("dfs") + F.col("level")).cast("long").alias("stack_dfs"))
