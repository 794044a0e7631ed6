"""Regional confidences, introductions, and the density filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.operators.select import event_counts, path_totals
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize


def confidences(b: Bundle, members: DataFrame) -> DataFrame:
    """IN-1 (inferred): ``members(node)`` of leaves -> (node, confidence) that a node lies in the region.

    1 / (1 + (ID / IL) / (OD / OL)) with the least event distance to, and the number of, members (I) and
    other leaves (O) below; 1 or 0 where all leaves are of one kind, IL / (IL + OL) where both distances are 0.
    """
    total = path_totals(b).select("node", "total")
    leaves = b.leaf.select("node").join(total, "node").join(members.select("node", F.lit(True).alias("_in")).distinct(), "node", "left")
    inside = F.col("_in").isNotNull()
    below = b.closure.join(leaves, "node").groupBy("anc").agg(F.count_if(inside).alias("il"), F.count_if(~inside).alias("ol"), F.min(F.when(inside, F.col("total"))).alias("it"), F.min(F.when(~inside, F.col("total"))).alias("ot"))
    near = below.join(total.withColumnRenamed("node", "anc"), "anc").withColumns({"a": (F.col("ot") - F.col("total")) * F.col("il"), "o": (F.col("it") - F.col("total")) * F.col("ol")})
    mixed = F.when(F.col("a") + F.col("o") == 0, F.col("il") / (F.col("il") + F.col("ol"))).otherwise(F.col("a") / (F.col("a") + F.col("o")))
    return near.select(F.col("anc").alias("node"), F.when(F.col("ol") == 0, 1.0).when(F.col("il") == 0, 0.0).otherwise(mixed).alias("confidence"))


def introductions(b: Bundle, members: DataFrame, threshold: float = 0.5) -> DataFrame:
    """IN-1 (inferred): (sample, introduction): the highest node of the member's root path with every confidence up to it at the threshold or above.

    Members with the same node are one cluster.
    """
    path = members.select("node").distinct().join(b.closure, "node").join(confidences(b, members).withColumnRenamed("node", "anc"), "anc")
    stop = path.groupBy("node").agg(F.min(F.when(F.col("confidence") < threshold, F.col("dist"))).alias("stop"))
    return path.join(stop, "node").where("stop is null or dist < stop").groupBy(F.col("node").alias("sample")).agg(F.max_by("anc", "dist").alias("introduction"))


def dense_leaves(b: Bundle, most: float, small: int = 150) -> DataFrame:
    """SE-9: leaves that the density filter drops, by level from the leaves up.

    A labelled node with fewer than ``small`` leaves exempts its inner nodes. A leaf with more than
    ``most`` events goes unless its parent is exempt. A node whose events per kept leaf (its own divided
    by the leaves) exceed ``most`` loses all leaves not below a labelled or exempt node; below
    1 / ``most`` it becomes exempt itself.
    """
    counts = event_counts(b).select("node", "parent", "level", "is_leaf", "n_leaves", "n", (F.greatest(F.coalesce(F.length("c0"), F.lit(0)), F.coalesce(F.length("c1"), F.lit(0))) > 0).alias("labelled"))
    small_clades = counts.where(F.col("labelled") & ~F.col("is_leaf") & (F.col("n_leaves") < small)).select(F.col("node").alias("anc"))
    exempt = b.closure.join(small_clades, "anc").select("node").distinct().withColumn("_e", F.lit(True))
    node = materialize(counts.join(exempt, "node", "left").withColumn("exempt", F.col("_e").isNotNull() & ~F.col("is_leaf")).drop("_e"), "density")
    parents = node.select(F.col("node").alias("parent"), F.col("exempt").alias("safe"))
    leaf = node.where("is_leaf").join(parents, "parent", "left").withColumn("direct", ~F.coalesce("safe", F.lit(True)) & (F.col("n") > most))
    leaf = materialize(leaf.select("node", "parent", "level", "direct", "n", "labelled"), "density-leaf")
    kept = leaf.select("parent", "level", (~F.col("direct")).cast("long").alias("leaves"), F.when(F.col("direct"), 0).otherwise(F.col("n")).alias("events"))
    top = node.agg(F.max("level")).first()[0]
    verdicts, below = None, None
    for level in range(top - 1, -1, -1):
        parts = kept.where(F.col("level") == level + 1).select("parent", "leaves", "events")
        parts = parts if below is None else parts.union(below.select("parent", "leaves", "events"))
        sums = parts.groupBy(F.col("parent").alias("node")).agg(F.sum("leaves").alias("l"), F.sum("events").alias("m"))
        here = node.where((F.col("level") == level) & ~F.col("is_leaf")).join(sums, "node").withColumn("density", F.when(F.col("l") > 0, (F.col("n") / F.col("l") + F.col("m")) / F.col("l")))
        chopped = F.coalesce(F.col("density") > most, F.lit(False))
        gone = chopped | (F.col("l") == 0)
        below = materialize(here.select("node", "parent", F.when(gone, 0).otherwise(F.col("l")).alias("leaves"), F.when(gone, 0).otherwise(F.col("m") + F.col("n")).alias("events"), chopped.alias("chopped"), (F.col("labelled") | F.col("exempt") | (~chopped & F.coalesce(F.col("density") < 1 / most, F.lit(False)))).alias("spared")), "density-level")
        now = below.select("node", "chopped", "spared")
        verdicts = now if verdicts is None else verdicts.union(now)
    if verdicts is None:
        return leaf.where("false").select("node")
    marks = verdicts.union(leaf.select("node", F.lit(False), "labelled")).where("chopped or spared").withColumnRenamed("node", "anc")
    hit = leaf.select("node").join(b.closure, "node").join(marks, "anc").groupBy("node").agg(F.min(F.when(F.col("chopped"), F.col("dist"))).alias("c"), F.min(F.when(F.col("spared"), F.col("dist"))).alias("s"))
    return leaf.where("direct").select("node").union(hit.where("c is not null and (s is null or c < s)").select("node")).distinct()
