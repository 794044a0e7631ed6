"""Revisions of a tree: reversions of a grandparent's event, masking, regional association."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.plans.scratch import materialize


def grandparent_reversions(node: DataFrame, event: DataFrame, min_below: int = 0) -> DataFrame:
    """OP-12: (node, parent, grandparent, target, pos, par, mut): nodes that undo their grandparent's event.

    Node, parent and grandparent have one event each, and at least ``min_below`` nodes lie below. The
    node would become a child of ``target`` (above the grandparent) with the parent's event.
    """
    single = event.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("pos").alias("pos"), F.first("par").alias("par"), F.first("mut").alias("mut"), F.first("ref").alias("ref")).where("n = 1").drop("n")
    one = node.select("node", "parent", "size").join(single, "node")
    a = one.where(F.col("size") - 1 >= min_below).selectExpr("node", "parent", "pos as pos0", "par as par0", "mut as mut0")
    b = one.selectExpr("node as parent", "parent as grandparent", "pos", "ref", "par", "mut")
    c = one.where("parent is not null").selectExpr("node as grandparent", "parent as target", "pos as pos2", "par as par2", "mut as mut2")
    chain = a.join(b, "parent").join(c, "grandparent")
    return chain.where("pos0 = pos2 and mut0 = par2 and par0 = mut2").select("node", "parent", "grandparent", "target", "pos", "ref", "par", "mut")


def fix_reversions(node: DataFrame, event: DataFrame, rounds: int = 1, min_below: int = 0) -> tuple[DataFrame, DataFrame]:
    """OP-12: (node, parent, size) and events after ``rounds`` passes; in a pass the deepest moves go first.

    ``size`` stays that of the node's subtree before the pass, as moves go from the leaves up.
    """
    node, event = node.select("node", "parent", "size"), event.select("node", "pos", "ref", "par", "mut")
    for _ in range(rounds):
        moved = None
        while True:
            found = grandparent_reversions(node, event, min_below)
            if moved is not None:
                found = found.join(moved, "node", "left_anti")
            found = materialize(found, "reversions")
            if not found.take(1):
                break
            busy = found.select(F.col("parent").alias("node")).union(found.select(F.col("grandparent").alias("node"))).distinct()
            now = materialize(found.join(busy, "node", "left_anti"), "moves")
            node = materialize(node.join(now.select("node", "target"), "node", "left").select("node", F.coalesce("target", "parent").alias("parent"), "size"), "node")
            event = materialize(event.join(now.select("node"), "node", "left_anti").union(now.select("node", "pos", "ref", "par", "mut")), "event")
            done = now.select("node")
            moved = done if moved is None else moved.union(done)
    return node, event


def mask_private(node: DataFrame, closed: DataFrame, event: DataFrame, samples: DataFrame) -> DataFrame:
    """MA-1: events plus ``masked``: true where every leaf below the event is one of ``samples(node)``."""
    inside = samples.select("node").distinct().join(closed, "node").groupBy(F.col("anc").alias("node")).agg(F.count(F.lit(1)).alias("_in"))
    private = node.join(inside, "node").where(F.col("_in") == F.col("n_leaves")).select("node", F.lit(True).alias("masked"))
    return event.join(private, "node", "left").withColumn("masked", F.coalesce("masked", F.lit(False)))


def regional_shares(node: DataFrame, closed: DataFrame, regions: DataFrame) -> DataFrame:
    """IN-1: ``regions(node, region)`` of leaves -> (node, n, most) of inner nodes: leaves below, those of the commonest region."""
    per = regions.join(closed, "node").groupBy("anc", "region").agg(F.count(F.lit(1)).alias("k"))
    share = per.groupBy(F.col("anc").alias("node")).agg(F.sum("k").alias("n"), F.max("k").alias("most"))
    return share.join(node.where("not is_leaf").select("node"), "node", "left_semi")


def association_index(node: DataFrame, closed: DataFrame, regions: DataFrame) -> DataFrame:
    """IN-1: one row, the sum over inner nodes of (1 - share of the commonest region) / 2^(leaves - 1)."""
    term = (1 - F.col("most") / F.col("n")) * F.pow(F.lit(0.5), F.least(F.col("n") - 1, F.lit(1000)))
    return regional_shares(node, closed, regions).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("association_index"))


def monophyletic_sizes(node: DataFrame, closed: DataFrame, regions: DataFrame) -> DataFrame:
    """IN-1: (region, size): leaves of the largest clade of one region; a leaf alone counts 1."""
    per = regions.join(closed, "node").groupBy("anc", "region").agg(F.count(F.lit(1)).alias("k"))
    whole = per.join(node.select(F.col("node").alias("anc"), "n_leaves"), "anc").where("k = n_leaves")
    return whole.groupBy("region").agg(F.max("k").alias("size"))
