"""A bundle from edges and events, for trees that operators have changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.operators import tree
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize


def rebuild(edges: DataFrame, event: DataFrame) -> Bundle:
    """``edges(node, parent[, c0, c1])`` and ``event(node, pos, ref, par, mut)`` -> a bundle; children in order of name.

    The dfs number is the rank of the names on the root path, so one parent with very many children is
    sorted in range partitions and not in one task.
    """
    cols = {c: F.col(c) if c in edges.columns else F.lit(None).cast("string") for c in ("node", "parent", "c0", "c1")}
    edges = materialize(edges.select(*(v.alias(k) for k, v in cols.items())), "edges")
    closed = tree.closure(edges)
    path = closed.groupBy("node").agg(F.max("dist").cast("int").alias("level"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("d"), "anc"))), lambda s: s["anc"]).alias("path"))
    inner = edges.where("parent is not null").select(F.col("parent").alias("node")).distinct().withColumn("_inner", F.lit(True))
    rows = edges.join(path, "node").join(inner, "node", "left").withColumn("is_leaf", F.col("_inner").isNull()).drop("_inner")
    node = tree.ordered_index(rows, ["path"], "dfs").drop("path")
    node = materialize(tree.with_intervals(node, closed), "node")
    event = materialize(event.select("node", "pos", "ref", "par", "mut"), "event")
    return Bundle(node, event, closed, materialize(tree.state(closed, event), "state"))
