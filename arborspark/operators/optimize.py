"""Tree optimization by moves of subtrees.

A move hangs the branch of s at d. States of all nodes stay, so a move changes only the events of the
branch, and moves on disjoint paths add up. A move can only pay if d's path has an event of s's branch,
so destinations are found by equal events and no pair of other nodes is formed.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.operators import assign, grow, recombine, tree
from arborspark.plans.analog import Bundle
from arborspark.plans.rebuild import rebuild
from arborspark.plans.scratch import materialize


def moves(b: Bundle, radius: int) -> DataFrame:
    """OP-1, OP-2, OP-11: (s, d, lca, delta) with delta < 0: the change of all events when s moves to d, within ``radius`` edges.

    d carries an event of s's branch. s has a sibling, as its parent must not become a leaf.
    """
    kids = b.node.groupBy("parent").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("parent")
    span = b.node.select("node", "parent", "dfs", "dfs_end", "level")
    s = span.join(kids, "parent", "left_semi").select(F.col("node").alias("s"), F.col("parent").alias("p"), F.col("dfs").alias("lo"), F.col("dfs_end").alias("hi"), F.col("level").alias("ls"))
    d = span.where("parent is not null").select(F.col("node").alias("d"), F.col("dfs").alias("dlo"), F.col("dfs_end").alias("dhi"), F.col("level").alias("ld"), F.col("parent").alias("up"))
    events = b.event.select("node", "pos", "mut")
    same = events.withColumnRenamed("node", "s").join(events.withColumnRenamed("node", "d"), ["pos", "mut"]).where("s <> d").select("s", "d").distinct()
    pairs = same.join(s, "s").join(d, "d").where("not dlo between lo and hi and not lo between dlo and dhi")
    near = b.closure.where(F.col("dist") <= radius)
    met = pairs.join(near.select(F.col("node").alias("s"), F.col("anc").alias("a"), F.col("dist").alias("ds")), "s").join(near.select(F.col("node").alias("d"), F.col("anc").alias("a"), F.col("dist").alias("dd")), ["d", "a"])
    close = met.groupBy("s", "d", "up").agg(F.min_by("a", "ds").alias("lca"), F.min(F.col("ds") + F.col("dd")).alias("hops")).where(F.col("hops") <= radius)
    hap = b.state.where("mut <> ref").groupBy("node").agg(F.collect_list(F.col("pos").cast("long") * 16 + F.col("mut")).alias("hap"))
    own = b.event.groupBy("node").agg(F.collect_list(F.struct((F.col("pos").cast("long") * 16 + F.col("mut")).alias("key"), (F.col("mut") == F.col("ref")).alias("back"))).alias("own"))
    none = F.array().cast("array<long>")
    full = close.join(hap.select(F.col("node").alias("s"), F.col("hap").alias("mine")), "s", "left").join(hap.select(F.col("node").alias("up"), F.col("hap").alias("above")), "up", "left").join(own.select(F.col("node").alias("d"), "own"), "d").join(own.select(F.col("node").alias("s"), F.size("own").alias("now")), "s")
    full = full.withColumns({"mine": F.coalesce("mine", none), "above": F.coalesce("above", none)})
    place = lambda a: F.transform(a, lambda k: F.shiftright(k, 4))
    differ = F.array_union(place(F.array_except("above", "mine")), place(F.array_except("mine", "above")))
    shared = F.filter("own", lambda e: F.array_contains("mine", e["key"]) | (e["back"] & ~F.array_contains(place(F.col("mine")), F.shiftright(e["key"], 4))))
    need = F.size(F.array_except(differ, F.transform(shared, lambda e: F.shiftright(e["key"], 4))))
    return full.select("s", "d", "lca", (need - F.col("now")).alias("delta")).where("delta < 0")


def independent(b: Bundle, found: DataFrame) -> DataFrame:
    """OP-5: moves that are the best (delta, s, d) at every node of their paths to the common ancestor; the others wait."""
    found = materialize(found, "moves")
    ends = found.select("s", "d", "lca", "delta", F.explode(F.array("s", "d")).alias("node"))
    level = b.node.select("node", "level")
    path = ends.join(b.closure, "node").join(level.select(F.col("node").alias("lca"), F.col("level").alias("l")), "lca").join(level.select(F.col("node").alias("anc"), F.col("level").alias("la")), "anc").where("la >= l").select("s", "d", "delta", "anc").distinct()
    rank = F.struct("delta", "s", "d")
    best = path.groupBy("anc").agg(F.min(rank).alias("b"))
    won = path.join(best, "anc").groupBy("s", "d", "delta").agg(F.min((F.col("b") == rank).cast("int")).alias("ok")).where("ok = 1")
    return won.select("s", "d", "delta")


def apply_moves(b: Bundle, chosen: DataFrame, tag: str) -> Bundle:
    """OP-6, TR-21: the tree after independent moves; a destination that keeps events of its own gets a new node ``<s>_<tag>`` above it."""
    chosen = materialize(chosen.select(F.col("s").alias("sample"), F.col("d").alias("node")), "chosen")
    states = chosen.select("sample").join(b.state.withColumnRenamed("node", "sample"), "sample").select("sample", "pos", "ref", F.col("mut").alias("allele"))
    own, need = (materialize(t, "split") for t in grow.split_events(b, chosen, states))
    unique = own.groupBy("sample").agg(F.max((~F.col("shared")).cast("int")).alias("u"))
    mode = chosen.join(unique, "sample", "left").join(b.node.select("node", "parent", "is_leaf"), "node").withColumn("split", F.when(F.col("is_leaf") | (F.coalesce("u", F.lit(0)) == 1), F.concat("sample", F.lit(f"_{tag}"))))
    mode = materialize(mode, "mode")
    above = mode.where("split is not null").select("node", "split", "parent")
    goes = mode.select(F.col("sample").alias("node"), F.coalesce("split", "node").alias("to"))
    none = F.lit(None).cast("string")
    old = b.node.select("node", "parent", "c0", "c1").join(above.select("node", "split"), "node", "left").join(goes, "node", "left").select("node", F.coalesce("to", "split", "parent").alias("parent"), "c0", "c1")
    new = above.select(F.col("split").alias("node"), "parent", none.alias("c0"), none.alias("c1"))
    lifted = own.where("shared").join(above.select("node", "split"), "node").select("node", "pos", "split")
    kept = b.event.join(chosen.select(F.col("sample").alias("node")), "node", "left_anti").join(lifted, ["node", "pos"], "left").select(F.coalesce("split", "node").alias("node"), "pos", "ref", "par", "mut")
    return rebuild(old.union(new), kept.union(need.select(F.col("sample").alias("node"), "pos", "ref", "par", "mut")))


def leaf_sets(b: Bundle) -> DataFrame:
    """Leaf alleles other than the reference: (node, pos, ref, allele)."""
    return b.state.where("mut <> ref").join(b.leaf.select("node"), "node", "left_semi").select("node", "pos", "ref", F.col("mut").alias("allele"))


def reassign(b: Bundle) -> Bundle:
    """FS-4: events made anew from the leaves' states."""
    sites = b.event.select("pos", "ref").distinct()
    events = assign.fitch(b.node, leaf_sets(b)).join(sites, "pos").select("node", "pos", "ref", "par", "mut")
    return rebuild(b.node.select("node", "parent", "c0", "c1"), events)


def optimize(b: Bundle, radius: int, rounds: int = 10, least: float = 0.0005, doubling: bool = False, drift: int = 0, seconds: float | None = None, accept: Callable[[DataFrame], DataFrame] | None = None) -> Bundle:
    """OP-7, OP-8: rounds of independent moves; moves that wait are found anew.

    Rounds end when one lowers the events by a share of no more than ``least``, after ``rounds`` rounds or
    ``seconds``. With ``doubling`` such a round doubles the radius instead, up to the tree's width. Then up to ``drift``
    rounds assign all states anew, which keeps the score and opens other moves. UD-1: ``accept`` gets the found
    moves (s, d, lca, delta) and returns those that may be made.
    """
    total, began = b.event.count(), time.monotonic()
    widest = 2 * (b.node.agg(F.max("level")).first()[0] or 1)
    for k in range(rounds):
        if seconds is not None and time.monotonic() - began > seconds:
            break
        found = moves(b, radius)
        chosen = materialize(independent(b, found if accept is None else accept(found)), "accepted")
        now = total
        if chosen.take(1):
            b = apply_moves(b, chosen, f"move{k}")
            now = b.event.count()
        done, total = total - now <= least * total, now
        if done and doubling and radius < widest:
            radius *= 2
        elif done and drift > 0:
            again = reassign(b)
            b, drift = (again, drift - 1) if again.event.count() <= total else (b, 0)
        elif done:
            break
    return b


def interleaved(b: Bundle, samples: DataFrame, per_round: int, radius: int = 4, rounds: int = 1) -> Bundle:
    """OP-10: samples are placed ``per_round`` at a time, in order of name, and the tree is optimized after each lot."""
    names = tree.ordered_index(samples.select("sample").distinct(), ["sample"], "_place").withColumn("lot", F.floor(F.col("_place") / per_round))
    rows = materialize(samples.join(names.select("sample", "lot"), "sample"), "lots")
    for lot in range(-(-names.count() // per_round)):
        b = grow.place_all(b, rows.where(F.col("lot") == lot).drop("lot"))
        b = optimize(b, radius, rounds)
    return b


def branch_support(b: Bundle, nodes: DataFrame) -> DataFrame:
    """OP-9: ``nodes(node)`` -> (node, support): the branch's own place and the other admissible ones that need no more events."""
    hap = b.state.where("mut <> ref").groupBy("node").agg(F.collect_list(F.col("pos").cast("long") * 16 + F.col("mut")).alias("hap"))
    count = b.event.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    wanted = materialize(nodes.select("node").distinct().join(hap, "node", "left").join(count, "node", "left").join(b.node.select("node", "parent"), "node").select(F.col("node").alias("cand"), F.coalesce("hap", F.array().cast("array<long>")).alias("hap"), F.coalesce("n", F.lit(0)).alias("n"), "parent"), "support")
    found = recombine.excess(b, wanted.select("cand", "hap"), 1).where("not sibling or common > 0").join(wanted.drop("hap"), "cand").where((F.col("node") != F.coalesce("parent", F.lit(""))) & (F.size("sites") <= F.col("n")))
    others = found.groupBy("cand").agg(F.count(F.lit(1)).alias("k"))
    return wanted.join(others, "cand", "left").select(F.col("cand").alias("node"), (F.coalesce("k", F.lit(0)) + 1).alias("support"))
