"""Recombination: search for donor and acceptor branches, and the filters on what it finds.

A branch is a recombinant candidate if the changes it needs fall by enough when the part of its
haplotype between two breakpoints descends from one node (donor) and the rest from another (acceptor).
Positions of changes are held as arrays per (candidate, node), so breakpoints cost no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.operators.place import BATCH
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize

#: End of an interval that nothing closes.
OPEN = 1_000_000_000


def _haplotypes(b: Bundle) -> DataFrame:
    """(node, hap): changed sites of every node, site and allele in one number."""
    return b.state.where("mut <> ref").groupBy("node").agg(F.collect_list(F.col("pos").cast("long") * 16 + F.col("mut")).alias("hap"))


def breakpoints(haplotype: DataFrame, min_events: int, min_range: int, max_range: int) -> DataFrame:
    """RC-2: ``(cand, orig, sites)`` -> every (cand, i, j, lo, hi, before): sites i to j - 1 from the donor, both parts large enough.

    ``lo`` and ``hi`` are the first and last donor site, ``before`` the site left of them (0: none).
    """
    n = F.size("sites")
    i = haplotype.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    each = i.where(F.col("i") + min_events <= n).withColumn("j", F.explode(F.sequence(F.col("i") + min_events, n)))
    span = each.where(n - (F.col("j") - F.col("i")) >= min_events).withColumns({"lo": F.get("sites", F.col("i")), "hi": F.get("sites", F.col("j") - 1)})
    before = F.when(F.col("i") > 0, F.get("sites", F.greatest(F.col("i") - 1, F.lit(0)))).otherwise(0)
    return span.where((F.col("j") < n) & (F.col("hi") - F.col("lo")).between(min_range, max_range)).withColumn("before", before)


def excess(b: Bundle, candidates: DataFrame, min_nodes: int) -> DataFrame:
    """RC-3: ``candidates(cand, hap)`` -> (cand, node, sibling, common, sites): its shared events, and sites that differ from the candidate when it hangs at the node.

    Events that the candidate shares join the state above the node. Nodes below the candidate and nodes
    with fewer than ``min_nodes`` in their subtree are left out.
    """
    own = b.event.groupBy("node").agg(F.collect_list(F.struct((F.col("pos").cast("long") * 16 + F.col("mut")).alias("key"), (F.col("mut") == F.col("ref")).alias("back"))).alias("own"))
    above = _haplotypes(b).withColumnRenamed("node", "up")
    none = F.array().cast("array<long>")
    nodes = b.node.where(F.col("size") >= min_nodes).select("node", "is_leaf", "dfs", F.coalesce("parent", "node").alias("up")).join(above, "up", "left").join(own, "node", "left").select("node", "is_leaf", "dfs", F.coalesce("hap", none).alias("above"), "own")
    span = b.node.select(F.col("node").alias("cand"), F.col("dfs").alias("lo"), F.col("dfs_end").alias("hi"))
    wanted = candidates.select("cand", F.col("hap").alias("mine")).join(span, "cand")
    grid = nodes.crossJoin(F.broadcast(wanted) if wanted.count() <= BATCH else wanted).where(~F.col("dfs").between(F.col("lo"), F.col("hi")))
    place = lambda a: F.transform(a, lambda k: F.shiftright(k, 4))
    differ = F.array_union(place(F.array_except("above", "mine")), place(F.array_except("mine", "above")))
    shared = F.filter(F.col("own"), lambda e: F.array_contains("mine", e["key"]) | (e["back"] & ~F.array_contains(place(F.col("mine")), F.shiftright(e["key"], 4))))
    unique = F.coalesce(F.size("own") - F.size(shared), F.lit(0))
    left = F.when(F.col("own").isNull(), differ).otherwise(F.array_except(differ, F.transform(shared, lambda e: F.shiftright(e["key"], 4))))
    return grid.select("cand", "node", (F.col("is_leaf") | (unique > 0)).alias("sibling"), F.coalesce(F.size(shared), F.lit(0)).alias("common"), left.alias("sites"))


def first_pairs(parts: DataFrame, improvement: int) -> DataFrame:
    """RC-4, JO-4: ``parts(cand, orig, i, j, role, node, n, ..)`` -> the first donor and acceptor by (n, node), not the same, with n summing to orig - improvement at most.

    Only the two least of each role matter: if the least ones are one node, the second replaces one of them.
    """
    key = ["cand", "orig", "i", "j"]
    least = parts.withColumn("r", F.row_number().over(W.partitionBy(*key, "role").orderBy("n", "node"))).where("r <= 2")
    side = lambda role, p: least.where(F.col("role") == role).select(*key, F.struct("n", "node", "sibling", "total").alias(p))
    pair = side("donor", "d").join(side("acceptor", "a"), key).where((F.col("d.node") != F.col("a.node")) & (F.col("d.n") + F.col("a.n") + improvement <= F.col("orig")))
    return pair.groupBy(*key).agg(F.min(F.struct(F.col("d.n").alias("dn"), F.col("d.node").alias("dk"), F.col("a.n").alias("an"), F.col("a.node").alias("ak"), "d", "a")).alias("m")).select(*key, "m.d", "m.a")


def merge_touching(intervals: Column) -> Column:
    """RC-6, WN-6: sorted array of (lo, hi) in which an interval that starts where an earlier one ends is joined to it."""

    def add(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda y: y["hi"]), x["lo"]).cast("int")
        longer = F.transform(acc, lambda y, k: F.when(k == at - 1, F.struct(y["lo"].alias("lo"), x["hi"].alias("hi"))).otherwise(y))
        return F.when(at > 0, longer).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(intervals, F.array().cast("array<struct<lo:long,hi:long>>"), add)


def merged(found: DataFrame) -> DataFrame:
    """RC-6: joins touching intervals of equal nodes and totals, first on the second breakpoint, then on the first."""
    for ours, other in (("end", "start"), ("start", "end")):
        keys = [c for c in found.columns if c not in (f"{ours}_lo", f"{ours}_hi")]
        listed = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"{ours}_lo").alias("lo"), F.col(f"{ours}_hi").alias("hi")))).alias("_l"))
        found = listed.withColumn("_x", F.explode(merge_touching(F.col("_l")))).select(*keys, F.col("_x.lo").alias(f"{ours}_lo"), F.col("_x.hi").alias(f"{ours}_hi"))
    return found


def search(b: Bundle, candidates: DataFrame, min_events: int = 3, improvement: int = 3, min_nodes: int = 10, min_range: int = 1000, max_range: int = 10_000_000) -> DataFrame:
    """RC-2..6: ``candidates(node)`` -> recombination events, one row per pair of breakpoint intervals.

    Columns: recomb, start_lo, start_hi, end_lo, end_hi (OPEN: none), donor, donor_sibling, donor_parsimony,
    acceptor, acceptor_sibling, acceptor_parsimony, original_parsimony, min_starting_parsimony, recomb_parsimony.
    """
    orig = b.event.groupBy("node").agg(F.count(F.lit(1)).alias("orig"))
    haps = candidates.select("node").join(_haplotypes(b), "node").join(orig, "node").select(F.col("node").alias("cand"), "hap", F.col("orig").cast("int").alias("orig"))
    haps = materialize(haps.where(F.col("orig") >= improvement), "recomb-cand")
    sites = haps.withColumn("sites", F.array_sort(F.transform("hap", lambda k: F.shiftright(k, 4))))
    points = materialize(breakpoints(sites.drop("hap"), min_events, min_range, max_range), "recomb-points")
    per = points.groupBy("cand", "orig").agg(F.collect_list(F.struct("i", "j", "lo", "hi")).alias("points"))
    allowed = F.col("orig") - improvement
    need = materialize(excess(b, haps, min_nodes), "recomb-excess")
    each = need.join(per, "cand").withColumn("total", F.size("sites")).select("cand", "orig", "node", "sibling", "sites", "total", F.explode("points").alias("p"))
    inside = F.size(F.filter("sites", lambda s: s.between(F.col("p.lo"), F.col("p.hi"))))
    roles = F.array(F.struct(F.lit("donor").alias("role"), F.col("inside").alias("n")), F.struct(F.lit("acceptor").alias("role"), (F.col("total") - F.col("inside")).alias("n")))
    parts = each.withColumn("inside", inside).withColumn("x", F.explode(F.filter(roles, lambda r: r["n"] <= allowed))).select("cand", "orig", F.col("p.i").alias("i"), F.col("p.j").alias("j"), "node", "sibling", "total", "x.role", "x.n")
    pairs = first_pairs(parts, improvement)
    at = pairs.join(points.drop("orig", "sites"), ["cand", "i", "j"]).join(haps.select("cand", "hap"), "cand").join(_haplotypes(b).select(F.col("node").alias("_d"), F.col("hap").alias("donor_hap")), F.col("d.node") == F.col("_d"), "left")
    mine = F.transform("hap", lambda k: F.shiftright(k, 4))
    other = F.coalesce(F.transform("donor_hap", lambda k: F.shiftright(k, 4)), F.array().cast("array<long>"))
    only = F.array_union(F.array_except(mine, other), F.array_except(other, mine))
    at = at.withColumn("_only", only)
    lo = F.array_max(F.filter("_only", lambda s: (s > F.col("before")) & (s <= F.col("lo"))))
    hi = F.array_min(F.filter("_only", lambda s: s > F.col("hi")))
    rows = at.select(
        F.col("cand").alias("recomb"), F.coalesce(lo, F.col("before")).cast("long").alias("start_lo"), F.col("lo").cast("long").alias("start_hi"), F.col("hi").cast("long").alias("end_lo"), F.coalesce(hi, F.lit(OPEN)).cast("long").alias("end_hi"),
        F.col("d.node").alias("donor"), F.col("d.sibling").alias("donor_sibling"), F.col("d.total").alias("donor_parsimony"),
        F.col("a.node").alias("acceptor"), F.col("a.sibling").alias("acceptor_sibling"), F.col("a.total").alias("acceptor_parsimony"),
        F.col("orig").alias("original_parsimony"), F.least("orig", "d.total", "a.total").alias("min_starting_parsimony"), (F.col("d.n") + F.col("a.n")).alias("recomb_parsimony"),
    )
    return merged(rows)


def lines(found: DataFrame) -> DataFrame:
    """RC-7: (recomb, value): tab-separated rows; an open end is GENOME_SIZE."""
    flag = lambda c: F.when(F.col(c), "y").otherwise("n")
    end = F.when(F.col("end_hi") == OPEN, "GENOME_SIZE").otherwise(F.col("end_hi").cast("string"))
    cells = ["recomb", F.format_string("(%d,%d)", "start_lo", "start_hi"), F.format_string("(%d,%s)", "end_lo", end), "donor", flag("donor_sibling"), "donor_parsimony", "acceptor", flag("acceptor_sibling"), "acceptor_parsimony", "original_parsimony", "min_starting_parsimony", "recomb_parsimony"]
    return found.select("recomb", F.concat_ws("\t", *(F.col(c).cast("string") if isinstance(c, str) else c for c in cells)).alias("value"))


def best_per_candidate(found: DataFrame) -> DataFrame:
    """RC-8: the rows of each candidate with the largest improvement."""
    gain = F.col("min_starting_parsimony") - F.col("recomb_parsimony")
    return found.withColumn("_g", gain).withColumn("_m", F.max("_g").over(W.partitionBy("recomb"))).where("_g = _m").drop("_g", "_m")


def empirical_p(found: DataFrame, null: DataFrame, least: int = 3) -> DataFrame:
    """AG-19, RC-8: adds total and tail: of ``null(parsimony, improvement, n)`` with the row's starting parsimony, all and those with no less improvement.

    Both are null where the null model has no such parsimony; rows with less improvement than ``least`` go.
    """
    w = W.partitionBy("parsimony")
    tail = F.sum("n").over(w.orderBy(F.col("improvement").desc()).rangeBetween(W.unboundedPreceding, 0))
    levels = null.withColumns({"_tail": tail, "_total": F.sum("n").over(w)}).select("parsimony", "improvement", "_tail", "_total")
    rows = found.withColumn("_gain", F.col("min_starting_parsimony") - F.col("recomb_parsimony")).where((F.col("min_starting_parsimony") > 0) & (F.col("_gain") >= least))
    wanted = rows.select("min_starting_parsimony", "_gain").distinct()
    hit = wanted.join(levels, F.col("min_starting_parsimony") == F.col("parsimony")).groupBy("min_starting_parsimony", "_gain").agg(F.first("_total").alias("total"), F.coalesce(F.max(F.when(F.col("improvement") >= F.col("_gain"), F.col("_tail"))), F.lit(0)).alias("tail"))
    return rows.join(hit, ["min_starting_parsimony", "_gain"], "left").drop("_gain")


def informative_sites(trios: DataFrame, calls: DataFrame, parent: DataFrame) -> DataFrame:
    """RC-9: ``trios(trio, recomb, donor, donor_sibling, acceptor, acceptor_sibling)``, ``calls(node, pos, mut, ref)``, ``parent(node, parent)`` -> (trio, pos, side).

    A: only the donor matches the recombinant, B: only the acceptor. A sibling that does not match is
    replaced by its parent where that one does.
    """
    who = F.array(F.struct(F.lit("r").alias("role"), F.col("recomb").alias("node")), *(F.struct(F.lit(r).alias("role"), F.col(c).alias("node")) for r, c in (("d", "donor"), ("a", "acceptor"))))
    named = trios.select("trio", F.explode(who).alias("x")).select("trio", "x.role", "x.node")
    sibling = trios.select("trio", F.explode(F.array(F.struct(F.lit("d2").alias("role"), F.when(F.col("donor_sibling"), F.col("donor")).alias("node")), F.struct(F.lit("a2").alias("role"), F.when(F.col("acceptor_sibling"), F.col("acceptor")).alias("node")))).alias("x")).select("trio", "x.role", "x.node").join(parent, "node").where("parent is not null").select("trio", "role", F.col("parent").alias("node"))
    seen = named.unionByName(sibling).join(calls.select("node", "pos", "mut", "ref"), "node").groupBy("trio", "pos").agg(F.first("ref").alias("ref"), *(F.max(F.when(F.col("role") == r, F.col("mut"))).alias(r) for r in ("r", "d", "a", "d2", "a2")))
    have = sibling.groupBy("trio").agg(*(F.max((F.col("role") == r).cast("int")).alias(f"has_{r}") for r in ("d2", "a2")))
    r = F.coalesce("r", "ref")
    match = lambda c: (F.coalesce(c, "ref") == r) | ((F.coalesce(f"has_{c}2", F.lit(0)) == 1) & (F.coalesce(f"{c}2", "ref") == r))
    both = seen.join(have, "trio", "left").withColumns({"_d": match("d"), "_a": match("a")})
    return both.where("_d <> _a").select("trio", "pos", F.when(F.col("_d"), "A").otherwise("B").alias("side"))


def walks(sites: DataFrame) -> DataFrame:
    """RC-9, AG-18: (trio, seq, n_a, n_b, a_span, b_span): sides in order of position, their counts, and first to last site of each."""
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "side"))), lambda s: s["side"]), "")
    span = lambda s: F.max(F.when(F.col("side") == s, F.col("pos"))) - F.min(F.when(F.col("side") == s, F.col("pos")))
    return sites.groupBy("trio").agg(seq.alias("seq"), F.count_if(F.col("side") == "A").alias("n_a"), F.count_if(F.col("side") == "B").alias("n_b"), span("A").alias("a_span"), span("B").alias("b_span"))


def not_clustered(walked: DataFrame, least: int = 20) -> DataFrame:
    """RC-13: both sides' sites span more than ``least``."""
    return walked.where((F.col("a_span") > least) & (F.col("b_span") > least))


def passing(rows: DataFrame) -> DataFrame:
    """SE-20, RC-12: rows with (exact_p, total, tail): exact p of at most 0.2, and an empirical p that is below 0.05, zero or unknown."""
    return rows.where((F.col("exact_p") <= 0.2) & (F.col("total").isNull() | (F.col("tail") == 0) | (F.col("tail") / F.col("total") < 0.05)))


def near_descendants(b: Bundle, wanted: DataFrame, most: int = 10, seed: int = 1) -> DataFrame:
    """RC-10, QX-14 (each level counts as itself): ``wanted(node)`` -> (node, sample, extra): up to ``most`` leaves one level below, else two, else three (extra 0, 1, 2), by seeded hash."""
    below = wanted.select(F.col("node").alias("anc")).distinct().join(b.closure.where("dist between 1 and 3"), "anc").join(b.leaf.select("node"), "node")
    near = below.withColumn("_d", F.min("dist").over(W.partitionBy("anc"))).where("dist = _d")
    rank = F.row_number().over(W.partitionBy("anc").orderBy(F.xxhash64("node", F.lit(seed)), "node"))
    return near.withColumn("_r", rank).where(F.col("_r") <= most).select(F.col("anc").alias("node"), F.col("node").alias("sample"), (F.col("dist") - 1).alias("extra"))


def tie_break(rows: DataFrame) -> DataFrame:
    """RC-14, QX-7 (fewest leaves win): one row of each recomb: fewest breakpoints, fewest informative sites, least p, fewest leaves below the parents, widest intervals, then names.

    ``rows`` has recomb, breakpoints, n_sites, p, parent_leaves, width, donor, acceptor. Where all that tie on p have
    the same two parents, leaves are equal too, so the width decides, as in the rule for equal parents.
    """
    order = ["breakpoints", "n_sites", "p", "parent_leaves", F.col("width").desc(), "donor", "acceptor"]
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("recomb").orderBy(*order))).where("_r = 1").drop("_r")


def count_breakpoints(rows: DataFrame, sites: DataFrame) -> DataFrame:
    """RC-14: adds breakpoints to ``rows(trio, start_lo, end_hi, ..)``: 2 if informative ``sites(trio, pos)`` lie on both outer sides, else 1."""
    outer = rows.join(sites.select("trio", "pos"), "trio").groupBy("trio").agg(F.max((F.col("pos") <= F.col("start_lo")).cast("int")).alias("_l"), F.max((F.col("pos") > F.col("end_hi")).cast("int")).alias("_r"))
    return rows.join(outer, "trio", "left").withColumn("breakpoints", F.when((F.col("_l") == 1) & (F.col("_r") == 1), 2).otherwise(1)).drop("_l", "_r")


def drop_circular(trios: DataFrame) -> DataFrame:
    """RC-15: ``trios(trio, recomb, donor, acceptor, p, n_sites, leaves)`` without the worse one of each circular pair.

    Two trios are circular if they hold the same three nodes, or share two of which one is a recombinant.
    Worse is the larger p, then more sites, then fewer leaves; full ties keep both. Such pairs share a
    node that is recombinant in one of them, so they meet on that node instead of all against all.
    """
    cols = ["trio", "recomb", "donor", "acceptor", "p", "n_sites", "leaves"]
    members = F.array("recomb", "donor", "acceptor")
    mine = trios.select(F.struct(*cols).alias("x"), members.alias("xs"), F.col("recomb").alias("key"))
    other = trios.select(F.struct(*cols).alias("y"), members.alias("ys"), F.explode(F.array_distinct(members)).alias("key"))
    same = F.size(F.array_intersect("xs", "ys"))
    pairs = mine.join(other, "key").where((F.col("x.trio") != F.col("y.trio")) & (same >= 2))
    badness = lambda t: F.struct(F.col(f"{t}.p"), F.col(f"{t}.n_sites"), -F.col(f"{t}.leaves"))
    worse = F.when(badness("x") > badness("y"), F.col("x.trio")).when(badness("x") < badness("y"), F.col("y.trio"))
    return trios.join(pairs.select(worse.alias("trio")).where("trio is not null").distinct(), "trio", "left_anti")
