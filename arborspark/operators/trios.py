"""Recombinant trios: joins, overlap merging, quality flags by alignment, a seeded simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.operators import tree
from arborspark.plans.scratch import materialize


def enriched(trios: DataFrame, node: DataFrame, tests: DataFrame) -> DataFrame:
    """JO-9, RC-12: ``trios(recomb, donor, acceptor, ..)`` with parent, grandparent and leaves of the three, and the
    least p of ``tests(recomb, donor, acceptor, p)``; trios without a test have none."""
    up = node.select("node", "parent", "n_leaves")
    grand = up.join(node.select(F.col("node").alias("parent"), F.col("parent").alias("grandparent")), "parent", "left")
    out = trios
    for role in ("recomb", "donor", "acceptor"):
        out = out.join(grand.select(F.col("node").alias(role), *(F.col(c).alias(f"{role}_{c}") for c in ("parent", "grandparent", "n_leaves"))), role, "left")
    best = tests.groupBy("recomb", "donor", "acceptor").agg(F.min("p").alias("p"))
    return out.join(best, ["recomb", "donor", "acceptor"], "left")


def merge_overlapping(found: DataFrame, most: int = 10) -> DataFrame:
    """RC-8: rows of equal (recomb, donor, acceptor) whose intervals overlap on both axes become one, in up to ``most`` rounds.

    A round joins overlapping first intervals of rows whose second ones overlap as well, by gaps and islands on
    one axis, then on the other; it ends early once no row is joined.
    """
    keys = ["recomb", "donor", "acceptor"]
    rows = materialize(found.select(*keys, "start_lo", "start_hi", "end_lo", "end_hi"), "overlaps")
    n = rows.count()
    for _ in range(most):
        for lo, hi, other_lo, other_hi in (("start_lo", "start_hi", "end_lo", "end_hi"), ("end_lo", "end_hi", "start_lo", "start_hi")):
            order = W.partitionBy(*keys).orderBy(lo, hi, other_lo, other_hi)
            before = order.rowsBetween(W.unboundedPreceding, -1)
            apart = (F.col(lo) > F.coalesce(F.max(hi).over(before), F.lit(-1))) | (F.col(other_lo) > F.coalesce(F.max(other_hi).over(before), F.lit(-1))) | (F.col(other_hi) < F.coalesce(F.min(other_lo).over(before), F.lit(-1)))
            island = rows.withColumn("_new", apart.cast("int")).withColumn("_g", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
            rows = island.groupBy(*keys, "_g").agg(*(f(c).alias(c) for c, f in (("start_lo", F.min), ("start_hi", F.max), ("end_lo", F.min), ("end_hi", F.max)))).drop("_g")
        rows = materialize(rows, "overlaps")
        now = rows.count()
        if now == n:
            break
        n = now
    return rows


def alignment_flags(sites: DataFrame, gaps: DataFrame, near: int = 5, window: int = 20, most: int = 6, length: int | None = None) -> DataFrame:
    """RC-11: ``sites(trio, pos, side)`` and ``gaps(trio, start, stop)`` -> one row per trio with what speaks against it.

    on_gap and near_gap count informative sites inside a gap of the alignment or within ``near`` bases of one, clump
    is the most sites in a window of so many bases, skew the share of sites in the fuller half of the span. ``suspect``: a
    site in a gap, or ``most`` or more near gaps or in a clump.
    """
    wide = gaps.select(F.col("trio").alias("_t"), (F.col("start") - near).alias("lo"), (F.col("stop") + near).alias("hi"), "start", "stop")
    hit = tree.range_join(sites.select("trio", F.col("pos").alias("x")), wide, 1024).where("trio = _t")
    gap = hit.groupBy("trio", "x").agg(F.max(F.col("x").between(F.col("start"), F.col("stop")).cast("int")).alias("inside")).groupBy("trio").agg(F.sum("inside").alias("on_gap"), F.count(F.lit(1)).alias("near_gap"))
    ahead = F.count(F.lit(1)).over(W.partitionBy("trio").orderBy("pos").rangeBetween(0, window - 1))
    middle = (F.min("pos").over(W.partitionBy("trio")) + F.max("pos").over(W.partitionBy("trio"))) / 2
    shape = sites.withColumns({"_n": ahead, "_left": (F.col("pos") <= middle).cast("int")}).groupBy("trio").agg(F.count(F.lit(1)).alias("n_sites"), F.max("_n").alias("clump"), F.sum("_left").alias("_l"))
    out = shape.join(gap, "trio", "left").withColumns({"on_gap": F.coalesce("on_gap", F.lit(0)), "near_gap": F.coalesce("near_gap", F.lit(0)), "skew": F.greatest("_l", F.col("n_sites") - F.col("_l")) / F.col("n_sites")}).drop("_l")
    return out.withColumn("suspect", (F.col("on_gap") > 0) | (F.col("near_gap") >= most) | (F.col("clump") >= most))


def simulated(b, n: int, breakpoints: int, genome: int, seed: int = 1, least: int = 1, extra: int = 0) -> tuple[DataFrame, DataFrame]:
    """RC-17: (trios(recomb, donor, acceptor, cuts), states(recomb, pos, ref, allele)): seeded recombinants of pairs of leaves.

    ``breakpoints`` (1 to 4) cuts split the genome; parts alternate between acceptor and donor. Cuts lie at least
    ``least`` apart where they can. ``extra`` further changes each fall on seeded positions.
    """
    if not 1 <= breakpoints <= 4:
        raise ValueError("1 to 4 breakpoints")
    h = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 40))
    picked = tree.ordered_index(b.leaf.select("node").withColumn("_h", h(F.col("node"))), ["_h", "node"], "i").where(F.col("i") < 2 * n)
    pair = picked.select("node", (F.col("i") / 2).cast("long").alias("k"), (F.col("i") % 2).alias("role"))
    trios = pair.groupBy("k").agg(F.max(F.when(F.col("role") == 0, F.col("node"))).alias("donor"), F.max(F.when(F.col("role") == 1, F.col("node"))).alias("acceptor")).where("donor is not null and acceptor is not null")
    room = max(1, (genome - 1) // breakpoints)
    place = lambda i: (F.lit(i * room) + 1 + h(F.col("k"), F.lit(i)) % max(1, room - least)).cast("int")
    trios = materialize(trios.select(F.concat(F.lit("rec_"), F.col("k").cast("string")).alias("recomb"), "donor", "acceptor", F.array(*map(place, range(breakpoints))).alias("cuts")), "simulated")
    named = trios.select("recomb", "cuts", F.explode(F.array(F.struct(F.lit(1).alias("odd"), F.col("donor").alias("node")), F.struct(F.lit(0).alias("odd"), F.col("acceptor").alias("node")))).alias("x")).select("recomb", "cuts", "x.odd", "x.node")
    passed = F.size(F.filter("cuts", lambda c: c <= F.col("pos")))
    states = named.join(b.state.where("mut <> ref"), "node").where(passed % 2 == F.col("odd")).select("recomb", "pos", "ref", F.col("mut").alias("allele"))
    if extra:
        sites = b.event.select("pos", "ref").distinct()
        more = trios.select("recomb", F.explode(F.sequence(F.lit(1), F.lit(extra))).alias("j")).withColumn("pos", (h(F.col("recomb"), F.col("j"), F.lit(9)) % genome).cast("int")).select("recomb", "pos").distinct().join(sites, "pos", "left")
        new = more.select("recomb", "pos", F.coalesce("ref", F.lit(1)).alias("ref"), F.when(F.coalesce("ref", F.lit(1)) == 8, 1).otherwise(F.coalesce("ref", F.lit(1)) * 2).alias("allele"))
        states = states.join(new.select("recomb", "pos"), ["recomb", "pos"], "left_anti").unionByName(new)
    return trios, states


def dealt(candidates: DataFrame, machines: int) -> DataFrame:
    """RC-18: candidates in ``machines`` ranges of equal number, in order of name."""
    ranked = tree.ordered_index(candidates.select("node").distinct(), ["node"], "_i")
    n = max(1, ranked.count())
    return ranked.select("node", F.floor(F.col("_i") * machines / n).cast("int").alias("machine"))
