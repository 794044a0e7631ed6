"""Small parsimony as level-synchronous table operations: no tree is held in one task or broadcast.

A site's allele set of a node is the alleles that most children's sets hold (for two children this is
the intersection, else the union). Downward, a node takes its parent's allele if its set has it, else
the lowest one; the root's parent is the reference. Events are the changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborspark.functions.nucleotides import first_allele
from arborspark.plans.scratch import materialize, release


def majority(sets) -> list:
    return [F.sum(F.shiftright(sets, i).bitwiseAND(1)).alias(f"s{i}") for i in range(4)]


def fitch(node: DataFrame, leaf_sets: DataFrame) -> DataFrame:
    """FS-1, FS-2: ``leaf_sets(node, pos, ref, allele)`` -> events (node, pos, par, mut).

    Only sets other than the reference alone are kept: a leaf without an entry has the reference, and a
    parent's count for the reference is its number of children less the listed ones. So tables have a row
    per difference and not one per node and site. FS-6: ambiguous leaf alleles are sets like any other.
    """
    top = node.agg(F.max("level")).first()[0]
    kids = node.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    where = materialize(node.select("node", "parent", "level").join(kids, "node", "left"), "fitch-nodes")
    leaves = leaf_sets.where("allele <> ref").join(where, "node")
    done: dict[int, DataFrame] = {}
    for level in range(top, -1, -1):
        here = leaves.where(F.col("level") == level).select("node", "parent", "pos", "ref", F.col("allele").alias("set"))
        if level + 1 in done:
            counts = done[level + 1].groupBy(F.col("parent").alias("node"), "pos", "ref").agg(*majority(F.col("set")), F.count(F.lit(1)).alias("listed"))
            inner = counts.join(where.where(F.col("level") == level), "node")
            for i in range(4):
                inner = inner.withColumn(f"s{i}", F.col(f"s{i}") + F.when(F.col("ref") == 1 << i, F.col("kids") - F.col("listed")).otherwise(0))
            most = F.greatest("s0", "s1", "s2", "s3")
            inner = inner.withColumn("set", sum((F.when(F.col(f"s{i}") == most, 1 << i).otherwise(0) for i in range(4)), F.lit(0)))
            here = here.union(inner.where("set <> ref").select("node", "parent", "pos", "ref", "set"))
        done[level] = materialize(here, "fitch-up")
    events, above = None, None
    for level in range(top + 1):
        if above is None:
            here = done[level].withColumn("par", F.col("ref"))
        else:
            # children of a parent off the reference, and listed children of any parent
            parents = above.where("mut <> ref").select(F.col("node").alias("parent"), "pos", "ref", F.col("mut").alias("par"))
            below = parents.join(where.where(F.col("level") == level).select("node", "parent"), "parent")
            here = done[level].join(below, ["node", "parent", "pos", "ref"], "full").select("node", "pos", "ref", F.coalesce("set", "ref").alias("set"), F.coalesce("par", "ref").alias("par"))
        chosen = F.when(F.col("set").bitwiseAND(F.col("par")) != 0, F.col("par")).otherwise(first_allele(F.col("set")))
        above = materialize(here.select("node", "pos", "ref", "par", chosen.alias("mut")), "fitch-down")
        new = above.where("par <> mut").select("node", "pos", "par", "mut")
        events = new if events is None else events.union(new)
    release(*done.values())
    return events


def reassign(node: DataFrame, closed: DataFrame, event: DataFrame, changed: DataFrame, leaf_sets: DataFrame) -> DataFrame:
    """FS-5: events after the sites of ``changed(pos)`` got new leaf sets: those sites are assigned again, others keep theirs."""
    sites = F.broadcast(changed.select("pos").distinct()) if changed.count() < 100_000 else changed.select("pos").distinct()
    new = fitch(node, leaf_sets.join(sites, "pos", "left_semi"))
    ref = leaf_sets.select("pos", "ref").distinct()
    return event.join(sites, "pos", "left_anti").select("node", "pos", "ref", "par", "mut").unionByName(new.join(ref, "pos").select("node", "pos", "ref", "par", "mut"))


def boundary_alleles(node: DataFrame, leaf_sets: DataFrame) -> DataFrame:
    """FS-2, OP-3: (node, pos, ref, major, boundary): alleles that most children hold, and those one child short of it.

    Where a set of one child changes, an allele of ``major`` or ``boundary`` is all that the parent's can become.
    ``leaf_sets`` lists differences from the reference.
    """
    top = node.agg(F.max("level")).first()[0]
    kids = node.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("kids"))
    where = materialize(node.select("node", "parent", "level").join(kids, "node", "left"), "boundary-nodes")
    leaves = leaf_sets.where("allele <> ref").join(where, "node")
    below, out = None, None
    for level in range(top, -1, -1):
        here = leaves.where(F.col("level") == level).select("node", "parent", "pos", "ref", F.col("allele").alias("set"))
        if below is not None:
            inner = below.groupBy(F.col("parent").alias("node"), "pos", "ref").agg(*majority(F.col("set")), F.count(F.lit(1)).alias("listed")).join(where.where(F.col("level") == level), "node")
            for i in range(4):
                inner = inner.withColumn(f"s{i}", F.col(f"s{i}") + F.when(F.col("ref") == 1 << i, F.col("kids") - F.col("listed")).otherwise(0))
            most = F.greatest("s0", "s1", "s2", "s3")
            bits = lambda short: sum((F.when(F.col(f"s{i}") == most - short, 1 << i).otherwise(0) for i in range(4)), F.lit(0))
            inner = materialize(inner.withColumns({"major": bits(0), "boundary": bits(1)}), "boundary")
            new = inner.select("node", "pos", "ref", "major", "boundary")
            out = new if out is None else out.union(new)
            here = here.union(inner.where("major <> ref").select("node", "parent", "pos", "ref", F.col("major").alias("set")))
        below = materialize(here, "boundary-sets")
    return out if out is not None else leaves.select("node", "pos", "ref", F.lit(0).alias("major"), F.lit(0).alias("boundary")).limit(0)


def least_back_mutations(node: DataFrame, leaf_sets: DataFrame) -> DataFrame:
    """FS-3: as ``fitch``, but with the fewest back mutations among the assignments with the fewest events.

    Per (node, site) and own allele x the table holds events ``e`` and back mutations ``b`` below, and
    ``t0..t3``, the topmost events below from x to each allele. An edge from y to x costs an event and as
    many back mutations as there are topmost events from x to y below it. Ties keep the parent's allele,
    then take the lowest.
    """
    top = node.agg(F.max("level")).first()[0]
    where = node.select("node", "parent", "level")
    leaves = leaf_sets.join(where, "node")
    big = 1 << 40
    cost = lambda x, e, b, t: F.struct(e.cast("long").alias("e"), b.cast("long").alias("b"), *(v.cast("long").alias(f"t{z}") for z, v in enumerate(t))).alias(f"x{x}")

    def edge(y: Column) -> Column:
        """What a child costs below a parent of allele index y: the least of its alleles, with the choice."""
        each = [F.struct((F.col(f"x{x}.e") + (y != x).cast("long")).alias("e"), (F.col(f"x{x}.b") + F.when(y == x, 0).otherwise(F.element_at(F.array(*(F.col(f"x{x}.t{z}") for z in range(4))), y + 1))).alias("b"), (y != x).cast("int").alias("m"), F.lit(x).alias("x")) for x in range(4)]
        return F.array_min(F.array(*each))

    done: dict[int, DataFrame] = {}
    for level in range(top, -1, -1):
        free = lambda x: F.when(F.col("allele").bitwiseAND(1 << x) != 0, 0).otherwise(big)
        here = leaves.where(F.col("level") == level).select("node", "parent", "pos", "ref", *(cost(x, free(x), F.lit(0), [F.lit(0)] * 4) for x in range(4)))
        if level + 1 in done:
            kids = done[level + 1].select(F.col("parent").alias("node"), "pos", "ref", *(F.col(f"x{x}").alias(f"x{x}") for x in range(4)), *(edge(F.lit(y)).alias(f"c{y}") for y in range(4)))
            sums = []
            for y in range(4):
                sums += [F.sum(f"c{y}.e").alias(f"e{y}"), F.sum(f"c{y}.b").alias(f"b{y}")]
                sums += [F.sum(F.when(F.col(f"c{y}.x") == y, F.col(f"x{y}.t{z}")).otherwise((F.col(f"c{y}.x") == z).cast("long"))).alias(f"t{y}{z}") for z in range(4)]
            inner = kids.groupBy("node", "pos", "ref").agg(*sums).select("node", "pos", "ref", *(cost(y, F.col(f"e{y}"), F.col(f"b{y}"), [F.col(f"t{y}{z}") for z in range(4)]) for y in range(4)))
            here = here.union(inner.join(where, "node").select(here.columns))
        done[level] = materialize(here, "back-up")
    events, above = None, None
    for level in range(top + 1):
        here = done[level].withColumn("par", F.col("ref")) if above is None else done[level].join(above.select(F.col("node").alias("parent"), "pos", F.col("mut").alias("par")), ["parent", "pos"])
        above = materialize(here.withColumn("_x", edge(F.log2("par").cast("int"))["x"]).select("node", "pos", "par", F.expr("shiftleft(1, _x)").alias("mut")), "back-down")
        new = above.where("par <> mut")
        events = new if events is None else events.union(new)
    return events
