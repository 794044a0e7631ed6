"""Writers of binary and JSON tree files and of sample-major genotypes.

Parts are encoded in parallel; one file is then written from the sorted parts, a partition at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import wire
from arborspark.functions.nucleotides import literal
from arborspark.operators.select import path_totals
from arborspark.plans.analog import Bundle
from arborspark.plans.scratch import materialize
from arborspark.sinks.text import newick


def write_parts(spark: SparkSession, parts: DataFrame, path: str) -> None:
    """``parts(ord.., content)`` in order of all columns but content -> one file in any file system, gzip for ``.gz``."""
    keys = [c for c in parts.columns if c != "content"]
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    pack = zlib.compressobj(wbits=31) if path.endswith(".gz") else None
    try:
        for row in parts.orderBy(*keys).select("content").toLocalIterator():
            data = pack.compress(bytes(row[0])) if pack else row[0]
            if data:
                out.write(bytearray(data))
        if pack:
            out.write(bytearray(pack.flush()))
    finally:
        out.close()


def ordered_nodes(b: Bundle) -> DataFrame:
    return b.node.withColumn("child_ord", F.col("dfs"))


def tree_parts(b: Bundle, condensed: DataFrame | None = None) -> DataFrame:
    """SK-3: (kind, dfs, content): fields of the tree message: Newick, events and labels by dfs number, members of condensed leaves.

    Events without a change are dropped; a masked event (negative site) holds nothing but its site.
    """

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for dfs, events, labels in zip(frame["dfs"], frame["events"], frame["labels"]):
                body = b""
                for e in sorted(events, key=lambda e: e["pos"]):
                    if e["pos"] < 0:
                        body += wire.field(1, wire.field(1, int(e["pos"])))
                        continue
                    index = [int(e[k]).bit_length() - 1 for k in ("ref", "par")]
                    alleles = [i for i in range(4) if int(e["mut"]) >> i & 1]
                    body += wire.field(1, wire.field(1, int(e["pos"])) + wire.field(2, index[0]) + wire.field(3, index[1]) + wire.packed(4, alleles))
                out += [(2, dfs, wire.field(2, body)), (4, dfs, wire.field(4, b"".join(wire.field(1, x) for x in labels)))]
            yield pd.DataFrame(out, columns=["kind", "dfs", "content"])

    schema = "kind int, dfs long, content binary"
    own = b.event.where("par <> mut or pos < 0").groupBy("node").agg(F.collect_list(F.struct("pos", "ref", "par", "mut")).alias("events"))
    none = F.array().cast("array<struct<pos:int,ref:int,par:int,mut:int>>")
    labels = F.array(F.coalesce("c0", F.lit("")), F.coalesce("c1", F.lit("")))
    parts = b.node.join(own, "node", "left").select("dfs", F.coalesce("events", none).alias("events"), labels.alias("labels")).mapInPandas(encode, schema)
    head = lambda frames: (pd.DataFrame({"kind": 1, "dfs": 0, "content": [wire.field(1, x) for x in f["value"]]}) for f in frames)
    parts = parts.union(newick(ordered_nodes(b)).mapInPandas(head, schema))
    if condensed is not None:
        def groups(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"kind": 3, "dfs": 0, "content": [wire.field(3, wire.field(1, n) + b"".join(wire.field(2, x) for x in m)) for n, m in zip(frame["node"], frame["members"])]})

        parts = parts.union(condensed.select("node", "members").mapInPandas(groups, schema))
    return parts


def write_tree_message(b: Bundle, path: str, condensed: DataFrame | None = None) -> None:
    write_parts(b.node.sparkSession, tree_parts(b, condensed), path)


def taxon_parts(b: Bundle, metadata: DataFrame | None = None) -> DataFrame:
    """SK-6: (kind, dfs, content): node columns of the taxonium-style message as repeated fields by dfs number, then the dictionary of events.

    x is the number of events on the root path, y the rank of a leaf over 40000 or the mean of a node's
    children; dates and accessions come from ``metadata(node, date, accession)``, empty where there is none.
    """
    from arborspark.operators import tree, translate

    literals = b.event.withColumn("literal", literal(F.col("par"), F.col("pos"), F.col("mut")))
    codes = materialize(translate.dictionary(literals, "literal"), "codes")
    own = literals.join(codes, F.col("literal") == F.col("value")).groupBy("node").agg(F.array_sort(F.collect_list(F.col("code") - 1)).alias("codes"))
    leaves = tree.ordered_index(b.leaf.select("node", "dfs"), ["dfs"], "rank").select("node", "rank")
    y = tree.fold_up(b.node.join(leaves, "node", "left"), "rank / 40000.0", lambda v: F.avg(v), "y")
    up = b.node.select(F.col("node").alias("parent"), F.col("dfs").alias("up"))
    meta = metadata if metadata is not None else b.node.select("node", F.lit("").alias("date"), F.lit("").alias("accession")).limit(0)
    dates = materialize(translate.dictionary(meta, "date"), "dates")
    rows = b.node.join(path_totals(b), "node").join(y, "node").join(up, "parent", "left").join(own, "node", "left").join(meta, "node", "left").join(dates.select(F.col("value").alias("date"), F.col("code").alias("date_code")), "date", "left")
    rows = rows.select("node", "dfs", F.col("total").cast("float").alias("x"), F.col("y").cast("float").alias("y"), F.coalesce("up", F.lit(0)).alias("up"), F.coalesce("codes", F.array().cast("array<long>")).alias("codes"), F.coalesce("accession", F.lit("")).alias("accession"), F.coalesce("date_code", F.lit(0)).alias("date_code"), "n_leaves")

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import struct

        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                single = lambda k, v: wire.varint(k << 3) + wire.varint(int(v))
                body = wire.field(1, r.node) + wire.varint(2 << 3 | 5) + struct.pack("<f", r.x) + wire.varint(3 << 3 | 5) + struct.pack("<f", r.y) + single(7, r.date_code)
                body += wire.field(6, wire.packed(1, (int(c) for c in r.codes))) + single(8, r.up) + wire.field(9, r.accession) + single(11, r.n_leaves)
                out.append((1, r.dfs, wire.field(1, body)))  # messages of one field are merged by readers
            yield pd.DataFrame(out, columns=["kind", "dfs", "content"])

    schema = "kind int, dfs long, content binary"
    text = lambda kind: lambda frames: (pd.DataFrame({"kind": kind, "dfs": f["code"], "content": [wire.field(kind, v) for v in f["value"]]}) for f in frames)
    empty = b.node.sparkSession.createDataFrame([("", 0)], "value string, code long")
    return rows.mapInPandas(encode, schema).union(codes.mapInPandas(text(4), schema)).union(empty.union(dates).mapInPandas(text(5), schema))


def auspice_lines(b: Bundle, title: str = "tree") -> DataFrame:
    """SK-5: one row (value), the JSON tree folded by level: events as list and label, cumulative div, country and date of leaf names, labels handed down."""
    marks = b.node.select(F.col("node").alias("anc"), "c0", "c1")
    held = b.closure.join(marks, "anc").groupBy("node").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("dist"))).alias(f"h_{c}") for c in ("c0", "c1")))
    literals = F.transform(F.array_sort(F.collect_list(F.struct("pos", "par", "mut"))), lambda e: literal(e["par"], e["pos"], e["mut"]))
    own = b.event.groupBy("node").agg(literals.alias("nuc"))
    rows = b.node.join(path_totals(b).select("node", "total"), "node").join(held, "node").join(own, "node", "left")
    value = lambda c: F.when(c.isNotNull(), F.struct(c.alias("value")))
    country, date = F.substring_index("node", "/", 1), F.substring_index("node", "|", -1)
    named = F.col("is_leaf") & (country != F.col("node")) & (date != F.col("node"))
    attrs = F.to_json(F.struct(F.col("total").alias("div"), value(F.col("h_c0")).alias("clade_1"), value(F.col("h_c1")).alias("clade_2"), value(F.when(named, country)).alias("country"), value(F.when(named, date)).alias("date")))
    nuc = F.coalesce("nuc", F.array().cast("array<string>"))
    branch = F.to_json(F.struct(F.struct(nuc.alias("nuc")).alias("mutations"), F.struct(F.coalesce("c0", "c1").alias("clade"), F.array_join(nuc, ",").alias("nuc mutations")).alias("labels")))
    name = F.to_json(F.struct(F.col("node").alias("name")))
    body = F.concat(F.substr(name, F.lit(1), F.length(name) - 1), F.lit(',"node_attrs":'), attrs, F.lit(',"branch_attrs":'), branch)
    rows = materialize(rows.select("node", "parent", "level", "dfs", body.alias("body")), "auspice")
    below = None
    for level in range(rows.agg(F.max("level")).first()[0], -1, -1):
        here = rows.where(F.col("level") == level)
        kids: Column = F.lit("")
        if below is not None:
            joined = below.groupBy(F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("dfs", "value"))), lambda s: s["value"]), ",").alias("k"))
            here, kids = here.join(joined, "node", "left"), F.coalesce(F.concat(F.lit(',"children":['), "k", F.lit("]")), F.lit(""))
        below = materialize(here.select("node", "parent", "dfs", F.concat("body", kids, F.lit("}")).alias("value")), "auspice")
    head = f'{{"version":"v2","meta":{{"title":"{title}"}},"tree":'
    return below.select(F.concat(F.lit(head), "value", F.lit("}")).alias("value"))


def sample_major_blocks(runs: DataFrame, per_block: int = 1000) -> DataFrame:
    """SK-11: ``runs(sample, start, stop, allele)`` -> (ord, content): compressed blocks of up to ``per_block`` samples, in order of name."""
    listed = runs.groupBy("sample").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "allele"))).alias("r"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(first: str, held: list[bytes]) -> pd.DataFrame:
            return pd.DataFrame({"ord": [first], "content": [wire.block(b"".join(held))]})

        first, held = "", []
        for frame in frames:
            for name, r in zip(frame["sample"], frame["r"]):
                first = first if held else name
                points = [(p, x["allele"]) for x in r if x["allele"] != 15 for p in range(x["start"], x["stop"] + 1)]
                held.append(wire.sample_record(name, points, [(x["start"], x["stop"]) for x in r if x["allele"] == 15]))
                if len(held) >= per_block:
                    yield out(first, held)
                    held = []
        if held:
            yield out(first, held)

    return listed.repartitionByRange("sample").sortWithinPartitions("sample").mapInPandas(encode, "ord string, content binary")


def write_sample_major(runs: DataFrame, path: str) -> None:
    write_parts(runs.sparkSession, sample_major_blocks(runs), path)
