"""Readers of binary and JSON tree files and of sample-major genotypes; a message or document is one task."""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import wire
from arborspark.functions.nucleotides import IUPAC
from arborspark.plans.scratch import materialize
from arborspark.sources.text import parse_newick

ROWS = "node string, parent string, child_ord int, branch_length double, dfs long, labels array<string>, members array<string>, events array<struct<pos:int,ref:int,par:int,mut:int>>"


def decode_tree(data: bytes) -> pd.DataFrame:
    """Rows of ROWS from one tree message; events are sorted by site, missing labels are an empty list."""
    newick, events, members, labels = "", [], {}, []
    for number, value in wire.fields(data):
        if number == 1:
            newick = value.decode()
        elif number == 2:
            own = []
            for _, m in wire.fields(value):
                e = {"pos": 0, "ref": 0, "par": 0, "mut": 0}
                for k, v in wire.fields(m):
                    if k == 4:
                        for i in wire.numbers(v):
                            e["mut"] |= 1 << i
                    elif k < 4:
                        e[("pos", "ref", "par")[k - 1]] = v
                own.append((e["pos"], 1 << e["ref"], 1 << e["par"], e["mut"]))
            events.append(sorted(own))
        elif number == 3:
            parts = list(wire.fields(value))
            members[next(v for k, v in parts if k == 1).decode()] = [v.decode() for k, v in parts if k == 2]
        elif number == 4:
            labels.append([v.decode() for _, v in wire.fields(value)])
    rows = parse_newick(newick)
    if len(events) not in (0, len(rows)):
        raise ValueError(f"{len(events)} lists of events for {len(rows)} nodes")
    return pd.DataFrame(
        [(*r, i, labels[i] if i < len(labels) else [], members.get(r[0], []), events[i] if events else []) for i, r in enumerate(rows)],
        columns=["node", "parent", "child_ord", "branch_length", "dfs", "labels", "members", "events"],
    )


def read_tree_message(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC-5: (nodes with labels and members of condensed leaves, events(node, pos, ref, par, mut)); plain or gzip."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                yield decode_tree(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)

    rows = materialize(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, ROWS), "tree-message")
    return rows.drop("events"), rows.select("node", F.explode("events").alias("e")).select("node", "e.*")


def decode_auspice(text: str) -> pd.DataFrame:
    """Rows of ROWS from a JSON tree; a node without branch attributes hands its children to its parent, ``-`` alleles go."""
    rows, stack, order = [], [(json.loads(text)["tree"], None)], {}
    while stack:
        at, parent = stack.pop()
        attrs, name = at.get("branch_attrs"), parent
        if attrs is not None:
            name = at["name"]
            order[parent] = order.get(parent, 0) + 1
            events = []
            for literal in attrs.get("mutations", {}).get("nuc", []):
                par, pos, mut = literal[0], int(literal[1:-1]), literal[-1]
                if "-" not in (par, mut):
                    p, m = (IUPAC.find(c) + 1 or 15 for c in (par, mut))
                    events.append((pos, p, p, m))
            label = attrs.get("labels", {}).get("clade")
            rows.append((name, parent, order[parent], None, len(rows), [label] if label else [], [], sorted(events)))
        stack += [(c, name) for c in reversed(at.get("children", []))]
    return pd.DataFrame(rows, columns=["node", "parent", "child_ord", "branch_length", "dfs", "labels", "members", "events"])


def read_auspice(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SC-10: as ``read_tree_message``; an event's reference is its parent allele, as the file holds no other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text in frame["value"]:
                yield decode_auspice(text)

    rows = materialize(spark.read.text(path, wholetext=True).mapInPandas(run, ROWS), "tree-json")
    return rows.drop("events"), rows.select("node", F.explode("events").alias("e")).select("node", "e.*")


def read_sample_major(spark: SparkSession, path: str) -> DataFrame:
    """SC-15: (sample, start, stop, allele): points, and N runs as closed intervals."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                for name, found in wire.read_records(data):
                    yield pd.DataFrame([(name, *x) for x in found], columns=["sample", "start", "stop", "allele"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "sample string, start int, stop int, allele int")
