"""Round trips of the tree and genotype formats."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arborspark.functions import wire
from arborspark.sinks import tree_formats as sink
from arborspark.sources import tree_formats as source
from tests.test_recombination import random_bundle


@given(st.lists(st.tuples(st.integers(1, 10**6), st.integers(1, 14)), max_size=7), st.lists(st.tuples(st.integers(1, 10**5), st.integers(0, 300)), max_size=5))
@settings(max_examples=200, deadline=None)
def test_records(points, starts):
    at, runs = 0, []
    for gap, length in starts:
        runs.append((at + gap, at + gap + length))
        at = at + gap + length + 1
    data = wire.block(wire.sample_record("s", points, runs) + wire.sample_record("t", [], []))
    assert list(wire.read_records(data)) == [("s", [(p, p, a) for p, a in points] + [(a, b, 15) for a, b in runs]), ("t", [])]


@given(st.integers(-(2**63), 2**63 - 1))
def test_numbers(n):
    assert wire.signed(wire.read_varint(wire.varint(n), 0)[0]) == n


def labelled(b):
    return type(b)(b.node.withColumn("c0", F.when(F.col("node") == "v03", "A")), b.event, b.closure, b.state)


def plain(rows):
    return sorted(tuple(r) for r in rows)


def test_tree_message(spark, tmp_path):
    b = labelled(random_bundle(spark, 2, n=15)[0])
    condensed = spark.createDataFrame([("v14", ["p", "q"])], "node string, members array<string>")
    for name in ("t.pb", "t.pb.gz"):
        sink.write_tree_message(b, f"{tmp_path}/{name}", condensed)
        nodes, events = source.read_tree_message(spark, f"{tmp_path}/{name}")
        names = {r["dfs"]: r["node"] for r in nodes.collect()}
        mine = {r["node"]: names[r["dfs"]] for r in b.node.collect()}  # inner names are made anew
        assert plain(events.select("node", "pos", "ref", "par", "mut").collect()) == sorted((mine[r["node"]], r["pos"], r["ref"], r["par"], r["mut"]) for r in b.event.collect())
        assert {(r["node"], r["parent"]) for r in nodes.collect()} == {(mine[r["node"]], mine.get(r["parent"])) for r in b.node.collect()}
        assert {r["node"]: r["labels"] for r in nodes.collect()}[mine["v03"]] == ["A", ""]
        assert {r["node"]: r["members"] for r in nodes.collect()}.get("v14") == ["p", "q"]


def test_auspice(spark, tmp_path):
    b = labelled(random_bundle(spark, 2, n=15)[0])
    sink.auspice_lines(b).coalesce(1).write.text(f"{tmp_path}/j")
    text = sink.auspice_lines(b).first()["value"]
    assert json.loads(text)["tree"]["name"] == "v00"
    nodes, events = source.read_auspice(spark, f"{tmp_path}/j")
    assert plain(nodes.select("node", F.coalesce("parent", F.lit("")), "dfs").collect()) == plain(b.node.select("node", F.coalesce("parent", F.lit("")), "dfs").collect())
    assert plain(events.select("node", "pos", "par", "mut").collect()) == plain(b.event.select("node", "pos", "par", "mut").collect())
    bare = source.decode_auspice('{"tree":{"name":"r","branch_attrs":{},"children":[{"name":"x","children":[{"name":"a","branch_attrs":{"mutations":{"nuc":["A5-","C7T"]}}}]}]}}')
    assert bare[["node", "parent"]].values.tolist() == [["r", None], ["a", "r"]] and bare["events"][1] == [(7, 2, 2, 8)]


def test_sample_major(spark, tmp_path):
    rows = [(f"s{i}", 5 * i + 1, 5 * i + 1, 1 + i % 8) for i in range(5)] + [("s1", 100, 140, 15), ("s1", 200, 200, 15), ("s3", 7, 7, 15)]
    runs = spark.createDataFrame(rows, "sample string, start int, stop int, allele int")
    sink.write_sample_major(runs, f"{tmp_path}/g")
    assert plain(source.read_sample_major(spark, f"{tmp_path}/g").collect()) == sorted(rows)


def test_taxon_message(spark, tmp_path):
    b, *_, event, state = random_bundle(spark, 2, n=15)
    meta = spark.createDataFrame([("v14", "2021-01-01", "acc")], "node string, date string, accession string")
    sink.write_parts(spark, sink.taxon_parts(b, meta), f"{tmp_path}/x")
    names, parents, literals, dates = [], [], [], []
    for number, value in wire.fields(open(f"{tmp_path}/x", "rb").read()):
        if number == 1:
            parts = dict(wire.fields(value))
            names.append(parts[1].decode())
            parents.append(parts[8])
        else:
            (literals if number == 4 else dates).append(value.decode())
    order = [r["node"] for r in b.node.orderBy("dfs").collect()]
    up = {r["node"]: r["parent"] for r in b.node.collect()}
    assert names == order and all(names[p] == (up[n] or n) for n, p in zip(names, parents))
    assert literals == sorted(set(literals)) and dates == ["", "2021-01-01"]
