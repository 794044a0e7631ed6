"""Queries over whole tables, against SQL of the narrow ones widened to the same sets, and recounts."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arborspark import queries
from arborspark.plans.analog import bundle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def rows(spark, name):
    df = queries.QUERIES[name](spark, SF)
    return df.columns, {tuple(r) for r in df.collect()}


def expected(duck, sql, columns):
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    return {tuple(r[names.index(c)] for c in columns) for r in cur.fetchall()}


@pytest.mark.parametrize("name", ["pl1_scores", "pl3_best"])
def test_placement_of_all_customers(spark, duck, name):
    wide = queries._SAMPLES.replace("n_nationkey", "c_custkey").replace("FROM nation", "FROM customer")
    columns, got = rows(spark, f"{name}_all")
    assert len({r[columns.index("sample")] for r in got}) > 25
    assert got == expected(duck, queries.SQL[name].replace(queries._SAMPLES, wide), columns)


def test_clades_of_all_inner_nodes(spark, duck):
    sql = queries.SQL["an3_by_mutations"].replace("level = 2", "NOT is_leaf AND parent IS NOT NULL")
    columns, got = rows(spark, "an3_by_mutations_all")
    assert got == expected(duck, sql, columns)
    columns, got = rows(spark, "an4_by_samples_all")
    levels = {r["node"]: r["level"] for r in bundle(spark, SF).node.collect()}
    assert len({r[columns.index("node")] for r in got}) == len(got) and len({levels[r[columns.index("clade")]] for r in got}) > 1


def test_lca_of_all_leaves(spark):
    b = bundle(spark, SF)
    level = {r["node"]: r["level"] for r in b.node.collect()}
    above = defaultdict(set)
    for r in b.closure.join(b.leaf.select("node"), "node").collect():
        above[r["node"]].add(r["anc"])
    groups = defaultdict(list)
    for node, ancs in above.items():
        groups[node[:3]].append(ancs)
    want = {(g, max(set.intersection(*a), key=level.get)) for g, a in groups.items()}
    got = queries.QUERIES["tr7_lca_all"](spark, SF)
    assert {(r["grp"], r["lca"]) for r in got.select("grp", F.col("lca")).collect()} == want
