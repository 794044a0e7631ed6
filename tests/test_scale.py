"""Steps that must grow no faster than the tables: the same results as SQL on odd tables, and plans without the large shuffles."""

import shutil

import pytest
from pyspark.sql import functions as F

from arborspark import queries
from arborspark.plans.analog import BASE, bundle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Orders without lines, customer, key or customer key; lines without an order, key, part, supplier or number; a customer without a nation, one without orders; a nation without customers."""
    duckdb = pytest.importorskip("duckdb")
    path, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        con.execute(f"CREATE TABLE {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    con.execute("DELETE FROM lineitem WHERE l_orderkey % 17 = 3")
    con.execute("DELETE FROM orders WHERE o_orderkey % 19 = 5 OR o_custkey = 12")
    con.execute("UPDATE orders SET o_custkey = NULL WHERE o_orderkey % 23 = 1")
    con.execute("UPDATE orders SET o_orderkey = NULL WHERE o_orderkey % 29 = 2")
    con.execute("UPDATE customer SET c_nationkey = 99 WHERE c_custkey % 31 = 4")
    con.execute("DELETE FROM customer WHERE c_nationkey = 7 OR c_custkey % 37 = 6")
    con.execute("UPDATE lineitem SET l_suppkey = NULL WHERE l_orderkey % 13 = 1 AND l_linenumber = 2")
    con.execute("UPDATE lineitem SET l_partkey = NULL WHERE l_orderkey % 13 = 4 AND l_linenumber = 1")
    con.execute("UPDATE lineitem SET l_linenumber = NULL WHERE l_orderkey % 13 = 6")
    con.execute("UPDATE lineitem SET l_orderkey = NULL WHERE l_orderkey % 41 = 7")
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        con.execute(f"COPY {t} TO '{path}/{t}.parquet' (FORMAT parquet)")
    yield str(path), con
    shutil.rmtree(path)


@pytest.mark.parametrize("table, sql", [
    ("node", "SELECT node, parent, level, c0, c1, dfs, is_leaf, size, n_leaves, dfs_end FROM node"),
    ("closure", "SELECT node, anc, dist FROM clo WHERE node IS NOT NULL"),
    ("event", "SELECT node, pos, ref, par, mut FROM ev"),
    ("state", "SELECT node, pos, mut, ref FROM st WHERE node IS NOT NULL"),
])
def test_tables_of_odd_keys(spark, odd, table, sql):
    path, con = odd
    cur = con.execute(BASE + sql)
    names = [d[0] for d in cur.description]
    got = getattr(bundle(spark, path), table)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, cur.fetchall()))


def test_tables_are_made_when_asked_for(spark, tmp_path):
    """Events need no node table, and closure and states no shuffle beyond those of the tables they are read from."""
    for t in ("region", "nation", "customer", "orders", "lineitem"):
        shutil.copyfile(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    b = bundle(spark, str(tmp_path))
    queries.QUERIES["fn2_literals"](spark, str(tmp_path)).count()
    assert "_paths" not in vars(b)
    queries.QUERIES["jo6_metadata"](spark, str(tmp_path)).count()
    for df in (b.closure, b.state, b.event):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_placement_shuffles_no_row_of_a_sample_and_a_node(spark):
    """Scores go through no exchange but those of the samples; samples of the same entries are searched once."""
    from arborspark.operators import place, scan

    b = bundle(spark, SF)
    rows = [(f"s{i}{copy}", (7 * i + j) % 97, 1 << (7 * i + j) % 97 % 4, 1 << (j + i) % 4) for i in range(9) for j in range(4) for copy in "ab"]
    samples = spark.createDataFrame(rows, "sample string, pos int, ref int, allele int")
    for df in (place.scores(b, samples), place.per_node(b, samples)):
        plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
        assert not [line for line in plan if "hashpartitioning(" in line and "sample" in line.split("hashpartitioning(")[1]]
    assert scan.profiles(samples)[1].count() == 9
    found = {r["sample"]: (r["node"], r["score"], r["epp"]) for r in place.best(b, samples).collect()}
    assert len(found) == 18 and all(found[f"s{i}a"] == found[f"s{i}b"] for i in range(9))


def test_scores_by_blocks_equal_scores_at_once(spark, monkeypatch):
    from arborspark.operators import place, scan

    b = bundle(spark, SF)
    rows = [(f"s{i}", (5 * i + j) % 97, 1 << (5 * i + j) % 97 % 4, (1, 2, 4, 8, 5, 15)[(i + j) % 6]) for i in range(7) for j in range(i % 3 + 1)]
    samples = spark.createDataFrame(rows, "sample string, pos int, ref int, allele int")
    at_once = {tuple(r) for r in place.minima(b, samples).collect()}, place.scores(b, samples).groupBy("sample").agg(F.sum("score"), F.sum("n_common"), F.count("node")).collect()
    monkeypatch.setattr(scan, "BLOCK", 3)
    monkeypatch.setattr(scan, "CELLS", 64)
    monkeypatch.setattr(place, "NAMES", 2)
    assert {tuple(r) for r in place.minima(b, samples).collect()} == at_once[0]
    again = place.scores(b, samples).groupBy("sample").agg(F.sum("score"), F.sum("n_common"), F.count("node")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, at_once[1]))


def test_site_texts_equal_those_of_the_whole_grid(spark, tmp_path, monkeypatch):
    """Chunks and range partitions of a few samples give the lines of the table of all calls, without that table."""
    import hashlib

    from arborspark.sinks import columns
    from arborspark.sinks import text as sink

    sites = {3: 8, 5: 2, 8: 1, 9: 2}
    calls = {f"s{i}": {p: (1, 2, 4, 8, 15, 5)[(i * p) % 6] for p in sites if (i + p) % 3 and p != 9} for i in range(23)}
    calls = {s: {p: a for p, a in c.items() if a != sites[p]} for s, c in calls.items()}
    rows = [(s, 100 - i, [(p, a) for p, a in c.items()]) for i, (s, c) in enumerate(calls.items())]
    samples = spark.createDataFrame(rows, "sample string, ord long, calls array<struct<pos:int,allele:int>>")
    grid = spark.createDataFrame([(s, 100 - i, p, r, c.get(p, r)) for i, (s, c) in enumerate(calls.items()) for p, r in sites.items()], "sample string, ord long, pos int, ref int, allele int")
    monkeypatch.setattr(columns, "CHUNK", 4)
    monkeypatch.setattr(columns, "PART", 9)
    sink.write_vcf(grid, str(tmp_path / "a"))
    columns.write_vcf(samples, sites, str(tmp_path / "b"))
    text = [[r["value"] for r in spark.read.text(str(tmp_path / d)).collect()] for d in "ab"]
    assert sorted(text[0]) == sorted(text[1]) and len(text[1]) == 4  # site 8 has unknown calls alone, site 9 none
    letter = lambda a: "?ACMGRSVTWYHKDBN"[a]
    want = {p: hashlib.md5(",".join(f"{s}={letter(calls[s].get(p, r))}" for s in sorted(calls)).encode()).hexdigest() for p, r in sites.items() if p != 9}
    assert {r["pos"]: r["calls"] for r in columns.digests(samples, sites).collect()} == want
