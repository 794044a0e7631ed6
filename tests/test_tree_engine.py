"""Own fixtures for sources, sinks, state assignment, placement and streaming."""

import os

import pytest
from pyspark.sql import functions as F

from arborspark.functions import nucleotides as nuc
from arborspark.operators import assign, place, tree
from arborspark.plans.analog import Bundle, bundle
from arborspark.sinks import text as sink
from arborspark.sources import text as source

# a tree and its events, made up here: which leaves lie below the branch that carries the sites
NEWICK = "(((ant,bee),(cow,(dog,eel))),fox,(gnu,hen));"
ANIMALS = "ant bee cow dog eel fox gnu hen".split()
BRANCHES = {(3, 4): ["bee"], (10, 11, 12): ["cow", "dog", "eel"], (20,): ["dog", "eel"], (30, 31): ["gnu", "hen"], (40,): ["hen"], (50,): ["ant", "bee", "cow", "dog", "eel"]}
SITES = sorted(p for sites in BRANCHES for p in sites)
SF = "/root/testdata/sf0.001"


def write(path, text):
    path.write_text(text)
    return str(path)


def vcf_text():
    lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(ANIMALS)]
    for sites, leaves in BRANCHES.items():
        for pos in sites:
            lines.append(f"x\t{pos}\t.\tA\tT\t.\t.\t.\tGT\t" + "\t".join("1" if s in leaves else "0" for s in ANIMALS))
    return "\n".join(lines) + "\n"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    node = source.levelled(source.read_newick(spark, write(d / "t.nwk", NEWICK)))
    _, calls = source.read_vcf(spark, write(d / "t.vcf", vcf_text()))
    sets = calls.select(F.col("sample").alias("node"), "pos", F.lit(1).alias("ref"), "allele")
    return node, sets


def test_fitch_finds_one_event_per_site(small):
    node, sets = small
    events = assign.fitch(node, sets).collect()
    assert sorted(e["pos"] for e in events) == SITES


def test_fitch_cost_is_least(spark):
    """Against the smallest number of changes over all inner states."""
    import itertools
    import random

    rng = random.Random(3)
    edges = [("r", None), ("x", "r"), ("y", "r"), ("a", "x"), ("b", "x"), ("c", "y"), ("d", "y"), ("z", "y"), ("e", "z"), ("f", "z")]
    leaves = [n for n, _ in edges if n not in {p for _, p in edges}]
    node = source.levelled(spark.createDataFrame(edges, "node string, parent string"))
    rows = [(leaf, pos, 1, rng.choice((1, 2, 4))) for leaf in leaves for pos in range(6)]
    got = assign.fitch(node, spark.createDataFrame(rows, "node string, pos int, ref int, allele int")).groupBy("pos").count().collect()
    got = {r["pos"]: r["count"] for r in got}
    inner = [n for n, _ in edges if n not in leaves]
    for pos in range(6):
        state = {leaf: a for leaf, p, _, a in rows if p == pos}
        best = min(sum((s[p] if p else 1) != s[n] for n, p in edges) for pick in itertools.product((1, 2, 4, 8), repeat=len(inner)) for s in [state | dict(zip(inner, pick))])
        assert got.get(pos, 0) == best


def test_newick_round_trip(small):
    assert sink.newick(small[0]).first()["value"] == NEWICK


def test_newick_unbalanced():
    with pytest.raises(ValueError):
        source.parse_newick("((a,b);")


def test_vcf_round_trip(spark, small, tmp_path):
    _, sets = small
    rows = sets.withColumn("sample", F.col("node")).withColumn("ord", F.ascii("node"))
    lines = [r["value"] for r in sink.vcf_lines(rows).orderBy("pos").collect()]
    assert len(lines) == len(SITES) and lines[8].split("\t")[:5] == ["chr1", "40", "A40T", "A", "T"] and lines[8].endswith("0\t0\t0\t0\t0\t0\t0\t1")
    head = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(ANIMALS)
    _, again = source.read_vcf(spark, write(tmp_path / "o.vcf", "\n".join([head, *lines]) + "\n"))
    assert again.select("sample", "pos", "allele").exceptAll(rows.select("sample", "pos", "allele")).count() == 0


def test_other_text_sources(spark, tmp_path):
    diff = source.read_diff(spark, write(tmp_path / "d.txt", ">s1\na\t5\nn\t10\t4\n-\t20\t2\n>s2\nt\t7\n")).collect()
    assert {tuple(r) for r in diff} == {("s1", 5, 5, 1), ("s1", 10, 13, 15), ("s1", 20, 21, 15), ("s2", 7, 7, 8)}
    fasta = source.read_fasta(spark, write(tmp_path / "f.fa", ">ref one\nacg\r\nTT\n")).first()
    assert tuple(fasta) == ("ref", "ACGTT")
    gtf = source.read_gtf(spark, write(tmp_path / "g.gtf", '#x\nc\ts\tCDS\t3\t8\t.\t+\t0\tgene_id "S"; x\nc\ts\texon\t3\t8\t.\t+\t0\tgene_id "S"\n')).collect()
    assert [tuple(r) for r in gtf] == [("S", 3, 8, "+")]
    assert [r[0] for r in source.read_sample_list(spark, write(tmp_path / "l.txt", "a x\n\n  \nb\r\n")).collect()] == ["a", "b"]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("ABABBBA", "ATG", "A23403G")], "w string, c string, l string")
    row = df.select(nuc.max_descent(F.col("w")), nuc.amino_acid(F.col("c")), nuc.parse_literal(F.col("l")), nuc.allele(F.lit("R")), nuc.letter(F.lit(5)), nuc.codon_mutate(F.col("c"), F.lit(12), F.lit(10), F.lit("A"))).first()
    assert (row[0], row[1], tuple(row[2]), row[3], row[4], row[5]) == (3, "M", (1, 23403, 4), 5, "R", "ATA")
    p = nuc.fisher_exact(spark.createDataFrame([(3, 1, 1, 3)], "a long, b long, c long, d long"), "a", "b", "c", "d").first()["pvalue"]
    assert abs(p - 0.48571428) < 1e-6


def test_polytomies_are_binary_and_keep_leaves(spark):
    b = bundle(spark, SF)
    out = tree.resolve_polytomies(b.node)
    assert out.where("parent is not null").groupBy("parent").count().agg(F.max("count")).first()[0] <= 2
    assert b.leaf.select("node").exceptAll(out.select("node")).count() == 0


def test_reroot_keeps_edges_and_events(spark):
    b = bundle(spark, SF)
    edges, events = tree.reroot(b.node, b.closure, b.event, "n3")
    assert edges.where("parent is null").first()["node"] == "n3" and edges.count() == b.node.count() and events.count() == b.event.where("node <> 'root'").count()


def test_placement_score_is_the_added_parsimony(spark):
    """A sample equal to an existing leaf fits somewhere at no cost."""
    b = bundle(spark, SF)
    leaf = b.event.join(b.leaf, "node", "left_semi").select("node").first()["node"]
    rows = b.state.where(F.col("node") == leaf).where("mut <> ref").selectExpr("'new' sample", "pos", "ref", "mut allele")
    assert place.best(b, rows).first()["score"] == 0


def test_streaming_intake(spark, tmp_path):
    from arborspark.streaming.service import placement_service

    b: Bundle = bundle(spark, SF)
    inbox, outbox = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(inbox)
    spark.createDataFrame([("s", 3, 8, 1)], "sample string, pos int, ref int, allele int").write.mode("append").parquet(inbox)
    q = placement_service(spark, b, inbox, outbox, str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(outbox).count() == 1


def test_queries_match_sql(spark):
    """Every registered query against DuckDB on the smallest tables."""
    import duckdb

    from arborspark.queries import QUERIES, SQL

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    shown = lambda rows, cols: sorted(tuple(repr(round(r[i], 6) if isinstance(r[i], float) else r[i]) for i in sorted(range(len(cols)), key=cols.__getitem__)) for r in rows)
    for name, sql in SQL.items():
        df = QUERIES[name](spark, SF)
        got = shown([tuple(r) for r in df.collect()], df.columns)
        want = c.execute(sql)
        cols = [d[0] for d in want.description]
        assert sorted(cols) == sorted(df.columns) and got == shown(want.fetchall(), cols), name
