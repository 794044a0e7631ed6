"""Queries over the analog bundle, each with DuckDB SQL where SQL can express it. Keys start with survey row ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.functions import nucleotides as nuc
from arborspark.operators import compare, report, revise, select, translate, tree
from arborspark.plans.analog import BASE, Bundle, bundle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, base: bool = True):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = (BASE if base else "") + sql
        return fn

    return put


def on_bundle(name: str, sql: str | None = None):
    def put(fn):
        query(name, sql)(lambda spark, sf_dir: fn(bundle(spark, sf_dir)))
        return fn

    return put


LIT = "substr('ACMGRSVTWYHKDBN', {p}, 1) || {s} || substr('ACMGRSVTWYHKDBN', {m}, 1)"

on_bundle("ag1_samples", "SELECT node AS sample, (SELECT count(*) FROM ev WHERE ev.node = leaf.node) AS parsimony, parent FROM leaf")(report.samples)
on_bundle("ag2_clades", """, lab AS (SELECT node AS anc, 0 AS k, c0 AS clade FROM node WHERE c0 IS NOT NULL UNION ALL SELECT node, 1, c1 FROM node WHERE c1 IS NOT NULL),
p AS (SELECT c.node, k, clade, row_number() OVER (PARTITION BY c.node, k ORDER BY dist) AS i FROM clo c JOIN lab USING (anc) JOIN leaf ON leaf.node = c.node WHERE dist > 0)
SELECT clade, count(*) AS inclusive, count(*) FILTER (i = 1) AS exclusive FROM p GROUP BY clade""")(report.clades)
on_bundle("ag3_mutations", "SELECT literal AS mutation, count(*) AS occurrence FROM lit GROUP BY literal")(report.mutations)
on_bundle("ag4_haplotypes", f""", h AS (SELECT node, string_agg({LIT.format(p='ref', s='pos', m='mut')}, ',' ORDER BY pos) AS h FROM st WHERE mut <> ref GROUP BY node)
SELECT coalesce(h, 'reference') AS haplotype, count(*) AS samples FROM leaf LEFT JOIN h USING (node) GROUP BY 1""")(report.haplotypes)
on_bundle("ag5_spectrum", """, b AS (SELECT unnest([1, 2, 4, 8]) AS x)
SELECT substr('ACMGRSVTWYHKDBN', p.x, 1) AS from_base, substr('ACMGRSVTWYHKDBN', m.x, 1) AS to_base, (SELECT count(*) FROM ev WHERE par = p.x AND mut = m.x) AS n FROM b p, b m""")(report.spectrum)
on_bundle("ag6_aberrant", """, l AS (SELECT node, CASE WHEN node LIKE '%77' THEN 1 ELSE 2 END AS n FROM node)
SELECT node, 'internal-no-mutations' AS issue FROM node WHERE NOT is_leaf AND parent IS NOT NULL AND node NOT IN (SELECT node FROM ev)
UNION ALL SELECT node, 'duplicate-node-id' FROM node WHERE is_leaf AND node LIKE 'o%55' UNION ALL SELECT node, 'annotation-count' FROM l WHERE n <> 2""")(
    lambda b: report.aberrant(Bundle(b.node.union(b.leaf.where("node like 'o%55'")), b.event, b.closure, b.state), b.node.select("node", F.expr("if(node like '%77', array(c0), array(c0, c1))").alias("labels")))
)
on_bundle("ag7_sample_clades", """, lab AS (SELECT node AS anc, 0 AS k, c0 AS clade FROM node WHERE c0 IS NOT NULL UNION ALL SELECT node, 1, c1 FROM node WHERE c1 IS NOT NULL),
p AS (SELECT c.node, k, arg_min(clade, dist) AS clade FROM clo c JOIN lab USING (anc) WHERE dist > 0 GROUP BY c.node, k)
SELECT leaf.node AS sample, coalesce(a.clade, 'None') AS annotation_1, coalesce(b.clade, 'None') AS annotation_2 FROM leaf LEFT JOIN p a ON a.node = leaf.node AND a.k = 0 LEFT JOIN p b ON b.node = leaf.node AND b.k = 1""")(report.sample_clades)
on_bundle("ag8_roho", """, inn AS (SELECT node, parent, n_leaves, dfs FROM node WHERE NOT is_leaf AND parent IS NOT NULL),
kids AS (SELECT parent, count(*) AS child_count FROM inn GROUP BY parent HAVING count(*) FILTER (n_leaves > 1) >= 2),
cand AS (SELECT inn.parent, literal, arg_max(inn.node, dfs) AS node FROM lit JOIN inn USING (node) GROUP BY inn.parent, literal),
below AS (SELECT DISTINCT anc AS parent, literal FROM clo JOIN lit USING (node) WHERE dist > 1),
ok AS (SELECT cand.*, child_count, i.n_leaves AS with_count FROM cand JOIN kids USING (parent) JOIN inn i ON i.node = cand.node WHERE i.n_leaves > 5 AND NOT EXISTS (SELECT 1 FROM below b WHERE b.parent = cand.parent AND b.literal = cand.literal)),
o AS (SELECT ok.literal, ok.parent, child_count, with_count, list_sort(list(s.n_leaves)) AS o FROM ok JOIN inn s ON s.parent = ok.parent AND s.node <> ok.node AND s.n_leaves > 5 GROUP BY ALL),
m AS (SELECT literal AS mutation, parent, child_count, with_count, CASE WHEN len(o) % 2 = 1 THEN o[(len(o) + 1) // 2] ELSE (o[len(o) // 2] + o[len(o) // 2 + 1]) // 2 END::BIGINT AS median_without FROM o)
SELECT *, round(log10(with_count / median_without), 9) AS log10_ratio FROM m""")(report.roho)
on_bundle("ag9_node_stats", """, n AS (SELECT anc AS node, count(*) AS k FROM clo JOIN ev USING (node) GROUP BY anc),
la AS (SELECT c.node, min(dist) AS up, arg_min(anc, dist) AS clade FROM clo c JOIN node a ON a.node = c.anc WHERE a.c0 IS NOT NULL OR a.c1 IS NOT NULL GROUP BY c.node),
rv AS (SELECT la.node, count(*) AS r FROM la JOIN clo c ON c.node = la.node AND c.dist < la.up JOIN ev e ON e.node = c.anc JOIN st s ON s.node = la.clade AND s.pos = e.pos WHERE e.mut = e.ref AND s.mut <> s.ref GROUP BY la.node)
SELECT node, n_leaves AS leaf_count, coalesce(k, 0) AS mut_count, round(coalesce(k, 0) / n_leaves, 9) AS mut_density, coalesce(r, 0) AS reversions FROM node LEFT JOIN n USING (node) LEFT JOIN rv USING (node)""")(report.node_stats)
on_bundle("ag10_totals", ", cn AS (SELECT parent, count(*) AS n FROM leaf WHERE node NOT IN (SELECT node FROM ev) GROUP BY parent HAVING count(*) >= 2) SELECT count(*) AS nodes, sum(is_leaf::INT)::BIGINT AS samples, max(level) FILTER (is_leaf)::BIGINT AS max_depth, round(avg(level) FILTER (is_leaf), 9) AS mean_depth, count(DISTINCT c0) + count(DISTINCT c1) AS labels, (SELECT count(*) FROM ev) AS parsimony, (SELECT count(*) FROM cn) AS condensed_nodes, (SELECT sum(n) FROM cn)::BIGINT AS condensed_samples FROM node")(
    lambda b: report.totals(b, tree.condense(b.node, b.event))
)
on_bundle("ag11_allele_counts", """, a AS (SELECT pos, mut, count(*) AS c FROM st JOIN leaf USING (node) WHERE mut <> ref GROUP BY pos, mut)
SELECT pos, string_agg(substr('ACMGRSVTWYHKDBN', mut, 1), ',' ORDER BY mut) AS alt, string_agg(c::VARCHAR, ',' ORDER BY mut) AS ac, (SELECT count(*) FROM leaf) AS an FROM a GROUP BY pos""")(report.allele_counts)
on_bundle("ag12_clade_frequencies", """, lab AS (SELECT node AS anc, c0 AS clade FROM node WHERE c0 IS NOT NULL UNION ALL SELECT node, c1 FROM node WHERE c1 IS NOT NULL),
ins AS (SELECT DISTINCT clade, c.node FROM clo c JOIN lab USING (anc) JOIN leaf ON leaf.node = c.node), size AS (SELECT clade, count(*) AS size FROM ins GROUP BY clade)
SELECT clade, pos, mut, count(*) AS n, any_value(size) AS size FROM ins JOIN st USING (node) JOIN size USING (clade) WHERE mut <> ref GROUP BY clade, pos, mut HAVING count(*) >= 0.05 * any_value(size)""")(lambda b: report.clade_frequencies(b, 0.05))
on_bundle("ag14_inside_outside", """, i AS (SELECT anc AS branch, literal AS mutation, count(*) AS inside FROM clo JOIN lit USING (node) GROUP BY 1, 2),
l AS (SELECT branch, sum(inside)::BIGINT AS local_total FROM i GROUP BY branch HAVING sum(inside) >= 50), t AS (SELECT literal AS mutation, count(*) AS e FROM lit GROUP BY 1)
SELECT branch, mutation, inside, e - inside AS outside, local_total FROM i JOIN l USING (branch) JOIN t USING (mutation) WHERE inside >= 10""")(report.literal_inside_outside)
on_bundle("ag14_enrichment")(report.enrichment)
on_bundle("ag15_back_mutations", """, a AS (SELECT e.node, e.pos, e.mut, arg_min(x.par, dist) AS p FROM ev e JOIN clo c ON c.node = e.node AND dist > 0 JOIN ev x ON x.node = c.anc AND x.pos = e.pos GROUP BY 1, 2, 3)
SELECT pos, count(*) AS n FROM a WHERE p = mut GROUP BY pos""")(report.back_mutations)
on_bundle("de1_paths", """, own AS (SELECT node AS anc, string_agg(literal, ',' ORDER BY pos) AS m FROM lit GROUP BY node)
SELECT c.node, string_agg(anc || ':' || m, ' ' ORDER BY dist DESC) AS path FROM clo c JOIN leaf ON leaf.node = c.node JOIN own USING (anc) GROUP BY c.node""")(report.paths)
on_bundle("de3_node_events", "SELECT node, string_agg(literal, ',' ORDER BY pos) AS mutations FROM lit GROUP BY node")(
    lambda b: b.event.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "par", "mut"))), lambda s: nuc.literal(s["par"], s["pos"], s["mut"])), ",").alias("mutations"))
)
# selections
on_bundle("se1_clade", "SELECT leaf.node FROM leaf JOIN clo c ON c.node = leaf.node WHERE anc = (SELECT arg_min(node, dfs) FROM node WHERE c0 = 'ASIA' OR c1 = 'ASIA')")(lambda b: select.in_clade(b, "ASIA"))
on_bundle("se2_mutation", "SELECT node FROM st JOIN leaf USING (node) WHERE pos = 31 AND mut = 4")(lambda b: select.with_mutation(b, 31, 4))
on_bundle("se3_max_parsimony", "SELECT node FROM leaf WHERE (SELECT count(*) FROM ev WHERE ev.node = leaf.node) <= 3")(lambda b: select.max_parsimony(b, 3))
on_bundle("se4_representatives", """, l AS (SELECT node AS anc, c0 AS clade FROM node WHERE c0 IS NOT NULL UNION ALL SELECT node, c1 FROM node WHERE c1 IS NOT NULL),
m AS (SELECT DISTINCT clade, c.node FROM clo c JOIN l USING (anc) JOIN leaf ON leaf.node = c.node)
SELECT clade, node FROM m QUALIFY row_number() OVER (PARTITION BY clade ORDER BY md5('1:' || node), node) <= 5""")(lambda b: select.representatives(b, 5))
on_bundle("se5_intersection", "SELECT node FROM st JOIN leaf USING (node) WHERE pos = 31 AND mut = 4 AND (SELECT count(*) FROM ev WHERE ev.node = leaf.node) <= 3")(lambda b: select.both(select.with_mutation(b, 31, 4), select.max_parsimony(b, 3)))
on_bundle("se7_short_branches", "SELECT c.node FROM clo c JOIN leaf ON leaf.node = c.node GROUP BY c.node HAVING max(CASE WHEN anc = 'root' THEN 0 ELSE (SELECT count(*) FROM ev WHERE ev.node = anc) END) <= 2")(lambda b: select.short_branches(b, 2))
on_bundle("se8_short_paths", "SELECT c.node FROM clo c JOIN leaf ON leaf.node = c.node GROUP BY c.node HAVING sum(CASE WHEN anc = 'root' THEN 0 ELSE (SELECT count(*) FROM ev WHERE ev.node = anc) END) <= 5")(lambda b: select.short_paths(b, 5))
on_bundle("se10_regex", "SELECT node FROM leaf WHERE regexp_full_match(node, 'o[0-9]*7')")(lambda b: select.by_name(b, "o[0-9]*7"))
on_bundle("se11_thin", "SELECT node FROM leaf ORDER BY md5('1:' || node), node LIMIT 100")(lambda b: select.thin(b.leaf.select("node"), 100))
on_bundle("se12_under_lca", """, s AS (SELECT c.anc, count(DISTINCT c.node) AS k, any_value(level) AS l FROM clo c JOIN node a ON a.node = c.anc WHERE c.node IN (SELECT node FROM leaf WHERE regexp_full_match(node, 'o1[0-9]')) GROUP BY c.anc)
SELECT leaf.node FROM leaf JOIN clo c ON c.node = leaf.node WHERE anc = (SELECT arg_max(anc, l) FROM s WHERE k = (SELECT max(k) FROM s))""")(lambda b: select.under_lca(b, select.by_name(b, "o1[0-9]")))
_NEAR = "(SELECT min(node) FROM leaf WHERE level = 4)"
_TOTAL = ", tot AS (SELECT c.node, sum(CASE WHEN anc = 'root' THEN 0 ELSE coalesce(n, 0) END)::BIGINT AS total FROM clo c LEFT JOIN (SELECT node AS anc, count(*) AS n FROM ev GROUP BY node) USING (anc) GROUP BY c.node)"


def _first_leaf(b: Bundle) -> str:
    return b.leaf.where("level = 4").agg(F.min("node")).first()[0]


on_bundle("se6_nearest", f""", own AS (SELECT node AS a, count(*) AS n FROM ev GROUP BY node), pth AS (SELECT anc, dist, n_leaves FROM clo c JOIN node a ON a.node = c.anc WHERE c.node = {_NEAR}),
lastn AS (SELECT arg_max(anc, dist) AS x FROM pth WHERE n_leaves <= 12), widen AS (SELECT arg_min(anc, dist) AS x FROM pth WHERE n_leaves > 12),
bel AS (SELECT c.node, c.dist AS up, leaf.dfs FROM clo c JOIN leaf ON leaf.node = c.node WHERE anc = (SELECT x FROM widen)),
far AS (SELECT bel.node, coalesce(sum(n), 0) AS far FROM bel JOIN clo c ON c.node = bel.node AND c.dist < up LEFT JOIN own ON own.a = c.anc GROUP BY bel.node)
SELECT node FROM bel JOIN far USING (node) ORDER BY EXISTS (SELECT 1 FROM clo z WHERE z.node = bel.node AND z.anc = (SELECT x FROM lastn)) DESC, far, dfs LIMIT 12""")(lambda b: select.nearest(b, _first_leaf(b), 12))
on_bundle("se13_within_distance", f"""{_TOTAL}, j AS (SELECT c.node, arg_max(a.node, a.level) AS l FROM clo c JOIN clo t ON t.anc = c.anc AND t.node = {_NEAR} JOIN node a ON a.node = c.anc JOIN leaf ON leaf.node = c.node WHERE c.node <> {_NEAR} GROUP BY c.node)
SELECT j.node, a.total + b.total - 2 * l.total AS distance FROM j JOIN tot a ON a.node = j.node JOIN tot b ON b.node = {_NEAR} JOIN tot l ON l.node = j.l WHERE a.total + b.total - 2 * l.total <= 9""")(lambda b: select.distances(b, _first_leaf(b)).where("distance <= 9"))
on_bundle("se16_candidates", "SELECT node, (SELECT count(*) FROM ev WHERE ev.node = node.node) AS n, n_leaves FROM node WHERE parent IS NOT NULL AND n_leaves >= 10 AND (SELECT count(*) FROM ev WHERE ev.node = node.node) >= 1")(lambda b: select.candidates(b, 1, 10))
# tree
on_bundle("tr1_order", "SELECT node, level, dfs, dfs_end, n_leaves FROM node")(lambda b: b.node.select("node", "level", "dfs", "dfs_end", "n_leaves"))
on_bundle("tr2_bfs", "SELECT node, row_number() OVER (ORDER BY level, dfs) - 1 AS bfs FROM node")(lambda b: tree.ordered_index(b.node.select("node", "level", "dfs"), ["level", "dfs"], "bfs").select("node", "bfs"))
on_bundle("tr3_closure", "SELECT node, anc, dist FROM clo")(lambda b: b.closure)
on_bundle("tr5_range_leaves", "SELECT a.node, count(*) AS leaves FROM node a JOIN leaf l ON l.dfs BETWEEN a.dfs AND a.dfs_end GROUP BY a.node")(
    lambda b: tree.range_join(b.leaf.select(F.col("dfs").alias("x")), b.node.select("node", F.col("dfs").alias("lo"), F.col("dfs_end").alias("hi")), 1024).groupBy("node").agg(F.count(F.lit(1)).alias("leaves"))
)
on_bundle("tr6_path_totals", f"{_TOTAL} SELECT node, total FROM tot")(lambda b: select.path_totals(b).select("node", "total"))
on_bundle("tr7_lca", """, g AS (SELECT left(node, 3) AS grp, node FROM leaf WHERE level = 4), s AS (SELECT grp, count(*) AS n FROM g GROUP BY grp),
h AS (SELECT g.grp, c.anc, count(*) AS k FROM g JOIN clo c ON c.node = g.node GROUP BY 1, 2) SELECT h.grp, arg_max(anc, level) AS lca FROM h JOIN s USING (grp) JOIN node ON node.node = anc WHERE k = n GROUP BY h.grp""")(
    lambda b: tree.lca(b.closure, b.leaf.where("level = 4").select(F.substring("node", 1, 3).alias("grp"), "node"))
)
on_bundle("tr9_state", "SELECT node, pos, mut, ref FROM st")(lambda b: b.state.select("node", "pos", "mut", "ref"))
on_bundle("tr10_compose", "SELECT c.node, pos, arg_max(par, dist) AS par, arg_min(mut, dist) AS mut FROM clo c JOIN ev ON ev.node = c.anc GROUP BY c.node, pos HAVING arg_max(par, dist) <> arg_min(mut, dist)")(lambda b: tree.compose(b.closure, b.event))
on_bundle("tr13_induced", """, smp AS (SELECT node FROM leaf WHERE regexp_full_match(node, 'o1[0-9]*')), pth AS (SELECT DISTINCT anc AS node FROM clo JOIN smp USING (node)),
kept AS (SELECT parent AS node FROM pth JOIN node USING (node) WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2 UNION SELECT node FROM smp)
SELECT k.node, (SELECT arg_min(anc, dist) FROM clo c WHERE c.node = k.node AND dist > 0 AND anc IN (SELECT node FROM kept)) AS parent FROM kept k""")(lambda b: tree.induced(b.node, b.closure, b.event, select.by_name(b, "o1[0-9]*"))[0])
on_bundle("tr16_collapse", """, kept AS (SELECT node FROM node WHERE is_leaf OR parent IS NULL UNION SELECT node FROM ev)
SELECT k.node, (SELECT arg_min(anc, dist) FROM clo c WHERE c.node = k.node AND dist > 0 AND anc IN (SELECT node FROM kept)) AS parent FROM kept k""")(lambda b: tree.collapse(b.node, b.closure, b.event))
on_bundle("tr17_condense", """, p AS (SELECT node, parent FROM leaf WHERE node NOT IN (SELECT node FROM ev))
SELECT 'node_' || parent || '_condensed_' || count(*) || '_leaves' AS node, parent, string_agg(node, ',' ORDER BY node) AS members, count(*) AS n FROM p GROUP BY parent HAVING count(*) >= 2""")(
    lambda b: tree.condense(b.node, b.event).withColumn("members", F.array_join("members", ","))
)
on_bundle("tr18_uncondense", ", p AS (SELECT node, parent FROM leaf WHERE node NOT IN (SELECT node FROM ev)) SELECT parent, node FROM p WHERE parent IN (SELECT parent FROM p GROUP BY parent HAVING count(*) >= 2)")(lambda b: tree.uncondense(tree.condense(b.node, b.event)))
on_bundle("tr19_polytomies", """, k AS (SELECT node, parent, row_number() OVER (PARTITION BY parent ORDER BY dfs) AS i, count(*) OVER (PARTITION BY parent) AS n FROM node WHERE parent IS NOT NULL)
SELECT node, CASE WHEN n <= 2 OR i = 1 THEN parent ELSE parent || '_polytomy_' || least(i - 1, n - 2) END AS parent FROM k
UNION ALL SELECT parent || '_polytomy_' || (i - 1), CASE WHEN i = 2 THEN parent ELSE parent || '_polytomy_' || (i - 2) END FROM k WHERE n > 2 AND i BETWEEN 2 AND n - 1
UNION ALL SELECT node, NULL FROM node WHERE parent IS NULL""")(lambda b: tree.resolve_polytomies(b.node))
_TURNED = ", pth AS (SELECT anc, dist FROM clo WHERE node = 'n3'), top AS (SELECT pos, mut FROM st WHERE node = 'n3')"
on_bundle("tr20_reroot", f"{_TURNED} SELECT node, CASE WHEN node = 'n3' THEN NULL ELSE coalesce(c.anc, parent) END AS parent FROM node LEFT JOIN pth p ON p.anc = node AND p.dist > 0 LEFT JOIN pth c ON c.dist = p.dist - 1")(lambda b: tree.reroot(b.node, b.closure, b.event, "n3")[0])
on_bundle("tr20_events", f"""{_TURNED} SELECT coalesce(u.anc, ev.node) AS node, ev.pos, coalesce(top.mut, ev.ref) AS ref, CASE WHEN u.anc IS NULL THEN par ELSE ev.mut END AS par, CASE WHEN u.anc IS NULL THEN ev.mut ELSE par END AS mut
FROM ev LEFT JOIN pth p ON p.anc = ev.node LEFT JOIN pth u ON u.dist = p.dist + 1 LEFT JOIN top ON top.pos = ev.pos WHERE ev.node <> 'root'""")(lambda b: tree.reroot(b.node, b.closure, b.event, "n3")[1])
on_bundle("tr22_rotate", "SELECT node, parent, (row_number() OVER (PARTITION BY parent ORDER BY size DESC, dfs))::INT AS child_ord FROM node WHERE parent IS NOT NULL")(lambda b: tree.rotate(b.node))
_Y = ", y4 AS (SELECT node, parent, dfs::DOUBLE AS y FROM node WHERE level = 4)" + "".join(
    f", y{i} AS (SELECT n.node, any_value(n.parent) AS parent, CASE WHEN any_value(n.is_leaf) THEN any_value(n.dfs)::DOUBLE ELSE avg(k.y) END AS y FROM node n LEFT JOIN y{i + 1} k ON k.parent = n.node WHERE level = {i} GROUP BY n.node)" for i in (3, 2, 1, 0)
)
on_bundle("tr23_layout", _Y + " SELECT node, round(y, 6) AS y FROM (" + " UNION ALL ".join(f"SELECT node, y FROM y{i}" for i in range(5)) + ")")(lambda b: tree.fold_up(b.node, "cast(dfs as double)", F.avg, "y").select("node", F.round("y", 6).alias("y")))
on_bundle("tr27_descendant_alleles", "SELECT anc AS node, pos, bit_or(mut) AS alleles FROM clo JOIN ev USING (node) GROUP BY anc, pos")(lambda b: tree.descendant_alleles(b.closure, b.event))
on_bundle("tr32_site_view", "SELECT pos, mut, count(*) AS n, min(node) AS first_node FROM st JOIN leaf USING (node) GROUP BY pos, mut")(lambda b: b.state.join(b.leaf.select("node"), "node").groupBy("pos", "mut").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first_node")))
on_bundle("st1_intersect", "SELECT node FROM leaf WHERE node LIKE 'o1%' INTERSECT SELECT node FROM leaf WHERE node LIKE '%2'")(lambda b: b.leaf.where("node like 'o1%'").select("node").intersect(b.leaf.where("node like '%2'").select("node")))
on_bundle("st2_difference", "SELECT node FROM leaf WHERE node LIKE 'o1%' EXCEPT SELECT node FROM leaf WHERE node LIKE '%2'")(lambda b: b.leaf.where("node like 'o1%'").select("node").exceptAll(b.leaf.where("node like '%2'").select("node")))
on_bundle("st5_bit_sets", "SELECT pos, bit_or(mut) AS any_allele, bit_and(mut) AS all_allele FROM ev GROUP BY pos")(lambda b: b.event.groupBy("pos").agg(F.bit_or("mut").alias("any_allele"), F.bit_and("mut").alias("all_allele")))
on_bundle("wn5_prefix_counts", "SELECT node, pos, count(*) OVER (PARTITION BY node ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev")(
    lambda b: b.event.select("node", "pos", F.count(F.lit(1)).over(W.partitionBy("node").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)).alias("before"))
)
on_bundle("wn7_islands", ", g AS (SELECT DISTINCT node, pos FROM st WHERE mut <> ref), h AS (SELECT *, pos - row_number() OVER (PARTITION BY node ORDER BY pos) AS g FROM g) SELECT node, min(pos) AS start, max(pos) AS stop, count(*) AS n FROM h GROUP BY node, h.g")(
    lambda b: tree.islands(b.state.where("mut <> ref"), "node", "pos")
)
on_bundle("fn2_literals", "SELECT literal, par, pos, mut FROM lit")(
    lambda b: b.event.select(nuc.literal(F.col("par"), F.col("pos"), F.col("mut")).alias("literal")).withColumn("p", nuc.parse_literal(F.col("literal"))).select("literal", "p.par", "p.pos", "p.mut")
)


@query("fn7_complement", "SELECT doc_id, translate(regexp_replace(translate(text, 'acgtmrwsykvhdb', 'ACGTMRWSYKVHDB'), '[^ACGTMRWSYKVHDB]', 'N', 'g'), 'ACGTMRWSYKVHDB', 'TGCAKYWSRMBDHV') AS c FROM documents", base=False)
def complement(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", nuc.complement(F.col("text")).alias("c"))


@query("fn17_drawdown", """
WITH w AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS s FROM events),
c AS (SELECT user_id, event_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS a FROM w),
d AS (SELECT user_id, greatest(0, max(a) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) - a AS f FROM c)
SELECT user_id, greatest(0, max(f))::INT AS k FROM d GROUP BY user_id""", base=False)
def drawdown(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    walk = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id"))), lambda s: F.when(s["event_id"] % 3 == 0, "B").otherwise("A")), "")
    return events.groupBy("user_id").agg(walk.alias("w")).select("user_id", nuc.max_descent(F.col("w")).alias("k"))


def _lineitem(name: str, sql: str):
    def put(fn):
        query(name, sql, base=False)(lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
        return fn

    return put


_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_lineitem("tf1_extremes", "SELECT l_suppkey, min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest, max(l_orderkey) FILTER (l_quantity > 45) AS last_large FROM lineitem GROUP BY l_suppkey")(
    lambda t: t.groupBy("l_suppkey").agg(F.min("l_extendedprice").alias("lowest"), F.max("l_extendedprice").alias("highest"), F.max(F.when(F.col("l_quantity") > 45, F.col("l_orderkey"))).alias("last_large"))
)
_lineitem("tf3_transform_reduce", "SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2")(lambda t: t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("quantity"), F.count(F.lit(1)).alias("n")))
_lineitem("tf4_scans", f"SELECT {_KEYS}, sum(l_quantity::BIGINT) OVER w AS inclusive, coalesce(sum(l_quantity::BIGINT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS exclusive FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)".replace("OVER w AS", "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS").replace("(w ROWS", "(PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS").replace(" WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)", ""))(
    lambda t: t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(F.coalesce(F.sum(F.col("l_quantity").cast("long")).over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey").rowsBetween(W.unboundedPreceding, end)), F.lit(0)).alias(n) for n, end in (("inclusive", 0), ("exclusive", -1))))
)
_lineitem("tf6_transform", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")(lambda t: t.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")))

# state assignment and placement
from arborspark.operators import assign, place  # noqa: E402


def _leaf_sets(b: Bundle) -> DataFrame:
    """Leaf alleles other than the reference."""
    return b.state.where("mut <> ref").join(b.leaf.select("node"), "node", "left_semi").select("node", "pos", "ref", F.col("mut").alias("allele"))


def _fitch_sql() -> str:
    sets = ", site AS (SELECT DISTINCT pos, ref FROM ev), ls AS MATERIALIZED (SELECT leaf.node, leaf.parent, leaf.level, site.pos, site.ref, coalesce(st.mut, site.ref) AS s FROM leaf CROSS JOIN site LEFT JOIN st ON st.node = leaf.node AND st.pos = site.pos)"
    sets += ", u4 AS MATERIALIZED (SELECT node, parent, pos, ref, s FROM ls WHERE level = 4)"
    for i in (3, 2, 1, 0):
        counts = ", ".join(f"sum((s >> {k}) & 1) AS a{k}" for k in range(4))
        most = "greatest(a0, a1, a2, a3)"
        pick = " + ".join(f"CASE WHEN a{k} = {most} THEN {1 << k} ELSE 0 END" for k in range(4))
        sets += f", c{i} AS (SELECT parent AS node, pos, ref, {counts} FROM u{i + 1} GROUP BY parent, pos, ref), u{i} AS MATERIALIZED (SELECT node, parent, pos, ref, s FROM ls WHERE level = {i} UNION ALL SELECT c.node, n.parent, pos, ref, {pick} FROM c{i} c JOIN node n ON n.node = c.node)"
    take = "CASE WHEN s & {p} <> 0 THEN {p} ELSE s & -s END"
    sets += f", d0 AS (SELECT node, pos, ref AS par, {take.format(p='ref')} AS mut FROM u0)"
    for i in (1, 2, 3, 4):
        sets += f", d{i} AS MATERIALIZED (SELECT u.node, u.pos, p.mut AS par, {take.format(p='p.mut')} AS mut FROM u{i} u JOIN d{i - 1} p ON p.node = u.parent AND p.pos = u.pos)"
    return sets + " " + " UNION ALL ".join(f"SELECT node, pos, par, mut FROM d{i} WHERE par <> mut" for i in range(5))


on_bundle("fs2_fitch", _fitch_sql())(lambda b: assign.fitch(b.node, _leaf_sets(b)))


def _new_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic sample per nation: eight sites with alleles from its key."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    rows = nation.select("n_nationkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).selectExpr("concat('s', n_nationkey) sample", "cast((n_nationkey * 7 + i * 13) % 97 as int) pos", "cast(i % 3 as int) i")
    return rows.selectExpr("sample", "pos", "shiftleft(1, pos % 4) ref", "shiftleft(1, (pos + 1 + i) % 4) allele")


_SAMPLES = """, smp AS (SELECT 's' || n_nationkey AS sample, ((n_nationkey * 7 + i * 13) % 97)::INT AS pos, (i % 3)::INT AS i FROM nation, range(8) t(i)),
sm AS MATERIALIZED (SELECT sample, pos, 1 << (pos % 4) AS ref, 1 << ((pos + 1 + i) % 4) AS allele FROM smp), sn AS (SELECT DISTINCT sample FROM sm),
sites AS MATERIALIZED (SELECT DISTINCT pos, 1 << (pos % 4) AS ref FROM (SELECT pos FROM ev UNION SELECT pos FROM sm)),
cls AS MATERIALIZED (SELECT sn.sample, ev.node, ev.pos, ev.mut, CASE WHEN sm.allele IS NULL THEN ev.mut = ev.ref ELSE sm.allele & ev.mut <> 0 END AS common FROM ev CROSS JOIN sn LEFT JOIN sm ON sm.sample = sn.sample AND sm.pos = ev.pos),
base AS (SELECT n.node, sn.sample, s.pos, s.ref, coalesce(c.mut, st.mut, s.ref) AS b FROM node n CROSS JOIN sn CROSS JOIN sites s LEFT JOIN cls c ON c.node = n.node AND c.sample = sn.sample AND c.pos = s.pos AND c.common LEFT JOIN st ON st.node = n.parent AND st.pos = s.pos WHERE n.parent IS NOT NULL),
sc AS MATERIALIZED (SELECT base.sample, base.node, count(*) FILTER (b <> coalesce(sm.allele, base.ref)) AS score FROM base LEFT JOIN sm ON sm.sample = base.sample AND sm.pos = base.pos GROUP BY 1, 2),
k AS (SELECT sample, node, count(*) FILTER (common) AS n_common, count(*) FILTER (NOT common) AS n_unique FROM cls GROUP BY 1, 2),
scored AS MATERIALIZED (SELECT sc.sample, sc.node, score, coalesce(n_common, 0) AS n_common, coalesce(n_unique, 0) AS n_unique FROM sc LEFT JOIN k USING (sample, node))"""
query("pl1_scores", _SAMPLES + " SELECT * FROM scored")(lambda spark, sf_dir: place.scores(bundle(spark, sf_dir), _new_samples(spark, sf_dir)))
query("pl3_best", _SAMPLES + """, adm AS (SELECT scored.*, n_leaves, dfs FROM scored JOIN node USING (node) WHERE (NOT is_leaf AND n_unique > 0 AND n_common > 0) OR (is_leaf AND n_common > 0) OR (NOT is_leaf AND n_unique = 0)),
m AS (SELECT * FROM adm QUALIFY rank() OVER (PARTITION BY sample ORDER BY score) = 1)
SELECT sample, arg_max(node, n_leaves * 1000000000 + dfs) AS node, min(score) AS score, count(*) AS epp FROM m GROUP BY sample""")(lambda spark, sf_dir: place.best(bundle(spark, sf_dir), _new_samples(spark, sf_dir)))


# comparisons, translation, revisions
def _calls(b: Bundle) -> DataFrame:
    return b.state.join(b.leaf.select("node"), "node").select(F.col("node").alias("sample"), "pos", F.col("mut").alias("allele"))


def _other_calls(b: Bundle) -> DataFrame:
    return _calls(b).where("sample not like '%3'").withColumn("allele", F.when(F.col("pos") % 7 == 0, 9).otherwise(F.col("allele")))


_CALLS = ", a AS MATERIALIZED (SELECT node AS sample, pos, mut AS allele FROM st JOIN leaf USING (node)), b AS MATERIALIZED (SELECT sample, pos, CASE WHEN pos % 7 = 0 THEN 9 ELSE allele END AS allele FROM a WHERE sample NOT LIKE '%3')"
on_bundle("jo5_conflicts", f"{_CALLS} SELECT sample, pos, a.allele AS left_allele, b.allele AS right_allele FROM a JOIN b USING (sample, pos) WHERE a.allele & b.allele = 0")(lambda b: compare.genotype_conflicts(_calls(b), _other_calls(b)))
on_bundle("jo5_missing", f"{_CALLS} SELECT DISTINCT sample, 'right' AS absent_from FROM a WHERE sample NOT IN (SELECT sample FROM b)")(lambda b: compare.missing_samples(_calls(b), _other_calls(b)))
on_bundle("jo8_changed_counts", """, x AS (SELECT literal AS name, count(*) AS before FROM lit GROUP BY 1), y AS (SELECT literal AS name, count(*) AS after FROM lit WHERE node NOT LIKE '%3' GROUP BY 1)
SELECT name, before, after, after - before AS delta FROM x JOIN y USING (name) WHERE before <> after""")(
    lambda b: compare.changed_counts(*(report.mutations(x).select(F.col("mutation").alias("name"), F.col("occurrence").alias("n")) for x in (b, Bundle(b.node, b.event.where("node not like '%3'"), b.closure, b.state))))
)
_GENES = [("g1", 1, 3, 32, "+"), ("g2", 1, 20, 49, "-"), ("g3", 1, 50, 70, "+"), ("g3", 2, 72, 92, "+")]


def _sites(b: Bundle) -> DataFrame:
    return translate.codon_sites(b.node.sparkSession.createDataFrame(_GENES, "gene string, ord int, start int, stop int, strand string"))


_SITES = """, gene(gene, ord, start, stop, strand) AS (VALUES """ + ", ".join(map(str, _GENES)) + """),
cs AS (SELECT gene, strand, (coalesce((SELECT sum((p.stop - p.start + 1) // 3) FROM gene p WHERE p.gene = g.gene AND p.ord < g.ord), 0) + s // 3 + 1)::INT AS codon, (s % 3)::INT AS i, (CASE strand WHEN '-' THEN stop - s ELSE start + s END)::INT AS pos
FROM gene g, generate_series(0, 200) t(s) WHERE s < (stop - start + 1) // 3 * 3)"""
on_bundle("tl1_codon_sites", f"{_SITES} SELECT gene, strand, codon, i, pos FROM cs")(_sites)
_AA = "substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (instr('TCAG', {c}[1]) - 1) * 16 + (instr('TCAG', {c}[2]) - 1) * 4 + instr('TCAG', {c}[3]), 1)"
on_bundle("tl2_amino_changes", f"""{_SITES}, h AS (SELECT DISTINCT node, gene, codon FROM ev JOIN cs USING (pos)),
l AS (SELECT h.node, gene, codon, strand, i, coalesce(e.par, s.mut, 1 << (pos % 4)) AS o, coalesce(e.mut, s.mut, 1 << (pos % 4)) AS n FROM h JOIN cs USING (gene, codon) JOIN node USING (node) LEFT JOIN ev e USING (node, pos) LEFT JOIN st s ON s.node = node.parent AND s.pos = cs.pos),
k AS (SELECT node, gene, codon, any_value(strand) AS strand, string_agg(substr('ACMGRSVT', o::INT, 1), '' ORDER BY i) AS o, string_agg(substr('ACMGRSVT', n::INT, 1), '' ORDER BY i) AS n FROM l GROUP BY 1, 2, 3),
m AS (SELECT node, gene, codon, CASE strand WHEN '-' THEN translate(o, 'ACGT', 'TGCA') ELSE o END AS old_codon, CASE strand WHEN '-' THEN translate(n, 'ACGT', 'TGCA') ELSE n END AS new_codon FROM k)
SELECT *, {_AA.format(c='old_codon')} AS old_aa, {_AA.format(c='new_codon')} AS new_aa FROM m""")(
    lambda b: translate.amino_changes(b.node, b.event, b.state, _sites(b), b.node.sparkSession.range(97).selectExpr("cast(id as int) pos", "shiftleft(1, cast(id % 4 as int)) ref"))
)
query("tl3_dictionary", "SELECT c_name AS value, dense_rank() OVER (ORDER BY c_name) AS code FROM (SELECT DISTINCT c_name FROM customer)", base=False)(lambda spark, sf_dir: translate.dictionary(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_name"))
on_bundle("op12_reversions", """, s AS (SELECT node, any_value(pos) AS pos, any_value(ref) AS ref, any_value(par) AS par, any_value(mut) AS mut FROM ev GROUP BY node HAVING count(*) = 1), o AS (SELECT s.*, parent FROM s JOIN node USING (node))
SELECT a.node, a.parent, b.parent AS grandparent, c.parent AS target, b.pos, b.ref, b.par, b.mut FROM o a JOIN o b ON b.node = a.parent JOIN o c ON c.node = b.parent WHERE c.parent IS NOT NULL AND a.pos = c.pos AND a.mut = c.par AND a.par = c.mut""")(
    lambda b: revise.grandparent_reversions(b.node, b.event)
)
on_bundle("ma1_mask_private", """, i AS (SELECT anc AS node, count(*) AS k FROM clo WHERE node IN (SELECT node FROM leaf WHERE node LIKE 'o1%') GROUP BY anc)
SELECT node, pos, par, mut, coalesce(k = n_leaves, false) AS masked FROM ev JOIN node USING (node) LEFT JOIN i USING (node)""")(
    lambda b: revise.mask_private(b.node, b.closure, b.event, b.leaf.where("node like 'o1%'")).select("node", "pos", "par", "mut", "masked")
)
_REGION = ", r AS (SELECT anc, right(c.node, 1) AS region, count(*) AS k FROM clo c JOIN leaf ON leaf.node = c.node GROUP BY 1, 2)"
_regions = lambda b: b.leaf.select("node", F.substring("node", -1, 1).alias("region"))
on_bundle("in1_association_index", f"""{_REGION}, q AS (SELECT anc, sum(k) AS n, max(k) AS most FROM r JOIN node ON node.node = anc WHERE NOT is_leaf GROUP BY anc)
SELECT round(sum((1 - most / n) * pow(0.5::DOUBLE, least(n - 1, 1000))), 9) AS association_index FROM q""")(lambda b: revise.association_index(b.node, b.closure, _regions(b)).select(F.round("association_index", 9).alias("association_index")))
on_bundle("in1_monophyletic", f"{_REGION} SELECT region, max(k) AS size FROM r JOIN node ON node.node = anc WHERE k = n_leaves GROUP BY region")(lambda b: revise.monophyletic_sizes(b.node, b.closure, _regions(b)))


# recombination
from arborspark.operators import recombine  # noqa: E402

on_bundle("rc10_descendants", "SELECT a.anc AS node, least(count(*), 10) AS n, (any_value(a.dist) - 1)::INT AS extra FROM clo a JOIN leaf ON leaf.node = a.node WHERE dist = (SELECT min(x.dist) FROM clo x JOIN leaf l ON l.node = x.node WHERE x.anc = a.anc AND x.dist BETWEEN 1 AND 3) AND dist BETWEEN 1 AND 3 GROUP BY a.anc")(
    lambda b: recombine.near_descendants(b, b.node.where("not is_leaf").select("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("extra").alias("extra"))
)
_TRIO = "SELECT l_orderkey AS recomb, l_partkey AS donor, l_suppkey AS acceptor, l_linenumber AS breakpoints, l_quantity::INT AS n_sites, l_discount AS p, (l_partkey % 50)::INT AS parent_leaves, l_extendedprice AS width FROM lineitem"
_trios = lambda t: t.selectExpr("l_orderkey recomb", "l_partkey donor", "l_suppkey acceptor", "l_linenumber breakpoints", "cast(l_quantity as int) n_sites", "l_discount p", "cast(l_partkey % 50 as int) parent_leaves", "l_extendedprice width")
_lineitem("rc14_tie_break", f"SELECT * FROM ({_TRIO}) QUALIFY row_number() OVER (PARTITION BY recomb ORDER BY breakpoints, n_sites, p, parent_leaves, width DESC, donor, acceptor) = 1")(lambda t: recombine.tie_break(_trios(t)))
_lineitem("ag19_empirical_p", """WITH null_model AS (SELECT l_linenumber + 5 AS parsimony, (l_quantity % 7)::INT AS improvement, count(*) AS n FROM lineitem GROUP BY 1, 2),
found AS (SELECT l_orderkey AS recomb, l_linenumber + 6 AS s, (l_suppkey % 5)::INT AS r FROM lineitem WHERE l_linenumber > 1)
SELECT recomb, s AS min_starting_parsimony, r AS recomb_parsimony, (SELECT sum(n) FROM null_model WHERE parsimony = s)::BIGINT AS total,
CASE WHEN s IN (SELECT parsimony FROM null_model) THEN coalesce((SELECT sum(n) FROM null_model WHERE parsimony = s AND improvement >= s - r), 0)::BIGINT END AS tail FROM found WHERE s > 0 AND s - r >= 3""")(
    lambda t: recombine.empirical_p(
        t.where("l_linenumber > 1").selectExpr("l_orderkey recomb", "l_linenumber + 6 min_starting_parsimony", "cast(l_suppkey % 5 as int) recomb_parsimony"),
        t.selectExpr("l_linenumber + 5 parsimony", "cast(l_quantity % 7 as int) improvement").groupBy("parsimony", "improvement").agg(F.count(F.lit(1)).alias("n")),
    )
)
_lineitem("rc9_walks", """WITH s AS (SELECT l_orderkey AS trio, l_partkey AS pos, CASE WHEN min(l_suppkey) % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM lineitem GROUP BY 1, 2)
SELECT trio, string_agg(side, '' ORDER BY pos) AS seq, count(*) FILTER (side = 'A') AS n_a, count(*) FILTER (side = 'B') AS n_b, max(pos) FILTER (side = 'A') - min(pos) FILTER (side = 'A') AS a_span, max(pos) FILTER (side = 'B') - min(pos) FILTER (side = 'B') AS b_span
FROM s GROUP BY trio HAVING a_span > 20 AND b_span > 20""")(
    lambda t: recombine.not_clustered(recombine.walks(t.groupBy(F.col("l_orderkey").alias("trio"), F.col("l_partkey").alias("pos")).agg(F.when(F.min("l_suppkey") % 2 == 0, "A").otherwise("B").alias("side"))))
)


# clade labels, introductions, density
from arborspark.operators import annotate, regions  # noqa: E402


def _given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of nations: the segment of each of their customers, the first customer's counts."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey ord", "c_mktsegment clade", "concat('n', c_nationkey) node")


_GIVEN = ", gv AS (SELECT 'n' || c_nationkey AS node, arg_min(c_mktsegment, c_custkey) AS clade FROM customer GROUP BY 1)"
query("an1_by_node", f"{_GIVEN} SELECT node, clade FROM gv")(lambda spark, sf_dir: annotate.by_node(bundle(spark, sf_dir), _given(spark, sf_dir)))
query("an5_labels", f"{_GIVEN} SELECT node, coalesce(c0, '') || '/' || coalesce(c1, '') || '/' || coalesce(clade, '') AS labels FROM node LEFT JOIN gv USING (node)")(
    lambda spark, sf_dir: annotate.with_column(bundle(spark, sf_dir), annotate.by_node(bundle(spark, sf_dir), _given(spark, sf_dir))).select("node", F.array_join("labels", "/").alias("labels"))
)
_KNOWN = ", sm AS MATERIALIZED (SELECT node.node AS sample, pos, ref, mut AS allele FROM st JOIN node USING (node) WHERE level = 2 AND mut <> ref), sn AS (" + _SAMPLES.split("sn AS (", 1)[1]
on_bundle("an3_by_mutations", _KNOWN + """, adm AS (SELECT scored.*, n_leaves, dfs FROM scored JOIN node USING (node) WHERE (NOT is_leaf AND n_unique > 0 AND n_common > 0) OR (is_leaf AND n_common > 0) OR (NOT is_leaf AND n_unique = 0))
SELECT sample AS clade, arg_max(node, n_leaves * 1000000000 + dfs) AS node FROM adm WHERE score = 0 GROUP BY sample""")(
    lambda b: annotate.by_mutations(b, b.state.where("mut <> ref").join(b.node.where("level = 2").select("node"), "node").select(F.col("node").alias("sample"), "pos", "ref", F.col("mut").alias("allele")))
)
_INTRO = f"""{_TOTAL}, q AS (SELECT c.anc, count(*) FILTER (leaf.node LIKE '%1') AS il, count(*) FILTER (leaf.node NOT LIKE '%1') AS ol, min(total) FILTER (leaf.node LIKE '%1') AS it, min(total) FILTER (leaf.node NOT LIKE '%1') AS ot
FROM clo c JOIN leaf ON leaf.node = c.node JOIN tot ON tot.node = c.node GROUP BY c.anc),
cf AS MATERIALIZED (SELECT node, (CASE WHEN ol = 0 THEN 1 WHEN il = 0 THEN 0 WHEN (ot - total) * il + (it - total) * ol = 0 THEN il / (il + ol) ELSE (ot - total) * il / ((ot - total) * il + (it - total) * ol) END)::DOUBLE AS confidence FROM q JOIN tot ON tot.node = q.anc)"""
_members = lambda b: b.leaf.where("node like '%1'").select("node")
on_bundle("in1_confidences", f"{_INTRO} SELECT node, round(confidence, 9) AS confidence FROM cf")(lambda b: regions.confidences(b, _members(b)).select("node", F.round("confidence", 9).alias("confidence")))
on_bundle("in1_introductions", f"""{_INTRO}, p AS (SELECT c.node, c.anc, c.dist, confidence FROM clo c JOIN cf ON cf.node = c.anc JOIN leaf ON leaf.node = c.node WHERE c.node LIKE '%1'), s AS (SELECT node, min(dist) FILTER (confidence < 0.5) AS stop FROM p GROUP BY node)
SELECT p.node AS sample, arg_max(anc, dist) AS introduction FROM p JOIN s USING (node) WHERE stop IS NULL OR dist < stop GROUP BY p.node""")(lambda b: regions.introductions(b, _members(b)))
on_bundle("se9_density")(lambda b: regions.dense_leaves(b, 3.0))
on_bundle("an4_by_samples")(lambda b: annotate.by_samples(b, b.closure.join(b.leaf.select("node"), "node").join(b.node.where("level = 2").select(F.col("node").alias("anc")), "anc").select(F.col("anc").alias("clade"), "node"), keep=0.5))


# whole tables: the same operators over all customers, inner nodes and leaves; too wide for SQL, so without it (tests/test_whole_tables.py)
def _customer_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One synthetic sample per customer, made like those of the nations."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i")).selectExpr("concat('s', c_custkey) sample", "cast((c_custkey * 7 + i * 13) % 97 as int) pos", "cast(i % 3 as int) i")
    return rows.selectExpr("sample", "pos", "shiftleft(1, pos % 4) ref", "shiftleft(1, (pos + 1 + i) % 4) allele")


_inner = lambda b: b.node.where("not is_leaf and parent is not null").select("node")
query("pl1_scores_all")(lambda spark, sf_dir: place.scores(bundle(spark, sf_dir), _customer_samples(spark, sf_dir)))
query("pl3_best_all")(lambda spark, sf_dir: place.best(bundle(spark, sf_dir), _customer_samples(spark, sf_dir)))
on_bundle("an3_by_mutations_all")(lambda b: annotate.by_mutations(b, b.state.where("mut <> ref").join(_inner(b), "node").select(F.col("node").alias("sample"), "pos", "ref", F.col("mut").alias("allele"))))
on_bundle("an4_by_samples_all")(lambda b: annotate.by_samples(b, b.closure.join(b.leaf.select("node"), "node").join(_inner(b).withColumnRenamed("node", "anc"), "anc").select(F.col("anc").alias("clade"), "node"), keep=0.5))
on_bundle("tr7_lca_all")(lambda b: tree.lca(b.closure, b.leaf.select(F.substring("node", 1, 3).alias("grp"), "node")))


import arborspark.queries_parts  # noqa: E402, F401
