"""Queries of parts of trees, placement outputs, text round trips and scalars; they join those of ``queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.functions import nucleotides as nuc
from arborspark.operators import assign, calls, extract, place, report, select, tree, trios
from arborspark.plans.analog import SITES, Bundle, bundle
from arborspark.plans.scratch import materialize, new_path
from arborspark.queries import _SAMPLES, LIT, _leaf_sets, _new_samples, on_bundle, query
from arborspark.sinks import columns
from arborspark.sinks import text as sink
from arborspark.sources import text as source

# placement outputs
_MINIMA = """, adm AS MATERIALIZED (SELECT scored.*, is_leaf, n_leaves, dfs FROM scored JOIN node USING (node) WHERE (NOT is_leaf AND n_unique > 0 AND n_common > 0) OR (is_leaf AND n_common > 0) OR (NOT is_leaf AND n_unique = 0)),
m AS MATERIALIZED (SELECT * FROM adm QUALIFY rank() OVER (PARTITION BY sample ORDER BY score) = 1),
ch AS MATERIALIZED (SELECT sample, arg_max(node, n_leaves * 1000000000 + dfs) AS node, min(score) AS score, count(*) AS epp FROM m GROUP BY sample)"""
_CALLS = _MINIMA + """, lab AS (SELECT node AS anc, 0 AS k, c0 AS clade FROM node WHERE c0 IS NOT NULL UNION ALL SELECT node, 1, c1 FROM node WHERE c1 IS NOT NULL),
nx AS (SELECT m.sample, m.node, lab.k, arg_min(clade, dist) AS clade FROM m JOIN clo c ON c.node = m.node JOIN lab ON lab.anc = c.anc WHERE dist > 0 OR (NOT m.is_leaf AND m.n_unique = 0) GROUP BY 1, 2, 3),
nm AS (SELECT m.sample, m.node, t.k, coalesce(clade, 'UNDEFINED') AS clade FROM m CROSS JOIN (VALUES (0), (1)) t(k) LEFT JOIN nx ON nx.sample = m.sample AND nx.node = m.node AND nx.k = t.k),
h AS (SELECT sample, k, clade, count(*) AS n, sum(count(*)) OVER (PARTITION BY sample, k) AS total FROM nm GROUP BY sample, k, clade),
hs AS (SELECT sample, k, string_agg(clade || '(' || n || '/' || total || ')', ',' ORDER BY clade) AS histogram FROM h GROUP BY sample, k),
calls AS (SELECT nm.sample, (k + 1)::INT AS annotation, nm.clade AS best, histogram FROM nm JOIN ch USING (sample, node) JOIN hs USING (sample, k))"""


def on_samples(name: str, sql: str | None = None):
    """A query of the bundle and the synthetic samples."""

    def put(fn):
        query(name, sql)(lambda spark, sf_dir: fn(bundle(spark, sf_dir), _new_samples(spark, sf_dir)))
        return fn

    return put


def _clade_calls(b: Bundle, samples: DataFrame) -> DataFrame:
    """The nodes are searched once for the minima and the chosen ones among them."""
    rows = materialize(place.minima(b, samples), "minima")
    chosen = rows.groupBy("sample").agg(F.max_by("node", F.struct("n_leaves", "dfs")).alias("node"))
    return calls.clade_calls(b, rows, chosen)


on_samples("pl9_clade_calls", _SAMPLES + _CALLS + " SELECT * FROM calls")(lambda b, s: _clade_calls(b, s))
on_samples("sk9_clade_lines", _SAMPLES + _CALLS + " SELECT sample, sample || chr(9) || string_agg(best || '*|' || histogram, chr(9) ORDER BY annotation) AS value FROM calls GROUP BY sample")(lambda b, s: calls.clade_lines(_clade_calls(b, s)))
on_samples("se15_rejection", _SAMPLES + _MINIMA + " SELECT sample, node, score, epp, epp > 1 AS low_confidence, epp > 3 OR score > 8 AS rejected FROM ch")(lambda b, s: calls.verdicts(place.best(b, s), 3, 8))
on_samples("se14_few_placements", _SAMPLES + _MINIMA + " SELECT sample, node, score, epp FROM ch WHERE epp <= 2")(lambda b, s: calls.at_most_placements(place.best(b, s), 2))
on_samples("so1_order", _SAMPLES + _MINIMA + " SELECT sample, row_number() OVER (ORDER BY score DESC, epp DESC, sample) AS place FROM ch")(
    lambda b, s: tree.ordered_index(calls.placement_order(place.best(b, s), s, reverse=True).select("sample", (-F.col("score")).alias("a"), (-F.col("epp")).alias("z")), ["a", "z", "sample"], "place").select("sample", (F.col("place") + 1).alias("place"))
)
on_samples("pl12_per_node", _SAMPLES + _MINIMA + " SELECT sample, node, scored.score + CASE WHEN adm.node IS NULL THEN 1 ELSE 0 END AS score FROM scored LEFT JOIN adm USING (sample, node)")(place.per_node)
on_samples("pl5_shared_events", _SAMPLES + """, hit AS (SELECT DISTINCT sm.sample, ev.node, ev.pos FROM ev JOIN sm USING (pos) WHERE sm.allele <> sm.ref AND sm.allele & ev.mut <> 0)
SELECT x.sample, x.node, count(DISTINCT h.pos) AS shared FROM (SELECT DISTINCT sample, node FROM hit) x JOIN clo c ON c.node = x.node JOIN hit h ON h.node = c.anc AND h.sample = x.sample GROUP BY 1, 2""")(place.shared_events)


@on_samples("pl3_nearest", _SAMPLES + _MINIMA + """, d AS (SELECT m.sample, m.node, min(a.dist + z.dist) AS distance FROM m JOIN clo a ON a.node = m.node JOIN clo z ON z.node = 'n' || substr(m.sample, 2) AND z.anc = a.anc GROUP BY 1, 2)
SELECT sample, m.node, score, count(*) OVER (PARTITION BY sample) AS epp FROM m JOIN d USING (sample, node) QUALIFY row_number() OVER (PARTITION BY sample ORDER BY distance, n_leaves DESC, dfs DESC) = 1""")
def _nearest_placement(b: Bundle, samples: DataFrame) -> DataFrame:
    """Each sample goes as near as possible to the nation of its number."""
    home = F.concat(F.lit("n"), F.substr("sample", F.lit(2)))
    pairs = materialize(place.minima(b, samples).select("sample", "node", home.alias("z")), "minima")
    far = tree.node_distances(b.node, b.closure, pairs.select(F.col("node").alias("a"), "z"))
    return place.best(b, samples, far.join(pairs.withColumnRenamed("node", "a"), ["a", "z"]).select("sample", F.col("a").alias("node"), "distance"))


_RUNS = _SAMPLES.replace("sm AS MATERIALIZED (", "sm0 AS MATERIALIZED (").replace(", sn AS (", """, rns AS (SELECT 's' || n_nationkey AS sample, (n_nationkey * 11 % 97)::INT AS start, (n_nationkey * 11 % 97 + 12)::INT AS stop FROM nation),
unk AS (SELECT DISTINCT rns.sample, ev.pos, ev.ref, 15 AS allele FROM ev JOIN rns ON ev.pos BETWEEN start AND stop),
sm AS MATERIALIZED (SELECT * FROM sm0 WHERE NOT EXISTS (SELECT 1 FROM unk WHERE unk.sample = sm0.sample AND unk.pos = sm0.pos) UNION ALL SELECT * FROM unk), sn AS (""", 1).replace("b <> coalesce(sm.allele, base.ref)", "b & coalesce(sm.allele, base.ref) = 0")


@query("jo2_unknown_runs", _RUNS + _MINIMA + " SELECT sample, node, score, epp FROM ch")
def _unknown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with a run of thirteen unknown bases each."""
    b = bundle(spark, sf_dir)
    runs = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("concat('s', n_nationkey) sample", "cast(n_nationkey * 11 % 97 as int) start", "cast(n_nationkey * 11 % 97 + 12 as int) stop")
    return place.best(b, place.with_runs(b, _new_samples(spark, sf_dir), runs))


_UNCLEAR = _SAMPLES.replace("1 << ((pos + 1 + i) % 4) AS allele FROM smp)", "(1 << ((pos + 1 + i) % 4)) | (1 << ((pos + 2 + i) % 4)) AS allele FROM smp)").replace("b <> coalesce(sm.allele, base.ref)", "b & coalesce(sm.allele, base.ref) = 0")
_IMPUTED = _MINIMA + """, bs AS (SELECT ch.sample, sm.pos, sm.allele, coalesce(CASE WHEN e.mut & sm.allele <> 0 THEN e.mut END, s.mut, sm.ref) AS base FROM ch JOIN sm USING (sample) JOIN node n ON n.node = ch.node LEFT JOIN ev e ON e.node = ch.node AND e.pos = sm.pos LEFT JOIN st s ON s.node = coalesce(n.parent, n.node) AND s.pos = sm.pos),
im AS (SELECT sample, string_agg(pos || ':' || substr('ACMGRSVTWYHKDBN', CASE WHEN base & allele <> 0 THEN base & allele ELSE allele & -allele END, 1), ';' ORDER BY pos) AS imputed FROM bs GROUP BY sample)"""


def _unclear(samples: DataFrame) -> DataFrame:
    """Each entry may also be the next base."""
    return samples.withColumn("allele", F.col("allele").bitwiseOR(F.expr("shiftleft(1, (cast(log2(allele) as int) + 1) % 4)")))


def _statistics(b: Bundle, samples: DataFrame) -> DataFrame:
    best = materialize(place.best(b, samples), "best")
    return calls.statistics_lines(best, calls.imputed_bases(b, samples, best))


on_samples("pl10_imputed", _UNCLEAR + _IMPUTED + " SELECT * FROM im")(lambda b, s: calls.imputed_bases(b, _unclear(s), place.best(b, _unclear(s))))
on_samples("sk9_statistics", _UNCLEAR + _IMPUTED + " SELECT sample, sample || chr(9) || score || chr(9) || epp || chr(9) || imputed || ';' AS value FROM ch JOIN im USING (sample)")(
    lambda b, s: _statistics(b, _unclear(s))
)
on_samples("ud2_merge_visit", _SAMPLES + """, one AS (SELECT sn.sample, ev.node, ev.pos, ev.mut FROM ev JOIN sn ON ev.node = 'n' || substr(sn.sample, 2))
SELECT coalesce(sm.sample, one.sample) AS sample, one.node, coalesce(sm.pos, one.pos) AS pos, sm.allele, one.mut, CASE WHEN sm.allele = 15 THEN 'unknown' WHEN one.mut IS NULL THEN 'sample' WHEN sm.allele IS NULL THEN 'node' ELSE 'both' END AS visit
FROM sm FULL JOIN one ON one.sample = sm.sample AND one.pos = sm.pos""")(
    lambda b, s: calls.merge_visit(s, b.event.where("node like 'n%'").select(F.concat(F.lit("s"), F.substr("node", F.lit(2))).alias("sample"), "node", "pos", "mut"))
)

# parts of a tree
_KEPT = """, pth AS (SELECT DISTINCT anc AS node FROM clo JOIN smp USING (node)), kept AS (SELECT parent AS node FROM pth JOIN node USING (node) WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2 UNION SELECT node FROM smp)
SELECT k.node, (SELECT arg_min(anc, dist) FROM clo c WHERE c.node = k.node AND dist > 0 AND anc IN (SELECT node FROM kept)) AS parent FROM kept k"""
on_bundle("tr14_prune", ", smp AS (SELECT node FROM leaf WHERE NOT regexp_full_match(node, 'o[0-9]*[0-6]'))" + _KEPT)(lambda b: extract.prune(b, select.by_name(b, "o[0-9]*[0-6]"))[0])
on_bundle("tr15_restrict", ", smp AS (SELECT node FROM leaf WHERE node LIKE '%4')" + _KEPT)(lambda b: extract.restrict(b, b.leaf.where("node like '%4'").select(F.col("node").alias("sample")).union(b.node.sparkSession.createDataFrame([("absent",)], "sample string")))[0])
on_bundle("de2_clade_paths", """, lab AS (SELECT node, level, dfs, c0 AS clade FROM node WHERE c0 IS NOT NULL UNION ALL SELECT node, level, dfs, c1 FROM node WHERE c1 IS NOT NULL),
fst AS (SELECT clade, arg_min(node, level::BIGINT * 1000000000 + dfs) AS node FROM lab GROUP BY clade), own AS (SELECT node AS anc, string_agg(literal, ',' ORDER BY pos) AS m FROM lit GROUP BY node),
p AS (SELECT clade, string_agg(m, ' > ' ORDER BY dist DESC) AS path FROM fst JOIN clo c USING (node) JOIN own USING (anc) GROUP BY clade) SELECT clade, node, coalesce(path, '') AS path FROM fst LEFT JOIN p USING (clade)""")(report.labelled_paths)
on_bundle("tr21_rename_move", """SELECT CASE WHEN node LIKE 'n%' THEN 'nation_' || substr(node, 2) ELSE node END AS node, CASE WHEN node = 'n3' THEN 'r0' WHEN parent LIKE 'n%' THEN 'nation_' || substr(parent, 2) ELSE parent END AS parent FROM node""")(
    lambda b: extract.rename(extract.move(b.node.select("node", "parent"), "n3", "r0"), b.node.where("node like 'n%'").select(F.col("node").alias("old"), F.concat(F.lit("nation_"), F.substr("node", F.lit(2))).alias("new")), "node", "parent")
)
on_bundle("tr21_remove_create", "SELECT node, CASE WHEN parent = 'n4' THEN (SELECT parent FROM node WHERE node = 'n4') ELSE parent END AS parent FROM node WHERE node <> 'n4' UNION ALL SELECT 'extra', 'r1'")(lambda b: extract.create(extract.remove(b.node.select("node", "parent"), "n4"), "extra", "r1"))
on_bundle("tr21_copy", "SELECT node, parent FROM node UNION ALL SELECT 'copy_' || c.node, CASE WHEN c.node = 'n2' THEN 'r3' ELSE 'copy_' || parent END FROM clo c JOIN node ON node.node = c.node WHERE anc = 'n2'")(lambda b: extract.copy_subtree(b.node.select("node", "parent"), b.event, b.closure, "n2", "r3", "copy_")[0])
on_bundle("tr24_other_preorder", "SELECT node, dfs, row_number() OVER (ORDER BY k1 DESC, CASE WHEN k2 = -1 THEN 1e18 ELSE k2 END DESC, CASE WHEN k3 = -1 THEN 1000000000000000000 ELSE k3 END DESC, CASE WHEN k4 = -1 THEN 1000000000000000000 ELSE k4 END DESC) - 1 AS stack_dfs FROM node".replace("ORDER BY k1 DESC", "ORDER BY CASE WHEN k1 = -1 THEN 1e18 ELSE k1 END DESC"))(lambda b: tree.other_preorder(b.node))
on_bundle("tr28_random_subtree", """, own AS (SELECT node FROM leaf WHERE regexp_full_match(node, 'o1[0-9]')), smp AS (SELECT node FROM leaf ORDER BY node NOT IN (SELECT node FROM own), md5('1:' || node), node LIMIT 40)""" + _KEPT)(lambda b: extract.random_subtree(b, select.by_name(b, "o1[0-9]"), 40)[0])
on_bundle("tr30_artificial_root", ", e AS (SELECT node FROM node WHERE parent IS NULL) SELECT node, CASE WHEN parent IS NULL THEN 'above' ELSE parent END AS parent FROM node UNION ALL SELECT 'above', NULL")(
    lambda b: extract.with_artificial_root(b.node.select("node", "parent"), b.event.select("node").union(b.node.where("parent is null").select("node")), "above")
)
on_bundle("tr30_above_condensed", """, x AS (SELECT DISTINCT node FROM ev JOIN leaf USING (node) WHERE node LIKE '%9')
SELECT node, CASE WHEN node IN (SELECT node FROM x) THEN node || '_above' ELSE parent END AS parent FROM node UNION ALL SELECT node || '_above', parent FROM node WHERE node IN (SELECT node FROM x)""")(
    lambda b: extract.above_condensed(b.node.select("node", "parent"), b.event, b.leaf.where("node like '%9'"))[0]
)
_BLURRED = "(SELECT node, pos, par, CASE WHEN node LIKE '%5' THEN mut | CASE WHEN pos % 2 = 0 THEN par ELSE 8 END ELSE mut END AS mut FROM ev)"
on_bundle("tr31_clean_events", f"SELECT node, pos, par, CASE WHEN is_leaf THEN mut & -mut ELSE mut END AS mut FROM {_BLURRED} JOIN node USING (node) WHERE CASE WHEN is_leaf THEN par & mut = 0 ELSE par <> mut END")(
    lambda b: extract.clean_events(b.node, b.event.selectExpr("node", "pos", "par", "if(node like '%5', mut | if(pos % 2 = 0, par, 8), mut) mut"))
)
on_bundle("se17_within", "SELECT DISTINCT d.node FROM clo u JOIN clo d ON d.anc = u.anc WHERE u.node LIKE 'c%3' AND u.dist + d.dist <= 2")(lambda b: tree.within(b.closure, b.node.where("node like 'c%3'"), 2))
on_bundle("se18_share", "SELECT node FROM leaf WHERE node NOT LIKE '%1' AND substr(md5('1:' || node), 1, 8) < '40000000'")(lambda b: select.sampled(b.leaf.select("node"), 0.25, 1, b.leaf.where("node like '%1'")))
on_bundle("se19_informative", "SELECT DISTINCT pos FROM st WHERE pos % 5 <> 0")(lambda b: select.informative(b.state.select("pos", F.when(F.col("pos") % 5 == 0, 15).otherwise(F.col("mut")).alias("allele"))))
on_bundle("st4_union", "SELECT node FROM leaf WHERE node LIKE '%3' UNION SELECT node FROM st JOIN leaf USING (node) WHERE pos = 31 AND mut = 4")(lambda b: select.union(b.leaf.where("node like '%3'"), select.with_mutation(b, 31, 4)))
on_bundle("so6_first", "SELECT node FROM leaf ORDER BY dfs LIMIT 50")(lambda b: select.first(b.leaf, 50))
on_bundle("ag16_leaves", "SELECT node, parent, n_leaves AS leaves FROM node")(report.leaves_per_node)
on_bundle("ag17_per_sample", """, o AS (SELECT * FROM node WHERE NOT (is_leaf AND node LIKE '%3')), x AS (SELECT count(*) FILTER (is_leaf) AS samples_before, (SELECT count(*) FROM ev JOIN o USING (node)) AS parsimony_before FROM o), y AS (SELECT count(*) FILTER (is_leaf) AS samples_after, (SELECT count(*) FROM ev) AS parsimony_after FROM node)
SELECT *, round(parsimony_before / samples_before, 9) AS rate_before, round(parsimony_after / samples_after, 9) AS rate_after, round((parsimony_after - parsimony_before) / (samples_after - samples_before), 9) AS rate_added FROM x, y""")(
    lambda b: report.events_per_sample(Bundle(b.node.where("not (is_leaf and node like '%3')"), b.event.join(b.node.where("not (is_leaf and node like '%3')").select("node"), "node", "left_semi"), b.closure, b.state), b)
)
on_bundle("ag20_recurrent", "SELECT literal AS mutation, count(DISTINCT node) AS branches FROM lit GROUP BY literal HAVING count(DISTINCT node) >= 2")(report.recurrent)
on_bundle("wn3_running_totals", """, n AS (SELECT node AS anc, count(*) AS n FROM ev GROUP BY node)
SELECT c.node, c.anc, (sum(coalesce(n, 0)) OVER (PARTITION BY c.node ORDER BY dist DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM clo c JOIN leaf ON leaf.node = c.node LEFT JOIN n ON n.anc = c.anc""")(report.running_totals)
on_bundle("tr8_parsimony", "SELECT count(*) AS parsimony FROM ev")(lambda b: tree.parsimony_score(b.event))
on_bundle("fn14_distances", "SELECT a.node AS a, z.node AS z, min(a.dist + z.dist) AS distance FROM clo a JOIN clo z ON z.anc = a.anc AND z.node = 'n' || ((substr(a.node, 2)::INT * 7) % 25) WHERE a.node LIKE 'c%' GROUP BY 1, 2")(
    lambda b: tree.node_distances(b.node, b.closure, b.node.where("node like 'c%'").select(F.col("node").alias("a"), F.expr("concat('n', (cast(substr(node, 2) as int) * 7) % 25)").alias("z")))
)
on_bundle("fn5_reversed", f"SELECT node, pos, {LIT.format(p='mut', s='pos', m='par')} AS literal FROM ev WHERE par <> mut")(
    lambda b: b.event.where(nuc.is_valid(F.col("par"), F.col("mut"))).select("node", nuc.reversed_event(F.struct("pos", "par", "mut")).alias("r")).select("node", "r.pos", nuc.literal(F.col("r.par"), F.col("r.pos"), F.col("r.mut")).alias("literal"))
)
query("fn6_split", "SELECT doc_id, len(string_split(text, ',')) AS fields, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents WHERE text IS NOT NULL", base=False)(
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", F.size(nuc.split_chars(F.col("text"), ",")).cast("long").alias("fields"), F.size(nuc.split_words(F.col("text"))).cast("long").alias("words"))
)
on_bundle("fn16_filled", f"SELECT p.pos::INT AS pos, coalesce(substr('ACMGRSVTWYHKDBN', x.mut, 1), 'N') AS base FROM range({SITES}) p(pos) LEFT JOIN (SELECT pos, mut FROM st WHERE node = 'n5') x ON x.pos = p.pos")(
    lambda b: source.filled(b.state.where("node = 'n5'").select("pos", nuc.letter(F.col("mut")).alias("base")), 0, SITES - 1)
)
on_bundle("ma1_mask_sites", "SELECT node, CASE WHEN pos % 10 = 3 AND node LIKE 'o%' THEN -pos ELSE pos END AS pos, ref, par, mut FROM ev")(lambda b: extract.mask_sites(b.event, b.event.where("pos % 10 = 3").select("pos"), b.leaf.where("node like 'o%'")))
on_bundle("ma2_local_mask", """, miss AS (SELECT node AS sample, (dfs % 80)::INT AS start, (dfs % 80 + 10)::INT AS stop FROM leaf), pr AS (SELECT a.node AS a, z.node AS z FROM leaf a JOIN leaf z ON z.dfs = a.dfs + 1),
nr AS (SELECT a AS node, z AS sample FROM pr UNION SELECT z, a FROM pr), h AS (SELECT DISTINCT ev.node, ev.pos FROM ev JOIN nr USING (node) JOIN miss USING (sample) WHERE pos BETWEEN start AND stop)
SELECT ev.node, ev.pos, par, mut, h.pos IS NOT NULL AS masked FROM ev LEFT JOIN h ON h.node = ev.node AND h.pos = ev.pos""")(
    lambda b: extract.local_mask(
        b.event,
        b.closure,
        b.leaf.select(F.col("node").alias("a"), (F.col("dfs") + 1).alias("dfs")).join(b.leaf.select(F.col("node").alias("z"), "dfs"), "dfs").select("a", "z", F.lit(1).alias("distance")),
        b.leaf.selectExpr("node sample", "cast(dfs % 80 as int) start", "cast(dfs % 80 + 10 as int) stop"),
        2,
    ).select("node", "pos", "par", "mut", "masked")
)
on_bundle("fs5_reassign", "SELECT count(*) AS n, (SELECT count(*) FROM ev WHERE pos % 9 <> 0) AS kept FROM ev WHERE pos % 9 <> 0")(
    lambda b: assign.reassign(b.node, b.closure, b.event, b.event.where("pos % 9 = 0"), _leaf_sets(b)).where("pos % 9 <> 0").agg(F.count(F.lit(1)).alias("n")).withColumn("kept", F.col("n"))
)


# metadata
def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("o"), "o_orderkey").alias("strain"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


query("jo6_metadata", "SELECT leaf.node AS sample, status, priority FROM leaf LEFT JOIN (SELECT 'o' || o_orderkey AS strain, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0) m ON m.strain = leaf.node")(
    lambda spark, sf_dir: extract.with_metadata(bundle(spark, sf_dir).leaf.select(F.col("node").alias("sample")), _orders(spark, sf_dir).where("cast(substr(strain, 2) as long) % 3 <> 0"))
)
query("sc12_merged_metadata", """SELECT coalesce(a.strain, b.strain) AS strain, coalesce(b.status, a.status) AS status, a.priority, b.country FROM (SELECT 'o' || o_orderkey AS strain, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 3 <> 0) a
FULL JOIN (SELECT 'o' || o_orderkey AS strain, CASE WHEN o_orderkey % 4 <> 0 THEN 'late' END AS status, 'c' || o_custkey AS country FROM orders WHERE o_orderkey % 2 = 0) b ON a.strain = b.strain""", base=False)(
    lambda spark, sf_dir: extract.merge_metadata(
        _orders(spark, sf_dir).where("cast(substr(strain, 2) as long) % 3 <> 0"),
        spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 2 = 0").selectExpr("concat('o', o_orderkey) strain", "if(o_orderkey % 4 = 0, '', 'late') status", "concat('c', o_custkey) country"),
    )
)


# text round trips: written to the shared folder, read back
@query("sk7_report", "SELECT 'o' || o_orderkey AS strain, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey % 2 = 0", base=False)
def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SK-7, SC-11."""
    path = new_path(spark, "report") + ".tsv"
    rows = _orders(spark, sf_dir)
    sink.write_report(rows, path, "strain")
    return source.restricted(source.read_metadata(spark, path), rows.where("cast(substr(strain, 2) as long) % 2 = 0").select(F.col("strain").alias("sample")))


def _genotypes(b: Bundle) -> DataFrame:
    """Every leaf at every site, as a VCF has it; leaves of a name ending in 9 are unknown at sites ending in 7."""
    sites = b.event.select("pos", "ref").distinct()
    grid = b.leaf.select("node", "dfs").crossJoin(F.broadcast(sites))  # at most 97 sites
    rows = grid.join(b.state.select("node", "pos", "mut"), ["node", "pos"], "left")
    unknown = F.col("node").like("%9") & (F.col("pos") % 10 == 7)
    return rows.select(F.col("node").alias("sample"), F.col("dfs").alias("ord"), "pos", "ref", F.when(unknown, 15).otherwise(F.coalesce("mut", "ref")).alias("allele"))


def _site_refs(b: Bundle) -> dict[int, int]:
    return {r["pos"]: r["ref"] for r in b.event.select("pos", "ref").distinct().collect()}  # at most 97 sites


def _leaf_calls(b: Bundle) -> DataFrame:
    """(node, dfs, calls) of every leaf: its alleles other than the reference."""
    held = b.state.where("mut <> ref").groupBy("node").agg(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), F.col("mut").cast("int").alias("allele"))).alias("calls"))
    return b.leaf.select("node", "dfs").join(held, "node", "left").withColumn("calls", F.coalesce("calls", F.array().cast("array<struct<pos:int,allele:int>>")))


@on_bundle("sk1_vcf", "SELECT 'new_' || node AS sample, pos, CASE WHEN node LIKE '%9' AND pos % 10 = 7 THEN 15 ELSE mut END AS allele FROM (SELECT leaf.node, site.pos, coalesce(st.mut, site.ref) AS mut, site.ref FROM leaf CROSS JOIN (SELECT DISTINCT pos, ref FROM ev) site LEFT JOIN st ON st.node = leaf.node AND st.pos = site.pos) WHERE (mut <> ref OR (node LIKE '%9' AND pos % 10 = 7)) AND node NOT LIKE '%2' AND pos IN (SELECT pos FROM st JOIN leaf USING (node) WHERE mut <> ref AND NOT (node LIKE '%9' AND pos % 10 = 7))")
def _vcf(b: Bundle) -> DataFrame:
    """SK-1, SC-1, SC-2: known samples skipped, names prefixed."""
    spark = b.node.sparkSession
    path = new_path(spark, "vcf")
    sites = _site_refs(b)
    unknown = F.array(*(F.struct(F.lit(p).alias("pos"), F.lit(15).alias("allele")) for p in sorted(sites) if p % 10 == 7)).cast("array<struct<pos:int,allele:int>>")
    calls = F.when(F.col("node").like("%9"), F.concat(F.filter("calls", lambda x: x["pos"] % 10 != 7), unknown)).otherwise(F.col("calls"))
    columns.write_vcf(_leaf_calls(b).select(F.col("node").alias("sample"), F.col("dfs").alias("ord"), calls.alias("calls")), sites, path, compressed=True)
    return source.read_vcf(spark, path, changes_only=True, skip=b.leaf.where("node like '%2'").select(F.col("node").alias("sample")), prefix="new_")[1].select("sample", "pos", "allele")


@on_bundle("sc3_unclear", "SELECT leaf.node AS sample, count(*) FILTER (node LIKE '%9' AND pos % 10 = 7) AS unclear FROM leaf CROSS JOIN (SELECT DISTINCT pos FROM ev) site GROUP BY 1")
def _unclear_counts(b: Bundle) -> DataFrame:
    return source.unclear_calls(_genotypes(b))


@on_bundle("sk2_diff", "SELECT node AS sample, pos AS start, pos AS stop, mut AS allele FROM st JOIN leaf USING (node) WHERE mut <> ref")
def _diff(b: Bundle) -> DataFrame:
    """SK-2, SC-7."""
    spark = b.node.sparkSession
    path = new_path(spark, "diff")
    rows = b.state.where("mut <> ref").join(b.leaf.select("node"), "node", "left_semi").select("node", "pos", "mut")
    sink.diff_lines(rows).select("value").write.text(path)
    return source.read_diff(spark, path)


@on_bundle("sk4_newick", ", n AS (SELECT node, count(*) AS n FROM ev GROUP BY node) SELECT leaf.node, level, coalesce(n, 0)::DOUBLE AS branch_length FROM leaf LEFT JOIN n USING (node)")
def _newick(b: Bundle) -> DataFrame:
    """SK-4, SC-6: branch lengths are event counts; inner nodes come back under new names, so leaves and levels are compared."""
    spark = b.node.sparkSession
    path = new_path(spark, "newick")
    rows = tree.rotate(b.node).join(select.event_counts(b).select("node", "level", "n"), "node").select("node", "parent", "level", "child_ord", "n")
    top = select.event_counts(b).where("parent is null").select("node", "parent", "level", F.lit(1).alias("child_ord"), "n")
    sink.newick(rows.union(top), "n").write.text(path)
    return source.levelled(source.read_newick(spark, path)).where("is_leaf").select("node", "level", "branch_length")


@on_bundle("fn15_normalized", """, g AS (SELECT leaf.node AS sample, site.pos, substr('ACMGRSVTWYHKDBN', coalesce(st.mut, site.ref), 1) AS c, site.ref, coalesce(st.mut, site.ref) AS mut FROM leaf CROSS JOIN (SELECT DISTINCT pos, ref FROM ev) site LEFT JOIN st ON st.node = leaf.node AND st.pos = site.pos)
SELECT pos, string_agg(DISTINCT c, ',' ORDER BY c) FILTER (mut <> ref) AS alts, md5(string_agg(sample || '=' || c, ',' ORDER BY sample)) AS calls FROM g GROUP BY pos HAVING count(*) FILTER (mut <> ref) > 0""")
def _normalized(b: Bundle) -> DataFrame:
    return columns.digests(_leaf_calls(b).select(F.col("node").alias("sample"), "calls"), _site_refs(b))


_BY_TARGET = ", t AS (SELECT node AS target FROM leaf WHERE regexp_full_match(node, 'o1[0-9]*') ORDER BY dfs LIMIT 3)"


@on_bundle("sk10_subtrees", f"{_BY_TARGET} SELECT target AS subtree, target AS node, 10 AS leaves FROM t")
def _subtrees(b: Bundle) -> DataFrame:
    """TR-28, SK-10: the subtrees of three samples are written; each one's newick text is read back and has ten leaves, the sample among them."""
    spark = b.node.sparkSession
    path = new_path(spark, "subtrees")
    targets = select.first(select.by_name(b, "o1[0-9]*").join(b.node, "node"), 3).select(F.col("node").alias("target"))
    members = materialize(extract.subtree_members(b, targets, 10), "members")
    sink.write_subtrees(b.event, members, sink.newick_each(extract.induced_each(b, members)), path)
    assigned = source.read_metadata(spark, f"{path}/assignments").where("node = subtree").select("subtree", "node")
    leaves = F.size(F.filter(F.split("value", r"[(),;]"), lambda x: x != "")).alias("leaves")
    return assigned.join(spark.read.text(f"{path}/trees").where("value <> ''").select("subtree", leaves), "subtree")


# recombinant trios
_THREE = "SELECT DISTINCT 'o' || l_orderkey AS recomb, 'c' || (l_suppkey * 13 % 150 + 1) AS donor, 'n' || (l_linenumber * 3) AS acceptor FROM lineitem"


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("concat('o', l_orderkey) recomb", "concat('c', l_suppkey * 13 % 150 + 1) donor", "concat('n', l_linenumber * 3) acceptor", "l_discount p")


query("jo9_trios", f""", t AS ({_THREE}), x AS (SELECT 'o' || l_orderkey AS recomb, 'c' || (l_suppkey * 13 % 150 + 1) AS donor, 'n' || (l_linenumber * 3) AS acceptor, min(l_discount) AS p FROM lineitem WHERE l_discount > 0.02 GROUP BY 1, 2, 3),
u AS (SELECT a.node, a.parent, b.parent AS grandparent, a.n_leaves FROM node a LEFT JOIN node b ON b.node = a.parent)
SELECT t.*, r.parent AS recomb_parent, r.grandparent AS recomb_grandparent, r.n_leaves AS recomb_n_leaves, d.parent AS donor_parent, d.grandparent AS donor_grandparent, d.n_leaves AS donor_n_leaves, a.parent AS acceptor_parent, a.grandparent AS acceptor_grandparent, a.n_leaves AS acceptor_n_leaves, x.p
FROM t LEFT JOIN u r ON r.node = t.recomb LEFT JOIN u d ON d.node = t.donor LEFT JOIN u a ON a.node = t.acceptor LEFT JOIN x ON x.recomb = t.recomb AND x.donor = t.donor AND x.acceptor = t.acceptor""")(
    lambda spark, sf_dir: trios.enriched(_three(spark, sf_dir).drop("p").distinct(), bundle(spark, sf_dir).node, _three(spark, sf_dir).where("p > 0.02"))
)
query("rc11_alignment", """WITH s AS (SELECT DISTINCT l_orderkey AS trio, (l_partkey % 300)::INT AS pos FROM lineitem), g AS (SELECT l_orderkey AS trio, (l_suppkey * 7 % 300)::INT AS start, (l_suppkey * 7 % 300 + 4)::INT AS stop FROM lineitem WHERE l_linenumber = 1),
h AS (SELECT s.trio, pos, max(CASE WHEN pos BETWEEN start AND stop THEN 1 ELSE 0 END) AS inside FROM s JOIN g ON g.trio = s.trio AND pos BETWEEN start - 5 AND stop + 5 GROUP BY 1, 2), k AS (SELECT trio, sum(inside)::BIGINT AS on_gap, count(*) AS near_gap FROM h GROUP BY trio),
w AS (SELECT trio, pos, count(*) OVER (PARTITION BY trio ORDER BY pos RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n, min(pos) OVER (PARTITION BY trio) AS lo, max(pos) OVER (PARTITION BY trio) AS hi FROM s),
c AS (SELECT trio, count(*) AS n_sites, max(n) AS clump, count(*) FILTER (pos <= (lo + hi) / 2) AS l FROM w GROUP BY trio)
SELECT c.trio, n_sites, clump, coalesce(on_gap, 0) AS on_gap, coalesce(near_gap, 0) AS near_gap, greatest(l, n_sites - l) / n_sites AS skew, coalesce(on_gap, 0) > 0 OR coalesce(near_gap, 0) >= 6 OR clump >= 6 AS suspect FROM c LEFT JOIN k ON k.trio = c.trio""", base=False)(
    lambda spark, sf_dir: trios.alignment_flags(
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey trio", "cast(l_partkey % 300 as int) pos").distinct(),
        spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_linenumber = 1").selectExpr("l_orderkey trio", "cast(l_suppkey * 7 % 300 as int) start", "cast(l_suppkey * 7 % 300 + 4 as int) stop"),
    )
)
on_bundle("rc18_dealt", ", x AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS i, count(*) OVER () AS n FROM node WHERE NOT is_leaf) SELECT node, (i * 7 // n)::INT AS machine FROM x")(lambda b: trios.dealt(b.node.where("not is_leaf"), 7))

# the task library's algorithms
_table = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
query("tf2_for_each", "SELECT i::BIGINT AS i, i * i AS square FROM range(0, 1000, 7) t(i)", base=False)(lambda spark, sf_dir: spark.range(0, 1000, 7).select(F.col("id").alias("i"), (F.col("id") * F.col("id")).alias("square")))
query("tf5_sort", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS place FROM lineitem", base=False)(
    lambda spark, sf_dir: tree.ordered_index(_table(spark, sf_dir, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "place").drop("l_extendedprice")
)
query("tf7_pipeline", "SELECT l_returnflag, count(*) AS n, sum((l_quantity * 2 + 1)::BIGINT)::BIGINT AS total FROM lineitem WHERE l_quantity * 2 > 20 GROUP BY 1", base=False)(
    lambda spark, sf_dir: _table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity") * 2).where("q > 20").withColumn("q", F.col("q") + 1).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("q").cast("long")).alias("total"))
)
query("tf8_partitions", "SELECT l_suppkey % 16 AS part, count(*) AS n FROM lineitem GROUP BY 1", base=False)(
    lambda spark, sf_dir: _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 16).alias("part")).repartition("part").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
)
