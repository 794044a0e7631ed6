"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

Every source has a weight (5, 2, 1 repeating over the sources in code point order, null last) and
a share of the whole word count in proportion to it, but at most ``MAX_REPEAT`` times its own size;
what is cut off is reshared by weight among the rest (water filling). A source's target is then
turned into equal blocks of words by highest quotients ``target / (2 * blocks so far + 1)`` among
all sources, and a source's blocks go to its shards by the same rule on shard sizes, which gives each
shard an integer quota. A block has ``BLOCK`` words, or fewer (the same for all sources) if the
smallest target above 0 would not fill ``MIN_BLOCKS`` of them, so that no small source is rounded away.

Block selection: inside a shard, documents stand in a seeded order on a tape of words cut into
blocks. The quota takes every block once per full pass; its rest takes the first blocks of the tape.
The seed thus chooses by its order of documents, not by a rank of blocks of its own: a run of
blocks cuts one document per shard, scattered blocks would cut most of them to fragments. No shard
(hence no document) is passed more than ``MAX_REPEAT`` times.

Shards are cut by hash, about ``SHARD_DOCS`` documents each and at most ``MAX_SHARDS`` a source, so a
source with a third of all rows is spread like any other. Only the table of sources is ordered as a
whole; windows span the narrow rows (no texts) of a shard or the shards of a source. Texts are never
shuffled: they meet the table of shards, which holds for each the full passes and the key where the
rest of its quota ends.

Nulls: a null text has size 0 and takes 0; a null source is a source of its own, last in order; rows
with null or repeated doc_id are mixed as rows of their own, and get positions by id and text. An
empty table gives an empty table. Sources without a word have target 0. Extra columns are kept, whatever
their names; a very long text is cut like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import given, materialize, release, set_aside

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BLOCK, MIN_BLOCKS = 32, 16
SEED = 1
#: Tables of sources or shards of at most so many rows (well under 10 MB) are broadcast.
BROADCAST_ROWS = 50_000
SHARD_DOCS, MAX_SHARDS = 1024, 4096
WORD = r"[^\x20\x09-\x0D]+"


def with_size(docs: DataFrame) -> DataFrame:
    """Adds size, the seeded order key (``_key``) and a tie-break for repeated ids (``_tie``)."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return docs.withColumns({"size": size, "_key": F.md5(F.concat(F.lit(f"{SEED}:"), name).cast("binary")), "_tie": F.xxhash64("text")})


def source_targets(sized: DataFrame) -> DataFrame:
    """``sized(source, size)`` -> one row per source: source, source_size, n_docs, target.

    Water filling in closed form: with sources in rising order of cap / weight, those whose cap is at
    most the level that the remaining sources would reach are cut, the rest share the remainder.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(MAX_REPEAT))).withColumn("level", F.col("cap") / F.col("weight"))
    rising = W.orderBy("level", F.col("source").asc_nulls_last())
    before = rising.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    filled = capped.withColumns(
        {
            "at": F.row_number().over(rising),
            "cut": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "total": F.sum("source_size").over(everything).cast("double"),
        }
    ).withColumn("reach", (F.col("total") - F.col("cut")) / F.col("open"))
    # the first source in rising order that is not cut fixes the common level of all later ones
    common = F.min(F.when(F.col("level") > F.col("reach"), F.struct("at", "reach"))).over(everything)["reach"]
    target = F.when(common.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * common))
    return filled.select("source", "source_size", "n_docs", target.alias("target"))


def sainte_lague(parts: DataFrame, group: list[str], weight: str, seats: str, tie: Column, out: str) -> DataFrame:
    """Adds ``out``: how many of the group's ``seats`` go to each row by highest quotients.

    The highest-quotient rule gives ``weight / (2a + 1)`` for a = 0, 1, ... Without enumerating
    seats: rounding every exact share s is the rule's answer for the rounded sum of seats; from there
    next quotients are added highest first, or last ones removed lowest first. With n rows and S seats
    the common divisor differs from 1 by at most a share of n / 2S, so a row moves by at most
    s * n / 2S + 1 seats; so many of its quotients are tried, under 3n in all, and none is missed.
    Ties go to the first row by ``tie``.
    """
    of = W.partitionBy(*group)
    total, share = F.sum(weight).over(of), F.coalesce(F.col("_share"), F.lit(0.0))
    base = parts.withColumn("_share", F.col(weight) / F.when(total > 0, total) * F.col(seats))
    base = base.withColumns({"_a": F.round(share).cast("long"), "_t": F.row_number().over(of.orderBy(tie)), "_n": F.count(F.lit(1)).over(of)})
    base = base.withColumn("_d", (F.col(seats) - F.sum("_a").over(of)).cast("long"))
    tries = F.ceil(share * F.col("_n") / F.greatest(2 * F.col(seats), F.lit(1))) + 1
    step = F.when(F.col("_d") >= 0, F.col("_a") + F.col("_j")).otherwise(F.col("_a") - 1 - F.col("_j"))
    quotient = F.col(weight) / (2 * step + 1)
    tried = base.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), tries))).where("_d <> 0")
    tried = tried.withColumn("_q", F.when(step >= 0, F.when(F.col("_d") >= 0, -quotient).otherwise(quotient)).otherwise(F.lit(float("inf"))))
    order = of.orderBy("_q", F.when(F.col("_d") >= 0, F.col("_t")).otherwise(-F.col("_t")), "_j")
    picked = tried.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.abs("_d"))
    moved = picked.groupBy(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(group)), F.col("_t").alias("_u")).agg(F.count(F.lit(1)).alias("_m"))
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)] + [F.col("_t") == F.col("_u")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    joined = base.join(moved, condition, "left")
    return joined.withColumn(out, F.col("_a") + F.signum("_d").cast("long") * F.coalesce("_m", F.lit(0))).select(*parts.columns, out)


def plan(spark: SparkSession, sized: DataFrame, block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> tuple[DataFrame, DataFrame]:
    """(sources, shards): targets of each source; quota and words of each (source, shard)."""
    targets = materialize(spark, source_targets(sized), "mix-targets")
    least = targets.where("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(block, int((least or 0) / MIN_BLOCKS)))
    total = targets.withColumn("_seats", F.round(F.sum("target").over(W.partitionBy()) / block).cast("long"))
    n_shards = F.least(F.ceil(F.col("n_docs") / shard_docs), F.lit(MAX_SHARDS))
    sources = sainte_lague(total, [], "target", "_seats", F.col("source").asc_nulls_last(), "quota").drop("_seats").withColumn("n_shards", n_shards)
    sources = materialize(spark, sources, "mix-sources")
    shards = in_shards(sized, sources).groupBy("source", "_shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("_seats"))
    quotas = sainte_lague(materialize(spark, shards, "mix-sizes"), ["source"], "shard_size", "_seats", F.col("_shard"), "quota")
    words = F.least(F.col("quota") * block, F.col("shard_size") * MAX_REPEAT).cast("long")
    release(spark, targets)
    return sources, materialize(spark, quotas.select("source", "_shard", "shard_size", "quota", words.alias("words")), "mix-shards")


def small(table: DataFrame) -> DataFrame:
    """The table, with a broadcast hint if its counted rows are few; else the planner shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def in_shards(sized: DataFrame, sources: DataFrame) -> DataFrame:
    named = sources.withColumnRenamed("source", "_s")
    joined = sized.join(small(named.drop("n_docs")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return joined.withColumn("_shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("n_shards"))


def _with_shards(rows: DataFrame, shards: DataFrame) -> DataFrame:
    named = small(shards.withColumnsRenamed({"source": "_s", "_shard": "_t"}))
    return rows.join(named, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_shard") == F.col("_t"))).drop("_s", "_t")


def _on_tape(sized: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds the shard, where the row ends on its tape (``_end``), full passes and rest of the shard's quota."""
    placed = in_shards(sized, sources.drop("quota"))
    tape = W.partitionBy("source", "_shard").orderBy("_key", "size", "_tie").rowsBetween(W.unboundedPreceding, 0)
    at = _with_shards(placed.withColumn("_end", F.sum("size").over(tape)), shards.select("source", "_shard", "words", "shard_size"))
    at = at.withColumn("_passes", F.expr("words div greatest(shard_size, 1)"))
    return at.withColumn("_rest", F.col("words") - F.col("_passes") * F.col("shard_size")).drop("words", "shard_size", "n_shards")


def take(sized: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """Adds source_size, target and taken (words the mix takes of the row, repeats counted)."""
    at = _on_tape(sized, sources, shards)
    part = F.greatest(F.lit(0), F.least("_end", "_rest") - (F.col("_end") - F.col("size")))
    return at.withColumn("taken", (F.col("_passes") * F.col("size") + part).cast("long")).drop("_end", "_shard", "_passes", "_rest")


def cuts(spark: SparkSession, sized: DataFrame, sources: DataFrame, shards: DataFrame) -> DataFrame:
    """One row per shard: source, _shard, full passes, the tape key ``_stop`` where the rest of the quota
    ends, how many of the ``_alike`` rows with that key are whole, and the words taken of the next one."""
    at = _on_tape(sized, sources, shards)
    key = F.struct("_key", "size", "_tie")
    held = at.withColumn("_stop", F.min(F.when((F.col("_end") >= F.col("_rest")) & (F.col("_rest") > 0), key)).over(W.partitionBy("source", "_shard")))
    alike = key == F.col("_stop")
    first = F.min(F.when(alike, F.col("_end") - F.col("size")))
    out = held.groupBy("source", "_shard").agg(F.first("_passes").alias("_passes"), F.first("_stop").alias("_stop"), F.count(F.when(alike, 1)).alias("_alike"), (F.first("_rest") - first).alias("_in"))
    whole = F.expr("_in div greatest(_stop.size, 1)")
    out = out.withColumn("_whole", F.coalesce(whole, F.lit(0))).withColumn("_part", F.coalesce(F.col("_in") - F.col("_whole") * F.col("_stop.size"), F.lit(0)))
    return materialize(spark, out.drop("_in"), "mix-cuts")


def mixed_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The mix as rows with the columns of ``docs``: whole copies, then a cut copy of the rest.

    A cut copy holds the first words of the text up to where the taken words end. ``n_chars`` is set
    again where the column exists. Only rows that repeat the key at which a shard's quota ends are ranked.
    """
    table, names = set_aside(docs, "doc_id", "text", "source", "n_chars")
    sized = with_size(table)
    narrow = materialize(spark, sized.select("source", "size", "_key", "_tie"), "mix-sizes")
    sources, shards = plan(spark, narrow)
    ends = cuts(spark, narrow, sources, shards)
    release(spark, narrow, shards)
    rows = _with_shards(in_shards(sized, sources.select("source", "n_shards", "n_docs")), ends)
    key = F.struct("_key", "size", "_tie")
    at_stop = F.coalesce(key == F.col("_stop"), F.lit(False))
    extra = F.when(F.coalesce(key < F.col("_stop"), F.lit(False)), F.col("size")).otherwise(F.lit(0))
    here = F.when(F.col("_r") <= F.col("_whole"), F.col("size")).when(F.col("_r") == F.col("_whole") + 1, F.col("_part")).otherwise(F.lit(0))
    one = rows.where(~at_stop | (F.col("_alike") <= 1)).withColumn("_r", F.lit(1)).withColumn("_extra", F.when(at_stop, here).otherwise(extra))
    taken = one
    if ends.where("_alike > 1").take(1):  # rows alike in id, size and text
        many = rows.where(at_stop & (F.col("_alike") > 1)).withColumn("_r", F.row_number().over(W.partitionBy("source", "_shard").orderBy(F.to_json(F.struct(*table.columns)))))
        taken = one.unionByName(many.withColumn("_extra", here))
    # at most one row per shard is cut; a word is followed by white space or the end
    words = F.regexp_extract_all("text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    cut = F.array_join(F.slice(words, 1, F.col("_extra").cast("int")), "")
    copies = F.array_repeat(F.lit(0).cast("long"), F.when(F.col("size") > 0, F.col("_passes") + (F.col("_extra") >= F.col("size")).cast("long")).otherwise(0).cast("int"))
    rest = F.when((F.col("_extra") > 0) & (F.col("_extra") < F.col("size")), F.array(F.col("_extra").cast("long"))).otherwise(F.array().cast("array<bigint>"))
    out = taken.withColumn("_cut", F.explode(F.concat(copies, rest)))
    out = out.withColumn("text", F.when(F.col("_cut") == 0, F.col("text")).otherwise(cut))
    if "n_chars" in table.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut") == 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return given(out, names, docs.columns)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    narrow = materialize(spark, with_size(docs).drop("text"), "mix-sizes")
    return take(narrow, *plan(spark, narrow)).select("doc_id", "size", "source_size", "target", "taken")
