"""N-gram Jaccard join: grouped prefix join over sets of five-word shingles.

Words are the runs of bytes other than space and tab to carriage return, A-Z lower-cased. A
document's set holds its distinct five-word shingles (63-bit hashes); with fewer words the whole
sequence is one shingle; with none the set is empty and links with nothing. Two documents link when
100 * intersection >= 80 * union.

1. Global order: shingles that many documents share come last (a bounded list of the most frequent
   ones, counted over all documents), all others stand in hash order. The join is exact under any
   order; this one keeps shared passages out of the prefixes.
2. Documents with equal sets become one class. Documents with identical prefix and set size become
   one group, and only groups enter the index: a row per prefix shingle.
3. Group pairs that share a prefix shingle are filtered by size and by position. They are not all
   listed: in each shingle's list, groups of like size are paired with one pivot, so a list of n
   groups gives n - 1 pairs. Members are expanded (each with its group's name), pairs are verified on
   whole sets, and links are joined into components.
4. A list whose members all lie in one component is done. In the others, pairs of members from
   different components are verified too, so no link between components is lost: short lists by
   pairs that pass the filters, long ones in blocks that return a spanning forest and never pairs.
   (A link inside a component changes nothing in the result.)

Postings travel packed, and lists of one member end where they meet. The number of their buckets follows the
number of postings, and the list of a shingle with more than ``HOT_LIST`` occurrences is dealt to several buckets,
each with a pivot of its own (step 4 takes the list as a whole again). Joins are such that a hot key is
split. Sets are built again only for documents in candidate pairs, found by a Bloom filter sized by their number
(up to a bound; beyond it more sets pass than needed) ahead of the exact join.

A null text is empty. A null doc_id links with nothing and has a null component. Rows that repeat a
doc_id are one node: they share the component, each row has its own n_shingles. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.common import U64, Forest, WordHash, connected_components, given, lean, materialize, mix64, release, set_aside, shuffle_partitions, utf8_rows

WIDTH, PERCENT = 5, 80
HEAVY_MAX, HEAVY_MIN, HEAVY_LOCAL, HEAVY_CHUNK = 200_000, 16, 2, 1_000_000
#: Bits of the candidate filter: BLOOM_SHARE for each id, within bounds (16 kB to 128 MB).
BLOOM_SHARE, BLOOM_LEAST, BLOOM_MOST = 16, 1 << 17, 1 << 30
WORDS_HELD = 200_000
#: Postings of a bucket, and occurrences of a shingle from which its list is dealt to several buckets.
BUCKET_ENTRIES, HOT_LIST = 2_000_000, 200_000
#: Lists of at most SHORT_LIST members are paired by a join; longer ones in cells of two blocks of so many
#: sketches, or of so many sets and their shingles.
SHORT_LIST, SKETCH_BLOCK, SET_BLOCK, SET_WORDS, CELL_WORDS, LIKELY = 16, 256, 256, 300_000, 8192, 0.3
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5], dtype=U64)


def shingles(text: bytes, cache: WordHash, distinct: bool = True) -> np.ndarray:
    """Sorted distinct shingle hashes (uint64, top bit clear) of a whole text; else all, in text order."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, U64)
    v = cache.array(words)
    w = min(WIDTH, len(v))
    n = len(v) - w + 1
    h = v[:n] * FACTORS[0]
    for i in range(1, w):
        h += v[i : n + i] * FACTORS[i]
    h = mix64(h + U64(w)) >> U64(1)
    return np.unique(h) if distinct else h


def prefix_length(n: int) -> int:
    """Two sets that link share a shingle among the first so many of each."""
    return n - -(-PERCENT * n // 100) + 1 if n else 0


def _heavy_counts(frames):
    cache, held, size = WordHash(limit=WORDS_HELD), [], 0

    def flush():
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        many = n >= HEAVY_LOCAL
        return pa.RecordBatch.from_arrays([pa.array(keys[many].astype(np.int64)), pa.array(n[many])], names=["shingle", "n"])

    for frame in frames:
        for text in utf8_rows(frame.column("text")):
            s = shingles(text, cache, distinct=False)
            if len(s):
                held.append(s)
                size += len(s)
            if size >= HEAVY_CHUNK:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def heavy_shingles(texts: DataFrame) -> np.ndarray:
    """At most HEAVY_MAX shingles found most often (uint64, sorted), their places in the order, and into how many buckets their lists go."""
    counts = texts.mapInArrow(lean(_heavy_counts), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= HEAVY_MIN).orderBy(F.col("n").desc(), "shingle").limit(HEAVY_MAX).toPandas()
    keys = top["shingle"].to_numpy(dtype=np.int64).astype(U64)
    rank = np.arange(len(keys), 0, -1)  # the most frequent last
    order = np.argsort(keys)
    split = -(-top["n"].to_numpy(dtype=np.int64) // HOT_LIST)
    return np.stack([keys[order], rank[order].astype(U64), split[order].astype(U64)]) if len(keys) else np.zeros((3, 0), U64)


def ordered_prefix(s: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set under the global order."""
    n = prefix_length(len(s))
    if heavy.shape[1] and len(s):
        at = np.minimum(np.searchsorted(heavy[0], s), heavy.shape[1] - 1)
        hot = heavy[0][at] == s
        if hot.any():
            late = s[hot][np.argsort(heavy[1][at[hot]], kind="stable")]
            return np.concatenate([s[~hot], late])[:n]
    return s[:n]


SUMMARY = "doc_id long, n_shingles long, s1 long, s2 long, p1 long, p2 long, prefix binary, sketch binary"


def _digest(a: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128(a.tobytes()).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketch(s: np.ndarray) -> bytes:
    """How many shingles fall into each of 256 ranges of hashes; empty if a range holds over 255."""
    n = np.bincount((s >> U64(55)).astype(np.int64), minlength=256)
    return n.astype(np.uint8).tobytes() if len(n) == 256 and n.max(initial=0) < 256 else b""


def summaries(docs: DataFrame, heavy) -> DataFrame:
    """Per row: size of the set, a 128-bit digest of it, one of (prefix, size), and the prefix in order."""

    def run(frames):
        cache = WordHash(limit=WORDS_HELD)
        for frame in frames:
            rows = []
            for text in utf8_rows(frame.column("text")):
                s = shingles(text, cache)
                prefix = ordered_prefix(s, heavy.value)
                rows.append((len(s), *_digest(s), *_digest(np.append(prefix, U64(len(s)))), prefix.tobytes(), sketch(s)))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.binary()] * 2
            yield pa.RecordBatch.from_arrays([frame.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_shingles", "s1", "s2", "p1", "p2", "prefix", "sketch"])

    return docs.mapInArrow(lean(run), SUMMARY)


def _passes(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Size and position filter of sets of n and m shingles that share places at and bt of their prefixes."""
    low, high = np.minimum(n, m), np.maximum(n, m)
    need = -(-PERCENT * (n + m) // (100 + PERCENT))
    return (100 * low >= PERCENT * high) & (np.minimum(n - at, m - bt) + np.minimum(at, bt) >= need)


_ENTRY = np.dtype([("token", "<u4"), ("home", "<u4"), ("at", "<u4"), ("n", "<u4"), ("g", "<i8")])
_MANY = _SPLIT = np.uint32(1 << 31)


def postings(heads: DataFrame, parts: int, heavy) -> DataFrame:
    """``heads(g, n, members, prefix)`` -> packed postings (bucket, blob), a blob per task chunk and bucket.

    A posting is 32 bits of the shingle inside its bucket (two shingles that fall together only add
    candidates), the bucket of its list (top bit: the list is dealt to several from there on), the place in the
    prefix (top bit: the group has several members), size and group.
    """

    def pack(held):
        lengths = np.array([len(p) // 8 for *_, p in held])
        out = np.zeros(int(lengths.sum()), _ENTRY)
        s = np.frombuffer(b"".join(p for *_, p in held), dtype=U64)
        rep = lambda i: np.repeat(np.array([h[i] for h in held], dtype=np.int64), lengths)
        start = np.cumsum(lengths) - lengths
        out["at"] = np.arange(len(out)) - np.repeat(start, lengths)
        out["at"][rep(2) > 1] |= _MANY
        out["g"], out["n"] = rep(0), rep(1)
        mixed = mix64(s + U64(0x1234567))
        out["token"] = (mixed & U64(0xFFFFFFFF)).astype(np.uint32)
        bucket = ((mixed >> U64(32)) % U64(parts)).astype(np.int64)
        out["home"] = bucket
        hot = heavy.value[:, heavy.value[2] > 1]
        if hot.shape[1]:
            at = np.minimum(np.searchsorted(hot[0], s), hot.shape[1] - 1)
            split = np.flatnonzero(hot[0][at] == s)
            out["home"][split] |= _SPLIT
            bucket[split] = (bucket[split] + (mix64(out["g"][split].view(U64)) % hot[2][at[split]]).astype(np.int64)) % parts
        order = np.lexsort((out["token"], bucket))
        out, bucket = out[order], bucket[order]
        cuts = np.searchsorted(bucket, np.arange(parts + 1))
        squeeze = zstandard.ZstdCompressor(level=1)
        ids = [b for b in range(parts) if cuts[b + 1] > cuts[b]]
        blobs = [squeeze.compress(np.ascontiguousarray(out[cuts[b] : cuts[b + 1]].view(np.uint8).reshape(-1, _ENTRY.itemsize).T).tobytes()) for b in ids]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(frames):
        held, size = [], 0
        for frame in frames:
            for row in zip(*(frame.column(c).to_pylist() for c in ("g", "n", "members", "prefix"))):
                held.append(row)
                size += len(row[3])
                if size >= 6 << 20:
                    yield pack(held)
                    held, size = [], 0
        if held:
            yield pack(held)

    return heads.select("g", "n", "members", "prefix").mapInArrow(lean(run), "bucket int, blob binary")


LISTS = "shingle long, g long, n long, at int, pg long, pn long, pat int"


def _lists(frames):
    """All postings of one bucket -> lists of two or more members, each row with its list's pivot.

    A list is cut into bands of sizes; a band's pivot is its group of the lowest hash, and a pivot
    looks to the pivot of the band below. Pivots are the same wherever the same groups meet.
    """
    open_ = zstandard.ZstdDecompressor()
    held = []
    for frame in frames:
        for blob in frame.column("blob").to_pylist():
            held.append(np.ascontiguousarray(np.frombuffer(open_.decompress(blob), np.uint8).reshape(_ENTRY.itemsize, -1).T).reshape(-1).view(_ENTRY))
    if not held:
        return
    e = np.concatenate(held)
    del held
    e = e[np.lexsort((e["home"], e["token"]))]
    new = np.append(True, (e["token"][1:] != e["token"][:-1]) | (e["home"][1:] != e["home"][:-1]))
    run = np.cumsum(new) - 1
    many = np.bincount(run, weights=(e["at"] & _MANY != 0) | (e["home"] & _SPLIT != 0)) > 0
    keep = (np.bincount(run)[run] > 1) | many[run]
    e = e[keep]
    if not len(e):
        return
    token = (e["home"] & ~_SPLIT).astype(np.int64) << 32 | e["token"].astype(np.int64)
    g, n, at = e["g"].copy(), e["n"].astype(np.int64), (e["at"] & ~_MANY).astype(np.int64)
    band = np.floor(np.log(n) / np.log(1.25)).astype(np.int64)
    order = np.lexsort((mix64(g.view(U64)), band, token))
    token, g, n, at, band = token[order], g[order], n[order], at[order], band[order]
    first = np.append(True, (token[1:] != token[:-1]) | (band[1:] != band[:-1]))
    starts = np.flatnonzero(first)
    below = np.append(0, starts[:-1])
    below[np.append(True, token[starts[1:]] != token[starts[:-1]])] = -1
    below = np.where(below < 0, starts, below)
    pivot = np.repeat(starts, np.diff(np.append(starts, len(g))))
    pivot[starts] = below
    for i in range(0, len(g), 100_000):
        k = slice(i, i + 100_000)
        q = pivot[k]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (token[k], g[k], n[k], at[k].astype(np.int32), g[q], n[q], at[q].astype(np.int32))], names=["shingle", "g", "n", "at", "pg", "pn", "pat"])


BLOOM_PART = 1 << 13  # bytes of the filter that travel together


def _places(ids: np.ndarray, bits: int):
    for salt in (1, 2):
        at = mix64(ids.view(U64) + U64(salt << 40)) & U64(bits - 1)
        yield (at >> U64(3)).astype(np.int64), np.left_shift(np.uint8(1), (at & U64(7)).astype(np.uint8))


def bloom_filter(ids: DataFrame) -> np.ndarray:
    """Bit set of all ids, sized by their number; it is merged in parts, and the driver gets its bytes only."""
    n = max(1, ids.count())
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, 1 << (BLOOM_SHARE * n - 1).bit_length()))

    def build(frames):
        out = np.zeros(bits // 8, np.uint8)
        for frame in frames:
            for at, bit in _places(frame.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(out, at, bit)
        whole = out.reshape(-1, BLOOM_PART)
        parts = np.flatnonzero(whole.any(axis=1))
        for i in range(0, len(parts), 256):
            yield pa.RecordBatch.from_arrays([pa.array(parts[i : i + 256].astype(np.int32)), pa.array([whole[p].tobytes() for p in parts[i : i + 256]], pa.binary())], names=["part", "bits"])

    def merge(frames):
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, data in zip(frame.column("part").to_pylist(), frame.column("bits")):
                new = np.frombuffer(data.as_py(), np.uint8)
                held[part] = held[part] | new if part in held else new
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["part", "bits"])

    kind = "part int, bits binary"
    rows = ids.mapInArrow(lean(build), kind).repartition("part").mapInArrow(lean(merge), kind).toPandas()
    out = np.zeros(bits // 8, np.uint8)
    for part, data in zip(rows["part"], rows["bits"]):
        out[part * BLOOM_PART : (part + 1) * BLOOM_PART] = np.frombuffer(data, np.uint8)
    return out


def _in_bloom(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at, bit in _places(ids, 8 * len(bits)):
        out &= bits[at] & bit != 0
    return out


SET_BYTES = 6


def sets_of(docs: DataFrame, bloom) -> DataFrame:
    """(doc_id, set) of the documents in the filter; a set is packed as sorted 48-bit hashes."""

    def run(frames):
        cache = WordHash(limit=WORDS_HELD)
        for frame in frames:
            ids = frame.column("doc_id").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(_in_bloom(bloom.value, ids))
            sets, kept, size = [], [], 0
            for i, text in zip(hit.tolist(), utf8_rows(frame.column("text").take(pa.array(hit)))):
                s = np.unique(shingles(text, cache) >> U64(15))
                sets.append(s.view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes())
                kept.append(ids[i])
                size += len(sets[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "set"])
                    sets, kept, size = [], [], 0
            if kept:
                yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(sets, pa.binary())], names=["doc_id", "set"])

    return docs.where("doc_id is not null").mapInArrow(lean(run), "doc_id long, set binary")


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :SET_BYTES] = raw
    return out.reshape(-1).view(U64)


def _verify(frames):
    for frame in frames:
        a, b = frame.column("a").to_numpy(), frame.column("b").to_numpy()
        ok = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(frame.column("x"), frame.column("y"))):
            s, t = _unpacked(x.as_py()), _unpacked(y.as_py())
            both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
            ok[i] = 100 * both >= PERCENT * (len(s) + len(t) - both)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def wanted_sets(spark: SparkSession, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The sets of the documents in ``ids(id)`` (and of a few more that the filter lets pass)."""
    return sets_of(docs, spark.sparkContext.broadcast(bloom_filter(ids.distinct())))


def verified(spark: SparkSession, sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The written table ``pairs(a, b)`` of doc_ids, reduced to pairs whose whole sets link."""
    left = pairs.join(sets.selectExpr("doc_id as a", "set as x"), "a")
    both = left.join(sets.selectExpr("doc_id as b", "set as y"), "b").select("a", "b", "x", "y")
    return materialize(spark, both.mapInArrow(lean(_verify), "a long, b long"), "njoin-links")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("a as id").union(pairs.selectExpr("b as id"))


def _prefix(n: str):
    """prefix_length as a column."""
    return F.col(n) - F.ceil(F.lit(PERCENT) * F.col(n) / 100) + 1


def _pair(x: str, y: str) -> list:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _fits(n: str, at: str, m: str, bt: str):
    n, at, m, bt = map(F.col, (n, at, m, bt))
    need = F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT))
    return (100 * F.least(n, m) >= PERCENT * F.greatest(n, m)) & (F.least(n - at, m - bt) + F.least(at, bt) >= need)


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_shingles, component_id), one row per input row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    heavy = spark.sparkContext.broadcast(heavy_shingles(texts))
    rows = materialize(spark, summaries(texts, heavy), "njoin-rows")
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    # one representative per distinct set; one group per (prefix, size), named by its smallest one
    reps = materialize(spark, usable.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2")), "njoin-reps")
    groups = materialize(spark, reps.groupBy("p1", "p2").agg(F.min("rep").alias("g"), F.min("n").alias("n"), F.count(F.lit(1)).alias("members")), "njoin-groups")
    heads = usable.select("doc_id", "prefix", "s1", "s2").join(groups.select("g", "n", "members"), F.col("doc_id") == F.col("g"))
    entries = groups.agg(F.sum(_prefix("n"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), int(-(-entries // BUCKET_ENTRIES)))
    lists = materialize(spark, postings(heads, parts, heavy).repartitionById(parts, "bucket").mapInArrow(lean(_lists), LISTS), "njoin-lists")
    members = materialize(spark, reps.join(groups.where("members > 1").select("p1", "p2", "g"), ["p1", "p2"]).select("g", "rep", "n"), "njoin-members")
    # likely pairs first: those that share their pivot in a good part of the prefix; step 4 is exact for the rest
    shared = lists.where((F.col("g") != F.col("pg")) & _fits("n", "at", "pn", "pat")).groupBy("g", "pg").agg(F.count(F.lit(1)).alias("k"), F.least(F.min("n"), F.min("pn")).alias("low"))
    near_pivot = shared.where(F.col("k") >= LIKELY * _prefix("low")).select(*_pair("g", "pg"))
    pairs = materialize(spark, near_pivot.union(members.where("rep <> g").select(*_pair("g", "rep"))).distinct(), "njoin-pairs")
    # both sides of the join read one shuffle of the sets, so these are not written
    links = verified(spark, wanted_sets(spark, texts, _ends(pairs)), pairs)
    release(spark, pairs, groups)
    parts_of = materialize(spark, connected_components(spark, links), "njoin-parts")
    held = residual_lists(spark, lists, members, parts_of)
    release(spark, lists, members)
    sketches = rows.where("doc_id is not null").selectExpr("doc_id as rep", "sketch")
    more = materialize(spark, possible(residual_pairs(spark, held), sketches), "njoin-more")
    cluster = materialize(spark, held.where(F.col("size") > SHORT_LIST).select("pivot", "rep", "n").distinct(), "njoin-cluster")
    cluster = active(spark, cluster, sketches)
    release(spark, held)
    sets = materialize(spark, wanted_sets(spark, texts, _ends(more).union(cluster.selectExpr("rep as id"))), "njoin-sets")
    links = links.union(verified(spark, sets, more)).union(residual_cells(spark, sets, cluster))
    # an id that holds several sets is one node: its sets link
    held_by = usable.join(reps.select("s1", "s2", "rep"), ["s1", "s2"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z"), F.collect_set("rep").alias("all"))
    links = links.union(held_by.where("a < z").select("a", F.explode("all").alias("b")).where("a <> b"))
    parts_of = materialize(spark, connected_components(spark, links), "njoin-parts")
    by_set = reps.join(parts_of.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("part"))
    by_set = materialize(spark, by_set, "njoin-by-set")
    release(spark, more, sets, cluster, reps)
    out = rows.select("doc_id", "n_shingles", "s1", "s2").join(by_set, ["s1", "s2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("part")), F.col("doc_id")))
    return out.select("doc_id", "n_shingles", own.alias("component_id"))


def residual_lists(spark: SparkSession, lists: DataFrame, members: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows (shingle, rep, n, at, part, size, pivot) of the lists whose members lie in several components."""
    known = parts.withColumnRenamed("node", "rep")
    alone = lists.select("shingle", F.col("g").alias("rep"), "n", "at")
    inside = lists.select("shingle", "g", "at").join(members.where("rep <> g"), "g").select("shingle", "rep", "n", "at")
    named = alone.union(inside).join(known, "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    named = materialize(spark, named, "njoin-named")
    pivot = F.min(F.struct(F.xxhash64("rep").alias("h"), "rep"))["rep"]
    mixed = named.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count(F.lit(1)).alias("size"), pivot.alias("pivot"))
    mixed = materialize(spark, mixed.where("lo <> hi").select("shingle", "size", "pivot"), "njoin-mixed")
    held = materialize(spark, named.join(mixed, "shingle"), "njoin-held")
    release(spark, named, mixed)
    return held


def residual_pairs(spark: SparkSession, held: DataFrame) -> DataFrame:
    """Short lists: pairs of members from different components whose prefixes can still link.

    A shared shingle lies in both prefixes, or behind the prefix that ends first in the order. So the
    intersection is at most the shared lists (short ones counted, long ones at most as many as either
    stands in) and the longer rest of the two sets.
    """
    long_lists = held.groupBy("rep").agg(F.sum((F.col("size") > SHORT_LIST).cast("long")).alias("long"))
    short = held.where(F.col("size") <= SHORT_LIST).join(materialize(spark, long_lists, "njoin-long"), "rep")
    short = materialize(spark, short, "njoin-short")
    a, b = (short.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "n", "part", "at", "long"))) for s in "ab")
    joined = a.join(b, "shingle").where((F.col("part_a") < F.col("part_b")) & _fits("n_a", "at_a", "n_b", "at_b"))
    found = joined.groupBy("rep_a", "rep_b").agg(F.count(F.lit(1)).alias("k"), *(F.min(c).alias(c) for c in ("n_a", "n_b", "long_a", "long_b")))
    rest = F.greatest(F.col("n_a") - _prefix("n_a"), F.col("n_b") - _prefix("n_b"))
    need = F.ceil(F.lit(PERCENT) * (F.col("n_a") + F.col("n_b")) / (100 + PERCENT))
    return found.where(F.col("k") + F.least("long_a", "long_b") + rest >= need).select(*_pair("rep_a", "rep_b"))


def _cells(spark: SparkSession, cluster: DataFrame, values: DataFrame, rows: int, words: int) -> DataFrame:
    """Cuts every cluster into blocks of about so many rows and shingles; a row for each pair of blocks that a member's block is in."""
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / rows, F.sum("n") / words)).cast("int")
    sizes = materialize(spark, cluster.groupBy("pivot").agg(blocks.alias("blocks")), "njoin-sizes")
    placed = cluster.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("int"))
    placed = placed.join(values, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return placed.select("pivot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", *[c for c in values.columns if c != "rep"])


def active(spark: SparkSession, cluster: DataFrame, sketches: DataFrame) -> DataFrame:
    """The members of each cluster that some other member can still link with, by size and sketch.

    Two sets share at most the sum over ranges of the smaller count, so no link is lost; documents
    that only have a passage in common fall out here, before any set is fetched.
    """
    kept = _cells(spark, cluster, sketches, SKETCH_BLOCK, 1 << 40).groupBy("pivot", "lo", "hi").applyInArrow(_active, "pivot long, rep long")
    return materialize(spark, kept.distinct().join(cluster, ["pivot", "rep"]), "njoin-active")


def possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs whose sketches leave room for a link."""

    def run(frames):
        for frame in frames:
            x, y = frame.column("x").to_pylist(), frame.column("y").to_pylist()
            known = np.array([len(s) == 256 == len(t) for s, t in zip(x, y)], dtype=bool)
            u, v = (np.array([np.frombuffer(s, np.uint8) if len(s) == 256 else np.zeros(256, np.uint8) for s in c]).reshape(-1, 256) for c in (x, y))
            both = u.sum(axis=1, dtype=np.int64) + v.sum(axis=1, dtype=np.int64)
            ok = (PERCENT * both <= (100 + PERCENT) * np.minimum(u, v).sum(axis=1, dtype=np.int64)) | ~known
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in (frame.column("a"), frame.column("b"))], names=["a", "b"])

    joined = pairs.join(sketches.selectExpr("rep as a", "sketch as x"), "a").join(sketches.selectExpr("rep as b", "sketch as y"), "b")
    return joined.select("a", "b", "x", "y").mapInArrow(lean(run), "a long, b long").distinct()


def _active(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    pivot, lo, hi = (k.as_py() for k in key)
    block, rep = table.column("block").to_numpy(), table.column("rep").to_numpy()
    held = table.column("sketch").to_pylist()
    known = np.array([len(s) == 256 for s in held])
    count = np.array([np.frombuffer(s, np.uint8) if len(s) == 256 else np.zeros(256, np.uint8) for s in held]).reshape(-1, 256)
    size = count.sum(axis=1, dtype=np.int64)
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    hit = np.zeros(len(rep), bool)
    for i in left.tolist():
        most = np.minimum(count[i], count[right]).sum(axis=1, dtype=np.int64)
        ok = (PERCENT * (size[i] + size[right]) <= (100 + PERCENT) * most) | ~known[right] | ~known[i]
        ok &= rep[right] != rep[i]
        if ok.any():
            hit[i] = True
            hit[right[ok]] = True
    at = np.flatnonzero(hit)
    return pa.table({"pivot": pa.array(np.full(len(at), pivot), pa.int64()), "rep": pa.array(rep[at], pa.int64())})


def residual_cells(spark: SparkSession, sets: DataFrame, cluster: DataFrame) -> DataFrame:
    """Long lists: links (a, b) that span the components, found without listing pairs.

    The members of all long lists with the same pivot are one cluster, so a pair that shares such a
    list meets in its cluster. A cluster is cut into blocks; each pair of blocks is a group of
    bounded size that counts all intersections of its sets at once and returns a spanning forest.
    """
    cells = _cells(spark, cluster, sets.withColumnRenamed("doc_id", "rep"), SET_BLOCK, SET_WORDS)
    return materialize(spark, cells.groupBy("pivot", "lo", "hi").applyInArrow(_cell, "a long, b long"), "njoin-cell-links")


def _cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    _, lo, hi = (k.as_py() for k in key)
    block, rep = table.column("block").to_numpy(), table.column("rep").to_numpy()
    sets = [_unpacked(x.as_py()) for x in table.column("set")]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[word] > 1
    owner, word = owner[shared], word[shared]
    place = np.full(len(times), -1)
    place[np.flatnonzero(times > 1)] = np.arange(int((times > 1).sum()))
    word = place[word]
    order = np.argsort(word, kind="stable")
    owner, word = owner[order], word[order]
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(word[-1]) + 1 if len(word) else 0, CELL_WORDS):
        i, j = np.searchsorted(word, (at, at + CELL_WORDS))
        dense = np.zeros((len(sets), CELL_WORDS), np.float32)
        dense[owner[i:j], word[i:j] - at] = 1
        both += dense[left] @ dense[right].T
    union = size[left][:, None] + size[right][None, :] - both
    i, j = np.nonzero(100 * both.astype(np.float64) >= PERCENT * union.astype(np.float64))
    forest = Forest(len(sets))
    kept = [(u, w) for u, w in zip(left[i].tolist(), right[j].tolist()) if u != w and forest.join(u, w)]
    u, w = (np.array(c, dtype=np.int64) for c in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 2
    return pa.table({"a": pa.array(rep[u], pa.int64()), "b": pa.array(rep[w], pa.int64())})


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def _picked(docs: DataFrame, bloom, inside: bool) -> DataFrame:
    """The rows of ``docs`` whose id is (or is not) in the filter; null ids are outside."""

    def run(frames):
        for frame in frames:
            ids = frame.column("doc_id")
            hit = np.zeros(len(ids), bool)
            known = np.flatnonzero(~np.asarray(ids.is_null()))
            values = ids.take(pa.array(known)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            hit[known] = _in_bloom(bloom.value, np.ascontiguousarray(values))
            yield frame.filter(pa.array(hit if inside else ~hit))

    return docs.mapInArrow(lean(run), docs.schema)


def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` less all but one document of each group: the one with the smallest id, once.

    Rows with a null id, and documents without words, stay. Rows that repeat an id are one document; of
    those that repeat a kept id, the one with the smallest text (then the smallest other columns) stays.
    """
    table, names = set_aside(docs, "doc_id", "text")
    parts = materialize(spark, near_duplicates(spark, table), "njoin-result")
    drop = materialize(spark, parts.where("component_id <> doc_id").select(F.col("doc_id").alias("_id")).distinct(), "njoin-drop")
    # rows outside the filter are kept where they are; only the others meet the exact join
    bloom = spark.sparkContext.broadcast(bloom_filter(drop))
    maybe = _picked(table, bloom, True).join(drop, F.col("doc_id") == F.col("_id"), "left_anti")
    rest = _picked(table, bloom, False).unionByName(maybe)
    again = materialize(spark, parts.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "njoin-again")
    release(spark, parts)
    if not again.take(1):
        return given(rest, names, docs.columns)
    once = rest.join(again, F.col("doc_id") == F.col("_id"), "left_anti")
    twice = rest.join(again, F.col("doc_id") == F.col("_id"), "left_semi")
    first = twice.groupBy("doc_id").agg(F.min_by(F.struct(*table.columns), F.struct(F.col("text"), F.to_json(F.struct(*table.columns)))).alias("_row"))
    return given(once.unionByName(first.select("_row.*")), names, docs.columns)
