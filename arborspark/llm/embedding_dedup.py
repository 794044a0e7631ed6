"""Embedding near-dedup by cross-polytope hashing with multiprobe buckets.

Exact copies (same label, same components) are collapsed first; each distinct vector is hashed.
A hash function pads the unit vector to a power of two, turns it by three rounds of random signs and
a fast Hadamard transform, and names the nearest vertex of the cross-polytope (index and sign of the
largest component). ``FUNCTIONS`` functions make a bucket of a table; a vector stands in the bucket
of its vertices and in the ``PROBES`` - 1 next likely ones, in each of ``TABLES`` tables. Two vectors
that share a bucket are a candidate pair; its cosine is computed in double precision and kept at
0.98 or more. At cosine 0.98 and 64 dimensions a table finds 0.93 of the pairs and six tables miss
about 2 in 10^7 (measured in tests against brute force).

A pair is counted only in the first bucket that its two vectors share, so links are exact counts
without a pair table. A bucket of more than ``BLOCK`` vectors is cut into blocks, and each pair of
blocks is a cell of its own; cells return link counts and a spanning forest, never pairs. Copies
add their number to the counts. Vectors travel in their own type, with their buckets that hold other vectors
only, and for one part of the buckets at a time, whose shuffle is dropped before the next.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label
or id, link with nothing: n_links 0, component_id = vec_id. Vectors of unequal length do not link.
Rows that repeat a vec_id are vectors of their own: each has its own links and component. An empty table gives an empty result.
Further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.llm.common import Forest, U64, connected_components, lean, materialize, mix64, release

THRESHOLD = 0.98
TABLES, FUNCTIONS, PROBES, CHOICES, BLOCK = 6, 3, 4, 3, 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (length a power of two), orthonormal."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


@lru_cache(maxsize=64)
def _signs(table: int, function: int, d: int) -> np.ndarray:
    return np.random.default_rng((17, table, function, d)).choice([-1.0, 1.0], size=(3, d))


def _turned(x: np.ndarray, table: int, function: int) -> np.ndarray:
    for s in _signs(table, function, x.shape[1]):
        x = hadamard(x * s)
    return x


@lru_cache(maxsize=64)
def _turn(table: int, function: int, d: int) -> np.ndarray:
    """The three transforms of a function as one matrix."""
    return _turned(np.eye(d), table, function)


def turned(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """Rows after the rotation of a function: up to 512 dimensions by its matrix, which is made by the
    fast transforms and costs less than they do there."""
    return x @ _turn(table, function, x.shape[1]) if x.shape[1] <= 512 else _turned(x, table, function)


def _largest(size: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest values of each row, in falling order."""
    size, out = size.copy(), []
    rows = np.arange(len(size))
    for _ in range(k):
        out.append(size.argmax(axis=1))
        size[rows, out[-1]] = -1
    return np.stack(out, axis=1)


def buckets(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Unit rows -> (rows, TABLES * PROBES) bucket keys as int64; ``salt`` (uint64 per row) separates labels."""
    n, d0 = x.shape
    d = 1 << max(1, (d0 - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - d0)))
    choices = min(CHOICES, d)
    options = np.array(list(product(range(choices), repeat=FUNCTIONS)))
    out = []
    for t in range(TABLES):
        codes, loss = [], 0.0
        for f in range(FUNCTIONS):
            y = turned(x, t, f)
            size = np.abs(y)
            top = _largest(size, choices)
            codes.append(top * 2 + (np.take_along_axis(y, top, 1) < 0))
            best = np.take_along_axis(size, top, 1) ** 2
            loss = loss + (best[:, :1] - best)[:, options[:, f]]
        probe = np.argsort(loss, axis=1, kind="stable")[:, :PROBES]
        key = np.broadcast_to(salt[:, None] ^ U64(t + 1 << 32), probe.shape).astype(U64)
        for f in range(FUNCTIONS):
            key = mix64(key + np.take_along_axis(codes[f], options[probe][:, :, f], 1).astype(U64))
        out.append(key)
    return np.concatenate(out, axis=1).view(np.int64)


def prepared(table: DataFrame) -> DataFrame:
    """(vec_id, label, v, ok, k1, k2): 128-bit key of (label, components) for vectors that take part."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    ok = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda c: c != 0)
    ok = F.coalesce(ok, F.lit(False))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").alias("v"), ok.alias("ok"), v.alias("_v"))
    k1, k2 = F.xxhash64("label", "_v"), F.xxhash64(F.lit(7), "_v", "label")
    return rows.select("vec_id", "label", F.when(F.col("ok"), F.col("v")).alias("v"), "ok", F.when(F.col("ok"), k1).alias("k1"), F.when(F.col("ok"), k2).alias("k2"))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def places_of(reps: DataFrame) -> DataFrame:
    """(rep, bucket) of each distinct vector, once per bucket."""

    def run(frames):
        for frame in frames:
            col, ids = frame.column("v"), frame.column("rep").to_numpy(zero_copy_only=False)
            salts = frame.column("salt").to_numpy(zero_copy_only=False).view(U64)
            lengths = col.value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                for rows in np.array_split(at, -(-len(at) // 2000)):
                    keys = np.sort(buckets(unit(_matrix(col.take(pa.array(rows)))), mix64(salts[rows] + U64(d))), axis=1)
                    once = np.append(np.ones((len(rows), 1), bool), keys[:, 1:] != keys[:, :-1], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], once.sum(axis=1))), pa.array(keys[once])], names=["rep", "bucket"])

    return reps.select("rep", "v", F.xxhash64("label").alias("salt")).mapInArrow(lean(run), "rep long, bucket long")


def _first_shared(sig: list[np.ndarray], p: np.ndarray, q: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether ``bucket`` is the first one that both rows of a pair stand in; ``sig`` are sorted."""
    out = np.zeros(len(p), bool)
    width = max(map(len, sig))
    whole = np.array([np.append(s, np.full(width - len(s), s[-1])) for s in sig])
    for i in range(0, len(p), 20_000):
        a, b = whole[p[i : i + 20_000]], whole[q[i : i + 20_000]]
        same = (a[:, :, None] == b[:, None, :]).any(axis=2)
        out[i : i + 20_000] = np.where(same, a, np.iinfo(np.int64).max).min(axis=1) == bucket[i : i + 20_000]
    return out


def _linked(x: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[p[i : i + 50_000]], x[q[i : i + 50_000]]) >= THRESHOLD for i in range(0, len(p), 50_000)]) if len(p) else np.zeros(0, bool)


def verify(frames):
    """Cells sorted by (bucket, lo, hi) -> (rep, links, root): counts of links and a spanning forest of each batch of cells.

    A cell is one bucket or a pair of its blocks. Many small cells are compared at once; only the last cell
    of a frame, which may go on in the next one, is kept back.
    """
    held: list[pa.Table] = []
    for frame in frames:
        rows = pa.Table.from_batches([frame])
        if not len(rows):
            continue
        cell = [rows.column(c).to_numpy() for c in ("bucket", "lo", "hi")]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in cell])) + 1
        if held and any(held[-1].column(c)[-1].as_py() != rows.column(c)[0].as_py() for c in ("bucket", "lo", "hi")):
            yield _cells_done(pa.concat_tables(held))
            held = []
        if len(change):
            held.append(rows.slice(0, change[-1]))
            yield _cells_done(pa.concat_tables(held))
            held = [rows.slice(change[-1])]
        else:
            held.append(rows)
    if held:
        yield _cells_done(pa.concat_tables(held))


def _cells_done(table: pa.Table) -> pa.RecordBatch:
    """The result of whole cells; vectors of a cell have one length."""
    table = table.combine_chunks()
    lengths = table.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
    if (lengths != lengths[0]).any():
        done = [_cells_done(table.filter(pa.array(lengths == d))) for d in np.unique(lengths)]
        whole = pa.Table.from_batches(done).combine_chunks()
        return whole.to_batches()[0] if len(whole) else done[0]
    bucket, lo, hi, block, reps, copies = (table.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block", "rep", "copies"))
    x = unit(_matrix(table.column("v").combine_chunks()))
    col = table.column("sig").combine_chunks()
    ends = col.value_lengths().to_numpy(zero_copy_only=False).cumsum()
    sig = np.split(col.flatten().to_numpy(zero_copy_only=False), ends[:-1])
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(bucket)))
    ps, qs = [], []
    small = size <= 32
    for n in np.unique(size[small]):  # all cells of n rows at once
        i, j = np.triu_indices(n, 1)
        base = first[small & (size == n)][:, None]
        p, q = (base + i).ravel(), (base + j).ravel()
        ok = (lo[p] == hi[p]) | (block[p] != block[q])
        ok[ok] = _linked(x, p[ok], q[ok])
        ps.append(p[ok]), qs.append(q[ok])
    links, forest = np.zeros(len(reps), np.int64), Forest(len(reps))
    linked = np.zeros(len(reps), bool)

    def join(p, q):
        keep = _first_shared(sig, p, q, bucket[p])
        p, q = p[keep], q[keep]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        linked[p] = linked[q] = True
        for u, w in zip(p.tolist(), q.tolist()):
            forest.join(u, w)

    if ps and sum(map(len, ps)):
        join(np.concatenate(ps), np.concatenate(qs))
    for at, n in zip(first[~small].tolist(), size[~small].tolist()):
        rows = np.arange(at, at + n)
        a, b = rows[block[rows] == lo[at]], rows[block[rows] == hi[at]]
        for i0 in range(0, len(a), 256):
            left = a[i0 : i0 + 256]
            i, j = np.nonzero(x[left] @ x[b].T >= THRESHOLD)
            i, j = left[i], b[j]
            if lo[at] == hi[at]:
                i, j = i[i < j], j[i < j]
            if len(i):
                join(i, j)
    at = np.flatnonzero(linked)
    root = np.array([forest.find(u) for u in at.tolist()], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(reps[at]), pa.array(links[at]), pa.array(reps[root] if len(root) else np.zeros(0, np.int64))], names=["rep", "links", "root"])


def near_duplicates(spark: SparkSession, table: DataFrame) -> DataFrame:
    """``table(vec_id, embedding, label)`` -> (vec_id, n_links, component_id, kept)."""
    rows = prepared(table)
    distinct = rows.where("ok").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("label"), F.first("v").alias("v"))
    # ids may repeat, so distinct vectors get numbers of their own
    reps = materialize(spark, distinct.withColumn("rep", F.monotonically_increasing_id()), "emb-reps")
    places = materialize(spark, places_of(reps), "emb-places")
    # a vector keeps only its buckets with other vectors, in rising order
    busy = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = materialize(spark, places.join(busy, "bucket").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("bucket", "blocks"))).alias("at")), "emb-shared")
    release(spark, places)
    found = None
    for turn in range(TABLES):  # a part of the buckets at a time: the vectors travel once for each
        part = F.filter("at", lambda s: F.pmod(F.xxhash64(s["bucket"]), F.lit(TABLES)) == turn)
        wide = reps.select("rep", "copies", "v").join(shared.withColumn("part", part).where(F.size("part") > 0), "rep")
        wide = wide.select("rep", "copies", "v", F.col("at.bucket").alias("sig"), F.explode("part").alias("p"))
        block = F.pmod(F.xxhash64("rep"), F.col("p.blocks")).cast("int")
        cells = wide.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("p.blocks") - 1)))
        cells = cells.select(F.col("p.bucket").alias("bucket"), F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "copies", "v", "sig")
        done = materialize(spark, cells.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(lean(verify), "rep long, links long, root long"), "emb-links")
        found = done if found is None else found.union(done)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(spark, found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    parts = materialize(spark, parts.join(reps.select("rep", "id"), "rep"), "emb-parts")
    least = parts.groupBy("component").agg(F.min("id").alias("least"))
    named = parts.join(least, "component").select("rep", "least")
    known = reps.select("rep", "id", "k1", "k2", "copies").join(links, "rep", "left").join(named, "rep", "left")
    known = known.select("k1", "k2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "id").alias("component_id"))
    known = materialize(spark, known, "emb-known")
    release(spark, reps, shared)
    out = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.node = vec_id
"""
