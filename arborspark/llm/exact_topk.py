"""Exact top-k inner product search by a three-phase uniform threshold.

The dimensions are cut into ``LISTS`` blocks; a vector's total score for a query is the sum of its
partial scores in the blocks, so each block is a score list over all vectors. Every vector lies in
one task, which holds its entries of all lists.

1. Each task gathers, per query and list, its k best entries, and resolves the whole scores of these
   few only. The k-th best among all of a query's gathered vectors is a safe cutoff.
2. The cutoffs (one number per query of the wave) are broadcast. Lists are taken one by one: a vector
   whose entries so far and the largest that its rest can add (by the norms of the rest) stay below
   the cutoff is dropped. A total that reaches the cutoff has an entry of at least cutoff / LISTS in
   some list; a pair without one is dropped as well.
3. Once few pairs are left, only their remaining entries are computed, and totals that reach the cutoff
   are exact results.

Queries are taken in waves of about ``WAVE`` rows (all that is broadcast), so memory does not grow
with their number; every wave meets all rows in blocks and its results are written before the next one.

Vectors that are null, empty, or hold null or non-finite components, and rows with a null id, take
no part. Every row is a vector of its own, also where it repeats an id: a query's candidates are all rows
but itself. Only vectors of equal length are compared. Ties go to the smaller id; with fewer than k
candidates all are returned; an empty table gives an empty result. Scores are exact at any magnitude below
2^63. Further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import lean, materialize, new_path, release
from arborspark.plans.scratch import shuffles_dropped

LISTS, WAVE, CHUNK, GROUP = 4, 2048, 2048, 32
#: Share of pairs from which on they are resolved one by one instead of in whole blocks.
FEW = 0.02
SCALE = 256.0


def quantized(table: DataFrame, scale: float = SCALE) -> DataFrame:
    """(row, vec_id, v array<double> of whole numbers) of the vectors that take part; ``row`` tells rows apart."""

    def run(frames):
        for frame in frames:
            col = frame.column("v")
            n = col.value_lengths().to_numpy(zero_copy_only=False)
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(n) - n
            ok = np.add.reduceat(~np.isfinite(flat), starts) == 0 if len(n) else np.zeros(0, bool)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(np.floor(flat * scale)))
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(ok)) for x in (frame.column("row"), frame.column("vec_id"), lists)], names=["row", "vec_id", "v"])

    rows = table.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.mapInArrow(lean(run), "row long, vec_id long, v array<double>")


def _frames(frames, chunk=CHUNK):
    """(rows, ids, matrix) per length of vectors, at most ``chunk`` rows each."""
    for frame in frames:
        row, ids = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id"))
        col = frame.column("v")
        lengths = col.value_lengths().to_numpy(zero_copy_only=False)
        flat, start = col.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths) - lengths
        for d in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == d)
            for i in range(0, len(at), chunk):
                part = at[i : i + chunk]
                yield row[part], ids[part], flat[start[part][:, None] + np.arange(d)]


def fitting(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices in the smallest type in which every sum of products is exact."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * x.shape[1]
    if most < 2.0**24:
        return x.astype(np.float32), q.astype(np.float32)
    if most < 2.0**53:
        return x, q
    return tuple(np.vectorize(int, otypes=[object])(m) for m in (x, q))


def lists_of(d: int) -> list[slice]:
    cuts = np.linspace(0, d, LISTS + 1).astype(int)
    return [slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def best_entries(p: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k largest values of each column of ``p``; the k best lie in the k groups of the largest maxima."""
    n, m = p.shape
    cols = np.arange(m)
    groups = n // GROUP
    if p.dtype == object or groups <= k:
        return np.argsort(-p, axis=0, kind="stable")[:k] if p.dtype == object else np.argpartition(-p, min(k, n) - 1, axis=0)[:k]
    top = np.argpartition(-p[: groups * GROUP].reshape(GROUP, groups, m).max(axis=0), k - 1, axis=0)[:k]
    rows = (np.arange(GROUP)[:, None, None] * groups + top).reshape(-1, m)
    rows = np.vstack([rows, np.broadcast_to(np.arange(groups * GROUP, n)[:, None], (n - groups * GROUP, m))])
    return np.take_along_axis(rows, np.argpartition(-p[rows, cols], k - 1, axis=0)[:k], axis=0)


def pair_scores(x: np.ndarray, q: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    out = [(x[rows[i : i + 50_000]] * q[cols[i : i + 50_000]]).sum(axis=1) for i in range(0, len(rows), 50_000)]
    return np.concatenate(out) if out else np.zeros(0, x.dtype)


def _held_best(held: tuple | None, new: tuple, k: int) -> tuple:
    """k best (query, score, id, row) per query of two lots, each row once; ties to the smaller id."""
    q, s, i, r = (np.concatenate(c) for c in zip(held, new)) if held else new
    if s.dtype == object:
        order = np.array(sorted(range(len(q)), key=lambda j: (q[j], -s[j], i[j], r[j])), dtype=np.int64)
    else:
        order = np.lexsort((r, i, -s, q))
    q, s, i, r = q[order], s[order], i[order], r[order]
    once = np.append(True, (q[1:] != q[:-1]) | (r[1:] != r[:-1]))[: len(q)]
    q, s, i, r = q[once], s[once], i[once], r[once]
    first = np.concatenate(([0], np.flatnonzero(q[1:] != q[:-1]) + 1)) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    keep = rank < k
    return q[keep], s[keep], i[keep], r[keep]


def _waves(spark: SparkSession, table: DataFrame, modulus: int):
    queries = table.where(F.col("vec_id") % modulus == 0)
    n = max(1, math.ceil(queries.count() / WAVE))
    for w in range(n):
        rows = queries.where(F.pmod(F.xxhash64("row"), F.lit(n)) == w).collect() if n > 1 else queries.collect()
        by_length: dict[int, tuple[list, list]] = {}
        for r in rows:
            own, vs = by_length.setdefault(len(r["v"]), ([], []))
            own.append((r["row"], r["vec_id"])), vs.append(r["v"])
        if rows:
            yield {d: (np.array(own, dtype=np.int64), np.array(vs)) for d, (own, vs) in by_length.items()}


def gathered(row: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, k: int) -> tuple:
    """Phase 1 for a block: (query, score, id, row) of the k best entries of each list, resolved."""
    rows, cols = [], []
    for part in lists_of(x.shape[1]):
        best = best_entries(x[:, part] @ q[:, part].T, min(k + 1, len(row)))  # one may be the query itself
        rows.append(best.ravel()), cols.append(np.broadcast_to(np.arange(len(q)), best.shape).ravel())
    pair = np.unique(np.concatenate(rows) * len(q) + np.concatenate(cols))
    rows, cols = pair // len(q), pair % len(q)
    other = row[rows] != own[cols, 0]
    rows, cols = rows[other], cols[other]
    return own[cols, 0], pair_scores(x, q, rows, cols), ids[rows], row[rows]


def sufficient(row: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, q: np.ndarray, cut: np.ndarray) -> tuple:
    """Phases 2 and 3 for a block: (query, score, id, row) of all pairs that reach the cutoff, and how many were resolved."""
    parts = lists_of(x.shape[1])
    acc, reached, rows, cols = 0, False, None, None
    for at, part in enumerate(parts):
        if rows is None:
            p = x[:, part] @ q[:, part].T
            acc = acc + p
            if x.dtype == object:  # beyond doubles: no bound by norms
                continue
            reached = reached | (p >= cut / len(parts))
            rest = slice(part.stop, x.shape[1])
            far = np.linalg.norm(x[:, rest], axis=1)[:, None] * (np.linalg.norm(q[:, rest], axis=1) * 1.0001)[None, :] + 1
            alive = acc + far >= cut
            if at + 1 == len(parts):
                alive &= reached
            if at + 1 == len(parts) or np.count_nonzero(alive) <= FEW * alive.size:
                rows, cols = np.nonzero(alive)
                acc = acc[rows, cols]
        else:
            acc = acc + pair_scores(x[:, part], q[:, part], rows, cols)
            if part.stop < x.shape[1]:
                rest = slice(part.stop, x.shape[1])
                far = np.linalg.norm(x[:, rest], axis=1)[rows] * np.linalg.norm(q[:, rest], axis=1)[cols] * 1.0001 + 1
                on = acc + far >= cut[cols]
                rows, cols, acc = rows[on], cols[on], acc[on]
    if rows is None:
        rows, cols = np.nonzero((acc >= cut[None, :]).astype(bool))
        acc = acc[rows, cols]
    ok = (acc >= cut[cols]).astype(bool) & (row[rows] != own[cols, 0])
    return (own[cols[ok], 0], acc[ok], ids[rows[ok]], row[rows[ok]]), len(rows)


def _each_block(frames, queries):
    for row, ids, x in _frames(frames):
        if x.shape[1] in queries:
            own, q = queries[x.shape[1]]
            yield (row, ids, *fitting(x, q), own)


FOUND = "query long, score double, vec_id long, row long"


def gather_local(table: DataFrame, queries, k: int) -> DataFrame:
    """Phase 1: each task's k best resolved (query, score, vec_id, row) per query."""

    def run(frames):
        held = None
        for row, ids, x, q, own in _each_block(frames, queries.value):
            new = gathered(row, ids, x, own, q, k)
            held = _held_best(held, (new[0], new[1].astype(np.float64), *new[2:]), k)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query", "score", "vec_id", "row"])

    return table.mapInArrow(lean(run), FOUND)


def collect_sufficient(table: DataFrame, queries, cutoffs, k: int) -> DataFrame:
    """Phases 2 and 3: exact (query, query_id, vec_id, score), at most k per query and task."""

    def run(frames):
        held, name = None, dict(pair for own, _ in queries.value.values() for pair in own.tolist())
        for row, ids, x, q, own in _each_block(frames, queries.value):
            cut = np.array([cutoffs.value.get(i, -np.inf) for i in own[:, 0].tolist()])
            found, _ = sufficient(row, ids, x, own, q, cut.astype(x.dtype) if x.dtype == np.float32 else cut)
            held = _held_best(held, (found[0], found[1].astype(object if object in (x.dtype, held[1].dtype if held else None) else np.float64), *found[2:]), k)
        if held:
            s = held[1]
            whole = [max(-(2**63), min(2**63 - 1, int(v))) for v in s] if s.dtype == object else s.astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array([name[i] for i in held[0].tolist()], pa.int64()), pa.array(held[2]), pa.array(whole, pa.int64())], names=["query", "query_id", "vec_id", "score"])

    return table.mapInArrow(lean(run), "query long, query_id long, vec_id long, score long")


def top_k(spark: SparkSession, table: DataFrame, modulus: int = 50, k: int = 5) -> DataFrame:
    """``table(vec_id, embedding)`` -> (query_id, rank, vec_id, score) for ids divisible by ``modulus``."""
    rows = materialize(spark, quantized(table), "topk-vectors")
    path = new_path(spark, "topk-found")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for wave in _waves(spark, rows, modulus):
        queries = spark.sparkContext.broadcast(wave)
        best = W.partitionBy("query").orderBy(F.col("score").desc())
        kth = gather_local(rows, queries, k).withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query", "score")
        # one number per query of the wave; doubles beyond 2^53 are lowered to stay safe
        cutoffs = spark.sparkContext.broadcast({r[0]: r[1] if abs(r[1]) < 2.0**53 else r[1] - abs(r[1]) * 2.0**-50 for r in kth.collect()})
        order = W.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
        part = collect_sufficient(rows, queries, cutoffs, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        with shuffles_dropped(spark):
            part.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        queries.unpersist(), cutoffs.unpersist()
    release(spark, rows)
    return spark.read.schema(schema).parquet(path)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP3_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""
