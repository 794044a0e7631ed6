"""Shared helpers of the training-data operators: shared scratch tables, hashing, binary exchange.

Scratch data goes below ``spark.checkpoint.dir`` (shared by all executors), so lineage cut there
survives the loss of executors; its rules are those of ``plans.scratch``.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborspark.plans import scratch
from arborspark.plans.scratch import new_path  # noqa: F401

U64 = np.uint64


def materialize(spark: SparkSession, df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read from there (lineage is cut)."""
    return scratch.materialize(df, tag)


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that no returned plan reads any more."""
    scratch.release(*tables)


def set_aside(table: DataFrame, *used: str) -> tuple[DataFrame, dict[str, str]]:
    """``table`` with all columns but ``used`` under private names, and how to name them again.

    Operators add columns of their own to the rows they are given; a given column of such a name then
    meets none of them. ``used`` columns that the table lacks are left out.
    """
    names = {c: f"__given_{i}" for i, c in enumerate(table.columns) if c not in used}
    return table.toDF(*(names.get(c, c) for c in table.columns)), names


def given(table: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
    """``columns`` of a table that ``set_aside`` gave ``names``, under their own names."""
    return table.select(*(names.get(c, c) for c in columns)).toDF(*columns)


def lean(fn: Callable) -> Callable:
    """``fn`` for mapInArrow, with freed memory given back at the end of each task: workers outlive tasks."""

    def run(frames):
        yield from fn(frames)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library: nothing to give back by hand
            pass

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def arrow_map(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def utf8_rows(column: pa.ChunkedArray | pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each string, b"" for null, without decoding."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
        column = column.view(kind)
    for x in column:
        v = x.as_py()
        yield b"" if v is None else v


class WordHash(dict):
    """word bytes -> 64-bit hash; cleared when it holds ``limit`` words, so memory stays bounded."""

    def __init__(self, bits: int = 64, limit: int = 400_000):
        super().__init__()
        self.shift, self.limit = 64 - bits, limit

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> self.shift
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.limit:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 arrays (multiplications wrap)."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x = x ^ (x >> U64(33))
    x = x * _M2
    return x ^ (x >> U64(33))


def run_sum(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sum of each value array per key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return (k[first], *(np.add.reduceat(v[order], first) for v in values))


class Forest:
    """Union-find on dense indices with path halving; the smaller index is the root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if a > b:
            a, b = b, a
        self.parent[b] = a
        return True


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, component)`` with the smallest reachable node.

    Alternating large-star / small-star; every round is written to the shared folder. Joins read
    written tables directly, so adaptive execution can split the partition of a hub. Nodes without
    an edge to another node do not appear.
    """

    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = materialize(spark, canonical(edges), "cc-edges")
    seen = mark(current)
    while seen[0]:
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-low")
        large = materialize(spark, current.join(low, "a").select(F.col("a"), F.col("b"), "m").selectExpr("b as x", "a as y", "m").union(current.selectExpr("b as k", "a as other").join(low.selectExpr("a as k", "m"), "k").selectExpr("k as x", "other as y", "m")).where("y > m").selectExpr("y as a", "m as b").distinct(), "cc-large")
        least = materialize(spark, large.groupBy("a").agg(F.min("b").alias("m")), "cc-least")
        small = materialize(spark, canonical(large.join(least, "a").selectExpr("b as a", "m as b").union(least.selectExpr("a", "m as b"))), "cc-small")
        now = mark(small)
        release(spark, current, low, large, least)
        current = small
        if now == seen:
            break
        seen = now
    return current.selectExpr("a as node", "b as component").union(current.selectExpr("b as node", "b as component").distinct())


def pack_records(records: np.ndarray) -> bytes:
    """A structured array as compressed bytes, byte planes apart (sorted columns shrink well)."""
    planes = np.ascontiguousarray(records).view(np.uint8).reshape(-1, records.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack_records(data: bytes, dtype: np.dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(dtype.itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(dtype)


def cut_by_bucket(records: np.ndarray, bucket: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """Packed slices of records that are sorted by bucket."""
    cuts = np.searchsorted(bucket, np.arange(parts + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, pack_records(records[cuts[b] : cuts[b + 1]])
