"""Vector best-fit packing of tokenized documents into sequences.

Every piece is a vector (tokens, 1 document, attention cost = tokens squared). A sequence has a
residual in each of the three capacities. Pieces are taken in falling order of length; each goes to
the open sequence that fits it under every constraint and scores best: the smallest norm of the
residual left (``rule="norm"``) or the largest dot product of piece and residual, both in units of
the capacities and weighted (``rule="dot"``); if none fits, a sequence is opened.

A vector depends on a piece's length alone, so the packing runs on the histogram of lengths. Equal
sequences are kept as one group (a range of sequence numbers with one residual); a step puts as
many pieces as fit into each sequence of a group at once. A step ends a group, opens one, or ends a
length, so the plan has a few thousand rows whatever the corpus size; it alone reaches the driver.
Each piece then finds its place from its rank among the pieces of its length. Ranks come from
counters inside each task plus sums over tasks, with no sort of the corpus and no group in one task.

Longer documents are cut into pieces of ``capacity`` tokens, the first one shorter. Null text: empty
(the end id alone). Rows with null or repeated doc_id are packed as rows of their own. An empty table
gives an empty table. Further columns are ignored.
"""

from __future__ import annotations

import json
import math
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import lean, materialize

CAPACITY = 2048
END_ID = 0


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """A fast encoder with the ids of a byte-level BPE ``tokenizers`` file (same merges and split)."""
    import tiktoken

    model = json.load(open(vocabulary, encoding="utf-8"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    to_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"


def tokenize(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> one row per piece; ``local_rank`` counts a task's pieces of a length."""
    vocabulary = vocabulary or default_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("local_rank", pa.int64())])

    def run(frames):
        enc, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for frame in frames:
            cols: list[list] = [[] for _ in schema]
            for doc_id, text in zip(frame.column("doc_id"), frame.column("text")):
                text, doc_id = text.as_py() or "", doc_id.as_py()
                ids = np.array([*enc.encode(text, allowed_special="all", disallowed_special=()), END_ID], dtype="<u4")
                at, left, piece = 0, len(ids) % capacity or capacity, 0
                while at < len(ids):
                    n = left if not piece else capacity
                    for col, v in zip(cols, (doc_id, piece, at, n, zlib.crc32(ids[at : at + n].tobytes()), task, seen[n])):
                        col.append(v)
                    seen[n] += 1
                    at, piece = at + n, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), PIECES)


def best_fit_plan(counts: dict[int, int], capacities=(CAPACITY, CAPACITY, CAPACITY**2), rule: str = "norm", weights=(1.0, 1.0, 1.0)) -> list[tuple]:
    """``counts``: pieces of each length -> steps (length, first_rank, n, per_sequence, first_sequence, offset).

    A step puts pieces of ranks first_rank .. first_rank + n - 1 into sequences from first_sequence
    on, per_sequence in each, the first at token ``offset``.
    """
    cap = np.array(capacities, dtype=float)
    units = np.sqrt(np.array(weights, dtype=float)) / cap
    groups = np.zeros((0, 3))  # residuals
    first, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    steps, opened = [], 0
    for length in sorted(counts, reverse=True):
        vec = np.array([length, 1, length**2], dtype=float)
        if (vec > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        rank, n = 0, counts[length]
        while n:
            fits = np.flatnonzero((groups >= vec).all(axis=1))
            if len(fits):
                rest = groups[fits]
                score = ((rest - vec) * units) ** 2 if rule == "norm" else -(rest * vec * units**2)
                at = fits[np.argmin(score.sum(axis=1))]
                each = int(min(groups[at] // vec))
                if n < each:
                    each = n
                used = min(int(size[at]), n // each)
                offset = int(cap[0] - groups[at][0])
                steps.append((length, rank, used * each, each, int(first[at]), offset))
                if used < size[at]:  # the rest of the group stays as it is
                    groups = np.vstack([groups, groups[at]])
                    first, size = np.append(first, first[at] + used), np.append(size, size[at] - used)
                groups[at] = groups[at] - each * vec
                size[at] = used
            else:
                each = min(int(min(cap // vec)), n)
                used = n // each
                steps.append((length, rank, used * each, each, opened, 0))
                groups = np.vstack([groups, cap - each * vec])
                first, size = np.append(first, opened), np.append(size, used)
                opened += used
            rank, n = rank + used * each, n - used * each
        keep = (groups[:, 0] >= 1) & (groups[:, 1] >= 1)
        groups, first, size = groups[keep], first[keep], size[keep]
    return steps


def pack(spark: SparkSession, pieces: DataFrame, capacities=None, rule: str = "norm", weights=(1.0, 1.0, 1.0), capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the written table ``pieces`` (columns as from ``tokenize``)."""
    capacities = capacities or (capacity, capacity, capacity**2)
    per_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    # at most ``capacity`` rows reach the driver
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = sorted(best_fit_plan(counts, capacities, rule, weights))
    plan = spark.sparkContext.broadcast(np.array(steps, dtype=np.int64).reshape(-1, 6))
    before = F.sum("n").over(W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    bases = per_task.withColumn("base", F.coalesce(before, F.lit(0))).select("task", "length", "base")
    ranked = pieces.join(bases, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local_rank")).alias("rank"))

    def place(frames):
        rows = plan.value
        key = rows[:, 0] * (1 << 48) + rows[:, 1]
        for frame in frames:
            length, rank = (frame.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            step = rows[np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1] if len(rows) else rows
            nth = rank - step[:, 1]
            seq = step[:, 4] + nth // step[:, 3]
            offset = step[:, 5] + nth % step[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(frame.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(spark: SparkSession, docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, **options) -> DataFrame:
    pieces = materialize(spark, tokenize(docs, capacity, vocabulary), "pack-pieces")
    return pack(spark, pieces, capacity=capacity, **options)


def op2_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
