"""Texts that name every sample at every site, made from the calls that differ from the reference.

Samples in order are cut into chunks; for each site a chunk gives its length and its differing calls, and its
names, compressed, where the text needs them. A site's text is then put together by one task, chunk by chunk.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborspark.plans.scratch import materialize

LETTERS = np.frombuffer(b"?ACMGRSVTWYHKDBN", "uint8")
#: Samples of a chunk and of a range partition.
CHUNK, PART = 200_000, 1_000_000
_SCHEMA = pa.schema([("pos", pa.int32()), ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("names", pa.binary()), ("at", pa.binary()), ("alleles", pa.binary())])


def chunks(samples: DataFrame, order: str, sites: list[int], named: list[int], tail: bytes) -> DataFrame:
    """``samples(sample, <order>, calls array<struct<pos, allele>>)`` -> rows by (pos, part, seq): number of samples, names
    (each followed by ``tail``; at sites of ``named`` only), places and alleles of the calls."""
    held = materialize(samples, "calls")
    ordered = held.repartitionByRange(1 + held.count() // PART, order).sortWithinPartitions(order).select("sample", "calls")

    def cut(part: int, seq: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        names = zlib.compress(b"".join(x.encode() + tail for x in t["sample"].to_pylist()), 1) if named else b""
        calls = t["calls"].combine_chunks()
        lists = calls.chunk(0) if isinstance(calls, pa.ChunkedArray) else calls
        flat = lists.flatten()
        pos, allele = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        row = np.repeat(np.arange(t.num_rows, dtype="int32"), np.diff(lists.offsets.to_numpy()))
        by = np.argsort(pos, kind="stable")
        pos, allele, row = pos[by], allele[by].astype("uint8"), row[by]
        lo, hi = np.searchsorted(pos, sites, "left"), np.searchsorted(pos, sites, "right")
        cols = [sites, [part] * len(sites), [seq] * len(sites), [t.num_rows] * len(sites), [names if s in wanted else b"" for s in sites], [row[a:z].tobytes() for a, z in zip(lo, hi)], [allele[a:z].tobytes() for a, z in zip(lo, hi)]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    wanted = set(named)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, now, n = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            now.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield cut(part, seq, now)
                seq, now, n = seq + 1, [], 0
        if n:
            yield cut(part, seq, now)

    made = materialize(ordered.mapInArrow(run, "pos int, part int, seq int, n int, names binary, at binary, alleles binary"), "chunks")
    return made.repartitionByRange(len(sites), "pos").sortWithinPartitions("pos", "part", "seq")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = [batch.column(k)[i].as_py() for k in ("pos", "n", "names", "at", "alleles")]
            yield r[0], r[1], r[2], np.frombuffer(r[3], "int32"), np.frombuffer(r[4], "uint8")


def digests(samples: DataFrame, sites: dict[int, int]) -> DataFrame:
    """FN-15: (pos, alts, calls): alternatives by letter, and the MD5 of ``sample=base`` of all samples in order of their names, for sites with an alternative."""
    every = sorted(sites)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pos, rows in groupby(_rows(batches), lambda r: r[0]):
            md5, alts, last = hashlib.md5(), set(), b""
            for _, n, names, at, alleles in rows:
                text = np.frombuffer(zlib.decompress(names), "uint8").copy()
                places = np.flatnonzero(text == 0)
                if len(places) != n:
                    raise ValueError("a sample's name holds a zero byte")
                text[places] = LETTERS[sites[pos]]
                text[places[at]] = LETTERS[alleles]
                alts |= set(alleles.tolist())
                md5.update(last)
                md5.update(text[:-1])
                last = b","
            alts.discard(sites[pos])
            if alts:
                yield pa.RecordBatch.from_pydict({"pos": pa.array([pos], pa.int32()), "alts": [",".join(sorted({chr(LETTERS[a]) for a in alts}))], "calls": [md5.hexdigest()]})

    return chunks(samples, "sample", every, every, b"=\0,").mapInArrow(run, "pos int, alts string, calls string")


def write_vcf(samples: DataFrame, sites: dict[int, int], path: str, chrom: str = "chr1", compressed: bool = False) -> None:
    """SK-1: the text of ``sinks.text.write_vcf`` with genotypes, from ``samples(sample, ord, calls)``, calls other than the reference; allele 15 is unknown."""
    every = [-1, *sorted(sites)]

    def line(pos: int, rows: list[tuple]) -> bytes | None:
        n = sum(r[1] for r in rows)
        alleles = np.concatenate([r[4] for r in rows])
        at = np.concatenate([r[3] + base for r, base in zip(rows, np.cumsum([0] + [r[1] for r in rows[:-1]]))])
        real = (alleles != 15) & (alleles != sites[pos])
        alts, counts = np.unique(alleles[real], return_counts=True)
        if not len(alts):
            return None
        ref = chr(LETTERS[sites[pos]])
        text = [chr(LETTERS[a]) for a in alts]
        head = [chrom, str(pos), ",".join(f"{ref}{pos}{a}" for a in text), ref, ",".join(text), ".", ".", f"AC={','.join(map(str, counts))};AN={n}", "GT"]
        marks = np.zeros(256, "uint8")
        marks[alts], marks[15], marks[sites[pos]] = np.arange(1, len(alts) + 1), 255, 0
        calls = np.zeros(n, "uint8")
        calls[at] = marks[alleles]
        if len(alts) < 10:
            body = np.empty(2 * n, "uint8")
            body[0::2], body[1::2] = np.where(calls == 255, ord("."), calls + ord("0")), ord("\t")
            end = body[:-1].tobytes()
        else:
            end = "\t".join("." if c == 255 else str(c) for c in calls.tolist()).encode()
        return "\t".join(head).encode() + b"\t" + end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pos, rows in groupby(_rows(batches), lambda r: r[0]):
            if pos == -1:
                names = b"".join(zlib.decompress(r[2]) for r in rows)
                out = [b"##fileformat=VCFv4.2", b"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + names[:-1]]
            else:
                out = [line(pos, list(rows))]
            for value in out:
                if value is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary()).cast(pa.string())], ["value"])

    lines = chunks(samples, "ord", every, [-1], b"\t").mapInArrow(run, "value string")
    lines.write.option("compression", "gzip" if compressed else "none").text(path)
