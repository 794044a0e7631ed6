"""Byte-level helpers: base-128 numbers, protobuf fields, blocks of sample-major genotypes."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator


def varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = data[at]
        at += 1
        n |= (c & 127) << shift
        shift += 7
        if c < 128:
            return n, at


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def field(number: int, value: int | bytes | str) -> bytes:
    """One field: numbers as base-128, text and messages with their length."""
    if isinstance(value, int):
        return varint(number << 3) + varint(value) if value else b""
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def packed(number: int, values: Iterable[int]) -> bytes:
    body = b"".join(map(varint, values))
    return field(number, body) if body else b""


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a message; 32- and 64-bit values come as bytes."""
    at = 0
    while at < len(data):
        key, at = read_varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = read_varint(data, at)
            yield key >> 3, signed(value)
            continue
        if kind == 2:
            size, at = read_varint(data, at)
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
        else:
            raise ValueError(f"unknown wire type {kind}")
        if at + size > len(data):
            raise ValueError("the message ends early")
        yield key >> 3, data[at : at + size]
        at += size


def numbers(value: int | bytes) -> list[int]:
    """Values of a repeated number field, packed or not."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = read_varint(value, at)
        out.append(signed(n))
    return out


def sample_record(name: str, points: list[tuple[int, int]], runs: list[tuple[int, int]]) -> bytes:
    """A sample of the sample-major format: name, pairs of positions with two alleles in a byte, N runs as end and start."""
    out = bytearray(name.encode() + b"\0")
    for i in range(0, len(points), 2):
        pair = points[i : i + 2]
        for pos, _ in pair:
            out += varint(pos)
        out.append(pair[0][1] | (pair[1][1] << 4 if len(pair) == 2 else 0))
    out.append(0)
    for start, stop in runs:
        out += varint(stop) + (varint(start) if start < stop else b"")
    out.append(0)
    return bytes(out)


def block(records: bytes) -> bytes:
    body = zlib.compress(records)
    return len(body).to_bytes(8, "little") + body


def read_records(data: bytes) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """(sample, [(start, stop, allele)]) of all blocks."""
    at = 0
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        raw, at, i = zlib.decompress(data[at + 8 : at + 8 + size]), at + 8 + size, 0
        while i < len(raw):
            end = raw.index(0, i)
            name, i, found = raw[i:end].decode(), end + 1, []
            while raw[i]:
                first, i = read_varint(raw, i)
                if raw[i + 1]:
                    second, i = read_varint(raw, i)
                    found += [(first, first, raw[i] & 15), (second, second, raw[i] >> 4)]
                else:
                    found.append((first, first, raw[i] & 15))
                i += 1
            i += 1
            while raw[i]:
                stop, i = read_varint(raw, i)
                start, after = read_varint(raw, i) if raw[i] else (stop, i)
                if start < stop:
                    i = after
                else:  # the next number begins another run
                    start = stop
                found.append((start, stop, 15))
            i += 1
            yield name, found
