"""LM scoring by an interpolated modified Kneser-Ney model of any order from two (``ORDER`` as registered).

Counting runs in Spark over all training texts. Tokens are runs of bytes other than space and tab to
carriage return, A-Z lower-cased, then one end per text; a text's first token follows order - 1 start
marks, which are context only. Words are 48-bit hashes, taken of whole columns of texts, eight bytes at a time. Every task counts its grams of the highest
order first and sends them packed with a word list of their own, dealt by context; grams of the few contexts that
make up about 1/1000 of all tokens are dealt by the whole gram, so a frequent context fills no task. (Which
contexts these are is guessed from every eighth text; that only steers the dealing.) The number of buckets follows
the number of tokens, so a bucket's size does not grow with the corpus. A task of the next round holds all
counts of its grams, and writes them and the sums of its contexts as segments of the model: sorted hash arrays in
files of the shared folder. It sends on the numbers of distinct left neighbours, which are the counts of the
order below (grams that begin with a start mark have nothing to their left and keep their own counts), down to
words. Counts are 64-bit throughout.

Workers memory-map the segments (where the folder is no local path: into memory of their own, up to
``HELD_BYTES``) and look up each distinct word, context and gram of a block of texts by binary search:
p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h.) + lambda(h) * p'(w), where p' is the order below without the
first word of h; words fall back to 1 / (V + 1); discounts D come from counts of counts of each order.
Probabilities of all V words and one unknown word sum to 1.

A null text is empty (its end alone is scored); rows with a null doc_id count as held out, repeated
ids are rows of their own; an empty training set gives the uniform 1 / (V + 1) = 1. Very long texts are scored in
pieces. Extra columns stay out of the result.
"""

from __future__ import annotations

import mmap
import os
import re
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arborspark.llm.common import U64, cut_by_bucket, lean, materialize, mix64, new_path, pack_records, release, unpack_records

BITS = 48
ORDER = 3
#: A context is frequent from 1 / HEAVY_SHARE of the tokens; looked for in every HEAVY_STEP-th text.
HEAVY_SHARE, HEAVY_STEP = 1000, 8
#: Tokens of a chunk, of a scored block, and of a bucket; bits of a chunk's word number.
COUNT_CHUNK, SCORE_CHUNK, BUCKET_TOKENS = 2_800_000, 600_000, 3_400_000
ID_BITS = 21
#: Bytes of text read at once; words of more than LONG_WORD bytes are hashed one by one.
READ_BYTES, LONG_WORD = 1 << 20, 64
HELD_BYTES = 1 << 29
START = xxhash.xxh3_64_intdigest(b"\nstart") >> (64 - BITS)
END = xxhash.xxh3_64_intdigest(b"\nend") >> (64 - BITS)
WORD = np.dtype([("h", "<u8"), ("c", "<u8")])
CONTEXT = np.dtype([("h", "<u8"), ("total", "<u8"), ("n1", "<u8"), ("n2", "<u8"), ("n3", "<u8")])
ADD = 0.1
SPACE = re.compile(rb"[ \t-\r]")
_HEAD = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=U64)
_LENGTH = U64(0x9E3779B97F4A7C15)


def sorting(key: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(order, sorted keys) of 64-bit keys below 2 ** bits. Places stand in the low bits of the keys and plain numbers are
    sorted, several times as fast as argsort; keys that differ only in the bits so lost are put in order after it."""
    n, spare = len(key), 64 - bits
    room = max(n - 1, 1).bit_length()
    mask = U64((1 << room) - 1)
    packed = key << U64(spare) if spare else key
    packed = (packed & ~mask if room > spare else packed) | np.arange(n, dtype=U64)
    packed.sort()
    order = (packed & mask).view(np.int64)
    k = key[order]
    if room > spare:
        down = np.flatnonzero(k[1:] < k[:-1])
        if len(down):
            packed &= ~mask
            for head in np.unique(packed[down]):
                run = slice(np.searchsorted(packed, head), np.searchsorted(packed, head, "right"))
                order[run] = order[run][np.argsort(k[run], kind="stable")]
            k = key[order]
    return order, k


def starts_of(k: np.ndarray) -> np.ndarray:
    """Where each value of sorted keys begins."""
    new = np.ones(len(k), bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    return new


def distinct(key: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, the first place of each, number of each key among them)."""
    order, k = sorting(key, bits)
    new = starts_of(k)
    k, first, number = k[new], order[new], np.cumsum(new)
    number -= 1
    at = np.empty(len(key), np.int64)
    at[order] = number
    return k, first, at


def key_sum(keys: np.ndarray, *values: np.ndarray, bits: int = 64) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the 64-bit sum of each value array (of numbers or flags) per key."""
    if not len(keys):
        return (keys, *(np.zeros(0, np.int64) for _ in values))
    order, k = sorting(keys, bits)
    first = np.flatnonzero(starts_of(k))
    return (k[first], *(np.add.reduceat(v[order], first, dtype=np.int64) for v in values))


def by_number(bucket: np.ndarray, parts: int) -> np.ndarray:
    """Stable order of bucket numbers."""
    return np.argsort(bucket.astype(np.uint16) if parts <= 1 << 16 else bucket, kind="stable")


def word_bucket(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of hashes, so that sorted words are sorted by bucket."""
    return ((h >> U64(BITS - 32)) * U64(parts) >> U64(32)).astype(np.int64)


def gram_keys(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(context, whole gram) as 64-bit keys; the last array holds the predicted words."""
    context = mix64(words[0] + U64(0x51))
    for w in words[1:-1]:
        context = mix64(context + w)
    return context, mix64(context + words[-1])


def among(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    if len(sorted_keys):
        head = np.zeros(1 << 16, bool)
        head[sorted_keys >> U64(48)] = True
        some = np.flatnonzero(head[keys >> U64(48)])
        out[some] = sorted_keys[np.minimum(np.searchsorted(sorted_keys, keys[some]), len(sorted_keys) - 1)] == keys[some]
    return out


def gram_bucket(context: np.ndarray, key: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    out = word_bucket(context >> U64(64 - BITS), parts)
    hot = among(heavy, context)
    out[hot] = (mix64(key[hot]) % U64(parts)).astype(np.int64)
    return out


def pack_grams(words: np.ndarray, ids: list[np.ndarray], c: np.ndarray) -> bytes:
    """Grams as numbers into a list of the words that occur in them, compressed by byte planes."""
    n = len(c)
    flat = np.concatenate(ids)
    if 8 * len(flat) > len(words):
        seen = np.zeros(len(words), bool)
        seen[flat] = True
        used = np.flatnonzero(seen)
        place = np.cumsum(seen) - 1
        flat = place[flat]
    else:
        used, flat = np.unique(flat, return_inverse=True)
    steps = np.diff(words[used], prepend=U64(0))  # sorted, so differences are shorter
    planes = [np.array([n, len(used), len(ids)], "<u8").view(np.uint8), steps.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel(), flat.astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel(), c.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()]
    return zstandard.ZstdCompressor(level=3).compress(np.concatenate(planes).tobytes())


def unpack_grams(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    """(words of each place, counts)."""
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, used, places = raw[:24].view("<u8").tolist()
    column = lambda at, count, width: np.ascontiguousarray(raw[at : at + count * width].reshape(width, count).T).reshape(-1).view(f"<u{width}")
    words = np.cumsum(column(24, used, 8), dtype=U64)
    flat = column(24 + 8 * used, n * places, 4)
    return [words[flat[i * n : (i + 1) * n]] for i in range(places)], column(24 + 8 * used + 4 * n * places, n, 8)


def packed_grams(words: np.ndarray, ids: list[np.ndarray], c: np.ndarray, context: np.ndarray, key: np.ndarray, heavy: np.ndarray, parts: int):
    """(bucket, packed grams); ``ids`` number the sorted distinct ``words``, and grams are sorted by the last but one."""
    bucket = gram_bucket(context, key, heavy, parts)
    order = by_number(bucket, parts)
    ids, c, bucket = [x[order] for x in ids], c[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(parts + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[b], cuts[b + 1])
        yield b, pack_grams(words, [x[part] for x in ids], c[part])


def numbered(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct words of all places, and their numbers in each place."""
    uniq, _, at = distinct(np.concatenate(words), BITS)
    return uniq, np.split(at, len(words))


def distinct_grams(ids: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct grams of word numbers, sorted by the last number but one, and how often each occurs."""
    places = [len(ids) - 2, *range(len(ids) - 2), len(ids) - 1]
    code = ids[places[0]]
    for i, place in enumerate(places[1:], 1):
        if i % 3 == 0:  # three numbers fill a code: number the codes so far
            _, _, code = distinct(code.astype(U64))
        code = (code << ID_BITS) | ids[place]
    if len(ids) <= 3:  # the code is the gram
        code = np.sort(code)
        first = np.flatnonzero(starts_of(code))
        code, c = code[first], np.diff(first, append=len(code))
        out = [None] * len(ids)
        for place in reversed(places):
            out[place] = code & ((1 << ID_BITS) - 1)
            code = code >> ID_BITS
        return out, c
    order, code = sorting(code.astype(U64))
    first = np.flatnonzero(starts_of(code))
    return [x[order[first]] for x in ids], np.diff(first, append=len(code))


def word_hashes(low: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """48-bit hashes of the words at ``starts`` of lower-case bytes (8 more follow the last): 8 bytes are mixed in at a time."""
    eight = np.ndarray((len(low) - 7,), "<u8", low, 0, (1,))
    h = mix64((eight[starts] & _HEAD[np.minimum(lengths, 8)]) + lengths.astype(U64) * _LENGTH)
    rest, done = np.flatnonzero((lengths > 8) & (lengths <= LONG_WORD)), 8
    while len(rest):
        left = lengths[rest] - done
        h[rest] = mix64(h[rest] ^ (eight[starts[rest] + done] & _HEAD[np.minimum(left, 8)]))
        rest, done = rest[left > 8], done + 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[starts[i] : starts[i] + lengths[i]].tobytes())
    return h >> U64(64 - BITS)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, number of words of each text) of texts that lie one after the other."""
    n = len(data)
    low = np.zeros(n + 8, np.uint8)
    np.add(data, ((data - np.uint8(65)) < 26).view(np.uint8) << np.uint8(5), out=low[:n])
    word = (data != 32) & ((data - np.uint8(9)) > 4)
    edge = np.zeros(n + 1, bool)  # texts begin and end here
    edge[offsets] = True
    turn = word[1:] != word[:-1]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= turn | edge[1:n]
    ends[:-1] &= turn | edge[1:n]
    starts = np.flatnonzero(begins)
    return word_hashes(low, starts, np.flatnonzero(ends) + 1 - starts), np.diff(np.searchsorted(starts, offsets))


def long_text(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``words_of`` one text, READ_BYTES at a time: cuts are at white space."""
    out, at = [], 0
    while at < len(data):
        cut = SPACE.search(data, at + READ_BYTES)
        end = cut.start() if cut else len(data)
        out.append(words_of(data[at:end], np.array([0, end - at]))[0])
        at = end
    return np.concatenate(out), np.array([sum(len(x) for x in out)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of the texts) of a column, null as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8), np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]


def token_blocks(frames, size: int):
    """(texts, tokens, lengths): whole texts as token hashes, each with its end; texts of one frame."""
    for frame in frames:
        data, offsets = text_bytes(frame.column("text"))
        held, total, first, at = [], 0, 0, 0
        while at < len(offsets) - 1:
            last = max(at + 1, int(np.searchsorted(offsets, offsets[at] + READ_BYTES, "right")) - 1)
            part, ends = data[offsets[at] : offsets[last]], offsets[at : last + 1] - offsets[at]
            words, n = long_text(part) if len(part) > READ_BYTES else words_of(part, ends)
            tokens = np.full(len(words) + len(n), END, dtype=U64)
            tokens[np.arange(len(words)) + np.repeat(np.arange(len(n)), n)] = words
            held.append((tokens, n + 1))
            total, at = total + len(tokens), last
            if total >= size or at == len(offsets) - 1:
                yield frame, first, *(np.concatenate(x) for x in zip(*held))
                held, total, first = [], 0, at


def contexts(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.cumsum(lengths) - lengths] = START
    return out


def grams(tokens: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """The gram that ends at each token, as one array per place."""
    out = [tokens]
    while len(out) < order:
        out.insert(0, contexts(out[0], lengths))
    return out


def _gathered(frames, size: int):
    """Texts of several frames joined until they hold ``size`` tokens; what is yielded is not held here."""
    held, total = [], 0
    for _, _, *block in token_blocks(frames, 1):
        held.append(block)
        total += len(block[0])
        del block
        if total >= size:
            yield tuple(np.concatenate(c) for c in zip(*(held.pop(0) for _ in range(len(held)))))
            total = 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*(held.pop(0) for _ in range(len(held)))))


def _blobs(rows, kind: int):
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(rows), pa.int32()), pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["kind", "bucket", "blob"])


BLOBS = "kind int, bucket int, blob binary"
KIND_WORDS, KIND_CONTEXT, KIND_LEFT, KIND_COUNTS = range(4)


def heavy_contexts(texts: DataFrame, order: int) -> tuple[int, dict[int, np.ndarray]]:
    """(about how many tokens, by order the sorted keys of the frequent contexts), from every HEAVY_STEP-th text."""

    def local(frames):
        for tokens, lengths in _gathered(frames, COUNT_CHUNK):
            words = grams(tokens, lengths, order)
            rows = [(0, 0, len(tokens))]
            for n in range(2, order + 1):
                h = np.sort(gram_keys(words[-n:])[0])
                first = np.flatnonzero(starts_of(h))
                h, c = h[first], np.diff(first, append=len(h))
                often = c * HEAVY_SHARE >= len(tokens)
                rows += zip([n] * int(often.sum()), h[often].view(np.int64).tolist(), c[often].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["order", "h", "c"])

    some = texts.where(F.monotonically_increasing_id() % HEAVY_STEP == 0)
    found = some.mapInArrow(local, "order long, h long, c long").groupBy("order", "h").agg(F.sum("c").alias("c"))
    total = F.max(F.when(F.col("order") == 0, F.col("c"))).over(W.partitionBy())
    top = found.withColumn("total", total).where((F.col("order") == 0) | (F.col("c") * HEAVY_SHARE >= F.col("total"))).toPandas()  # HEAVY_SHARE rows per order at most
    n = int(top["c"][top["order"] == 0].sum())
    return n * HEAVY_STEP, {k: np.sort(top["h"][top["order"] == k].to_numpy(dtype=np.int64).view(U64)) for k in range(2, order + 1)}


def _held(frames):
    """(words of each place, counts, bucket) of all grams of a task that holds one bucket."""
    held, bucket = [], 0
    for frame in frames:
        for b, blob in zip(frame.column("bucket").to_pylist(), frame.column("blob")):
            bucket = b
            held.append(unpack_grams(blob.as_py()))
    if not held:
        return None, None, bucket
    return [np.concatenate(x) for x in zip(*(w for w, _ in held))], np.concatenate([c for _, c in held]).astype(np.int64), bucket


def _local_path(uri: str) -> str | None:
    p = urlparse(uri)
    return p.path if p.scheme in ("", "file") else None


def write_file(uri: str, data: list[np.ndarray]) -> None:
    """Written under another name, then renamed: a retried task replaces the same content."""
    local = _local_path(uri)
    if local:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        tmp = f"{local}.{os.getpid()}.{os.urandom(4).hex()}"
        with open(tmp, "wb") as f:
            for a in data:
                f.write(np.ascontiguousarray(a).tobytes())
                f.write(b"\0" * (-a.nbytes % 8))
        os.replace(tmp, local)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(os.path.dirname(path), recursive=True)
        tmp = f"{path}.{os.urandom(4).hex()}"
        with store.open_output_stream(tmp) as f:
            for a in data:
                f.write(np.ascontiguousarray(a).tobytes())
                f.write(b"\0" * (-a.nbytes % 8))
        store.move(tmp, path)


_FETCHED: OrderedDict[str, np.ndarray] = OrderedDict()


def _fetched(uri: str) -> np.ndarray | None:
    """A segment that lies on no local path, in an anonymous memory map; the oldest ones go beyond HELD_BYTES."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        return None
    held = mmap.mmap(-1, max(1, info.size))
    with store.open_input_stream(path) as f:
        while part := f.read(1 << 24):
            held.write(part)
    while _FETCHED and sum(a.nbytes for a in _FETCHED.values()) + info.size > HELD_BYTES:
        _FETCHED.popitem(last=False)
    return np.frombuffer(held, np.uint8, info.size)


def mapped(uri: str) -> np.ndarray | None:
    """The file as memory-mapped bytes; None where there is no such segment."""
    if uri in _FETCHED:
        _FETCHED.move_to_end(uri)
        return _FETCHED[uri]
    local = _local_path(uri)
    if not local:
        raw = _fetched(uri)
    elif not os.path.exists(local):
        return None
    else:
        raw = np.memmap(local, np.uint8, mode="r")
        while len(_FETCHED) >= 10_000:  # maps, not memory, are what is short here
            _FETCHED.popitem(last=False)
    if raw is not None:
        _FETCHED[uri] = raw
    return raw


def _arrays(raw: np.ndarray, kinds: list[tuple[str, int]], at: int = 0) -> list[np.ndarray]:
    out = []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize * n
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


def _keyed(key: np.ndarray) -> list[np.ndarray]:
    """Sorted 64-bit keys by their first 48 bits: where each value of the first 16 begins, and the next 32."""
    top = np.append(np.searchsorted(key >> U64(48), np.arange(65536, dtype=U64)), len(key))
    return [top.astype(np.uint32), ((key >> U64(16)) & U64(0xFFFFFFFF)).astype(np.uint32)]


def write_segment(uri: str, key: np.ndarray, columns: list[np.ndarray]) -> None:
    """Sorted distinct keys with their counts. Keys that were counted once, most of them, are kept apart without counts;
    counts above 255 stand in a list of their own."""
    once = columns[0] == 1
    many = [x[~once] for x in columns]
    over = np.flatnonzero(many[0] > 255)
    sizes = np.array([int(once.sum()), len(many[0]), len(over)], np.int64)
    write_file(uri, [sizes, *_keyed(key[once]), *_keyed(key[~once]), *(np.minimum(x, 255).astype(np.uint8) for x in many), over.astype(np.int64), *(x[over] for x in many)])


def first_grams(texts: DataFrame, parts: int, heavy, order: int) -> DataFrame:
    """Packed counts of the grams of the highest order, one or more per task."""

    def local(frames):
        for tokens, lengths in _gathered(frames, COUNT_CHUNK):
            n = len(tokens)
            pieces = list(_pieces(grams(tokens, lengths, order), -(-n // -(-n // (COUNT_CHUNK * 5 // 4)))))  # equal ones: a text of its own may be longer than a chunk
            del tokens, lengths
            while pieces:
                yield from counted(pieces.pop(0))

    def counted(piece):
        n = len(piece[-1])
        before = [w[0] for w in piece[:-1]]  # words before the piece, and start marks
        uniq, _, at = distinct(np.concatenate([piece[-1], np.array([*before, START], U64)]), BITS)
        if len(uniq) >> ID_BITS:  # too many different words to number them
            for half in _pieces(piece, n // 2 + 1):
                yield from counted(half)
            return
        ids, start = [at[:n]], at[-1]
        for w, x in zip(reversed(piece[:-1]), reversed(at[n:-1])):
            ids.insert(0, np.where(w == U64(START), start, np.append(x, ids[0][:-1])))
        del piece, at, w, x
        ids, c = distinct_grams(ids)
        context, key = gram_keys([uniq[i] for i in ids])
        yield _blobs(packed_grams(uniq, ids, c, context, key, heavy.value[order], parts), KIND_LEFT)

    return texts.mapInArrow(local, BLOBS)


def merge_grams(packed: DataFrame, parts: int, heavy, order: int, path: str, top: bool) -> DataFrame:
    """Writes the segments of one order; returns the packed grams of the order below (words: left-neighbour
    counts), the parts of frequent contexts, counts of counts, and from the highest order the counts of words."""

    def merge(frames):
        words, counts, bucket = _held(frames)
        if words is None:
            return
        context, key = gram_keys(words)
        at, key = sorting(key)
        first = np.flatnonzero(starts_of(key))
        c = np.add.reduceat(counts[at], first)
        del counts
        key, at = key[first], at[first]
        words, context = [w[at] for w in words], context[at]
        write_segment(f"{path}/grams-{order}-{bucket}", key, [c])
        h, *sums = key_sum(context, c, c == 1, c == 2, c >= 3)
        hot = among(heavy.value[order], h)
        write_segment(f"{path}/contexts-{order}-{bucket}", h[~hot], [x[~hot] for x in sums])
        if hot.any():
            ctx = np.zeros(int(hot.sum()), CONTEXT)
            for name, x in zip(CONTEXT.names, (h, *sums)):
                ctx[name] = x[hot]
            yield _blobs([(bucket, pack_records(ctx))], KIND_CONTEXT)
        yield _blobs([(0, np.bincount(np.minimum(c, 5), minlength=6).astype(np.int64).tobytes())], KIND_COUNTS)

        def word_counts(n, kind):
            h, n = key_sum(words[-1], n, bits=BITS)
            out = np.zeros(len(h), WORD)
            out["h"], out["c"] = h, n
            return _blobs(cut_by_bucket(out, word_bucket(h, parts), parts), kind)

        if top:
            yield word_counts(c, KIND_WORDS)
        if order == 2:
            yield word_counts(np.ones(len(c), np.int64), KIND_LEFT)
        else:
            n, words = np.where(words[1] == U64(START), c, 1), words[1:]
            del c, at, first
            context, key = gram_keys(words)
            at, key = sorting(key)
            first = np.flatnonzero(starts_of(key))
            n, at, key = np.add.reduceat(n[at], first), at[first], key[first]
            words = [w[at] for w in words]
            uniq, ids = numbered(words)
            by, _ = sorting(ids[-2].astype(U64), 32)
            ids, n, context, key = [x[by] for x in ids], n[by], context[at[by]], key[by]
            yield _blobs(packed_grams(uniq, ids, n, context, key, heavy.value[order - 1], parts), KIND_LEFT)

    return packed.repartitionById(parts, "bucket").mapInArrow(lean(merge), BLOBS)


def frequent_sums(table: DataFrame) -> tuple[np.ndarray, ...]:
    """Keys (sorted) and sums of the frequent contexts, whose grams lie in several tasks."""

    def rows(frames):
        for frame in frames:
            for blob in frame.column("blob"):
                r = unpack_records(blob.as_py(), CONTEXT)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(r[x]).astype(np.uint64).view(np.int64)) for x in CONTEXT.names], names=list(CONTEXT.names))

    names = CONTEXT.names[1:]
    got = table.where(F.col("kind") == KIND_CONTEXT).mapInArrow(rows, ", ".join(f"{x} long" for x in CONTEXT.names)).groupBy("h").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    h = got["h"].to_numpy(dtype=np.int64).view(U64)
    at = np.argsort(h)
    return (h[at], *(got[x].to_numpy(dtype=np.int64)[at] for x in names))


def _counts(table: DataFrame) -> np.ndarray:
    """Counts of counts 0..4 and 5+, summed over the tasks (one short row each)."""
    rows = table.where(F.col("kind") == KIND_COUNTS).select("blob").collect()
    return sum((np.frombuffer(r[0], np.int64) for r in rows), np.zeros(6, np.int64))


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from counts of counts; 0.5, 1, 1.5 where these are too few to tell."""
    if (n[1:5] == 0).any():
        return 0.5, 1.0, 1.5
    y = n[1] / (n[1] + 2 * n[2])
    found = [j - (j + 1) * y * n[j + 1] / n[j] for j in (1, 2, 3)]
    return tuple(float(min(max(d, 0.05), j)) for j, d in zip((1, 2, 3), found))


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0)


def write_words(blobs: DataFrame, parts: int, path: str) -> DataFrame:
    """Writes the word segments; returns counts of left-neighbour counts."""

    def merge(frames):
        held: dict[int, list] = {KIND_WORDS: [], KIND_LEFT: []}
        bucket = 0
        for frame in frames:
            for k, b, blob in zip(frame.column("kind").to_pylist(), frame.column("bucket").to_pylist(), frame.column("blob")):
                bucket = b
                held[k].append(unpack_records(blob.as_py(), WORD))
        if not any(held.values()):
            return
        words, left = (np.concatenate(held[k]) if held[k] else np.zeros(0, WORD) for k in (KIND_WORDS, KIND_LEFT))
        h = np.unique(words["h"])
        out = {k: np.zeros(len(h), np.int64) for k in ("c", "left")}
        np.add.at(out["c"], np.searchsorted(h, words["h"]), words["c"].astype(np.int64))
        np.add.at(out["left"], np.searchsorted(h, left["h"]), left["c"].astype(np.int64))
        write_file(f"{path}/words-{bucket}", [np.array([len(h)], np.int64), h, out["c"], out["left"]])
        yield _blobs([(0, np.append(np.bincount(np.minimum(out["left"], 5), minlength=6), [out["left"].sum(), out["c"].sum(), len(h)]).astype(np.int64).tobytes())], KIND_COUNTS)

    return blobs.repartitionById(parts, "bucket").mapInArrow(merge, BLOBS)


def train(spark: SparkSession, texts: DataFrame, order: int = ORDER) -> dict:
    """``texts(text)`` -> the description of a model whose segments lie in the shared folder."""
    if order < 2:
        raise ValueError("order must be at least 2")
    about, hot = heavy_contexts(texts, order)
    parts, path = max(1, -(-about // BUCKET_TOKENS)), new_path(spark, "lm")
    heavy = spark.sparkContext.broadcast(hot)
    packed, held, words = first_grams(texts, parts, heavy, order), None, None
    d, sums = {}, {}
    for n in range(order, 1, -1):
        stats = materialize(spark, merge_grams(packed, parts, heavy, n, path, n == order), f"lm-stats-{n}")
        if n == order:
            words = stats.where(F.col("kind") == KIND_WORDS)
            first = stats
        packed = stats.where(F.col("kind") == KIND_LEFT)
        d[n], sums[n] = discounts(_counts(stats)), frequent_sums(stats)
        if held is not None and held is not first:
            release(spark, held)
        held = stats
    rest = materialize(spark, write_words(words.union(packed), parts, path), "lm-done")
    rows = [np.frombuffer(r[0], np.int64) for r in rest.select("blob").collect()]
    total = sum(rows, np.zeros(9, np.int64))
    n = total[:6]
    d[1] = discounts(n)
    types, tokens, distinct = (int(x) for x in total[6:])
    low = (d[1][0] * n[1] + d[1][1] * n[2] + d[1][2] * (n[3] + n[4] + n[5])) / types if types else 1.0
    release(spark, held, first, rest)
    return {"path": path, "parts": parts, "order": order, "tokens": tokens, "distinct": distinct, "heavy": hot, "sums": sums, "d": d, "types": types, "low": low}


def _by_bucket(bucket: np.ndarray, parts: int):
    """(bucket, its rows) in order."""
    order = by_number(bucket, parts)
    cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        yield b, order[cuts[b] : cuts[b + 1]]


def _word_lookup(model: dict, h: np.ndarray) -> list[np.ndarray]:
    """c, left of sorted distinct word hashes (zeros where unknown)."""
    out = [np.zeros(len(h), np.int64) for _ in range(2)]
    for b, rows in _by_bucket(word_bucket(h, model["parts"]), model["parts"]):
        raw = mapped(f"{model['path']}/words-{b}")
        if raw is None:
            continue
        n = int(raw[:8].view(np.int64)[0])
        keys, *cols = _arrays(raw, [("<u8", n), ("<i8", n), ("<i8", n)], 8)
        if not n:
            continue
        at = np.minimum(np.searchsorted(keys, h[rows]), n - 1)
        hit = keys[at] == h[rows]
        for o, c in zip(out, cols):
            o[rows] = np.where(hit, c[at], 0)
    return out


def _search(top: np.ndarray, low: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Binary search of all keys at once: their places, and whether they are there."""
    n = len(low)
    if not n or not len(head):
        return np.zeros(len(head), np.int64), np.zeros(len(head), bool)
    lo, end = top[head].astype(np.int64), top[head + 1].astype(np.int64)
    span, at = end - lo, lo.copy()
    while (widest := int(span.max())) > 0:
        half = span >> 1
        mid = at + half
        less = (low[np.minimum(mid, n - 1)] < tail) & (span > 0)
        at = np.where(less, mid + 1, at)
        span = np.where(less, span - half - 1, half)
        if widest == 1:
            break
    found = np.minimum(at, n - 1)
    return found, (at < end) & (low[found] == tail)


def _segment_lookup(model: dict, kind: str, width: int, bucket: np.ndarray, key: np.ndarray) -> list[np.ndarray]:
    """``width`` columns of distinct keys (zeros where unknown); keys rise, so each segment is read in order."""
    out = [np.zeros(len(key), np.int64) for _ in range(width)]
    for b, rows in _by_bucket(bucket, model["parts"]):
        raw = mapped(f"{model['path']}/{kind}-{b}")
        if raw is None:
            continue
        once, many, over = raw[:24].view(np.int64).tolist()
        top1, low1, top, low, *rest = _arrays(raw, [("<u4", 65537), ("<u4", once), ("<u4", 65537), ("<u4", many), *[("u1", many)] * width, *[("<i8", over)] * (width + 1)], 24)
        small, at_over, large = rest[:width], rest[width], rest[width + 1 :]
        k = key[rows]
        head, tail = (k >> U64(48)).astype(np.int64), ((k >> U64(16)) & U64(0xFFFFFFFF)).astype(np.uint32)
        _, single = _search(top1, low1, head, tail)
        for o in out[:2]:  # counted once: a count of 1, and for a context one word of that count
            o[rows[single]] = 1
        left = np.flatnonzero(~single)
        at, hit = _search(top, low, head[left], tail[left])
        at, left = at[hit], left[hit]
        big = np.flatnonzero(small[0][at] == 255) if over else np.zeros(0, int)
        j = np.minimum(np.searchsorted(at_over, at[big]), over - 1)
        listed = at_over[j] == at[big] if len(big) else np.zeros(0, bool)
        for o, s, x in zip(out, small, large):
            c = s[at].astype(np.int64)
            c[big[listed]] = x[j[listed]]
            o[rows[left]] = c
    return out


def probabilities(model: dict, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p(w | context), training count of w, base log10) for each position; ``words`` as of ``grams``."""
    uniq, _, at_w = distinct(words[-1], BITS)
    c, left = _word_lookup(model, uniq)
    p = ((discounted(left, model["d"][1])) / max(model["types"], 1) + model["low"] / (model["distinct"] + 1))[at_w]
    base = np.log10((c + ADD) / (model["tokens"] + ADD * (model["distinct"] + 1)))
    for n in range(2, model["order"] + 1):
        heavy, d = model["heavy"][n], model["d"][n]
        context, key = gram_keys(words[-n:])
        u, _, at = distinct(context)
        sums = _segment_lookup(model, f"contexts-{n}", 4, word_bucket(u >> U64(64 - BITS), model["parts"]), u)
        hot, *known = model["sums"][n]
        hit = among(hot, u)
        for s, x in zip(sums, known):
            s[hit] = x[np.searchsorted(hot, u[hit])]
        total = sums[0][at]
        back = (sum(x * s for x, s in zip(d, sums[1:])) / np.maximum(sums[0], 1))[at]
        k, first, at = distinct(key)
        (count,) = _segment_lookup(model, f"grams-{n}", 1, gram_bucket(context[first], k, heavy, model["parts"]), k)
        p = np.where(total > 0, discounted(count, d)[at] / np.maximum(total, 1) + back * p, p)
    return p, c[at_w], base[at_w]


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: dict) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, n_tokens, n_known, base_score, score), whole texts."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(frames):
        m = held.value
        for frame, first, tokens, lengths in token_blocks(frames, SCORE_CHUNK):
            p, c, base = (np.concatenate(x) for x in zip(*(probabilities(m, part) for part in _pieces(grams(tokens, lengths, m["order"])))))
            starts = np.cumsum(lengths) - lengths
            yield pa.RecordBatch.from_arrays(
                [frame.column("doc_id").slice(first, len(lengths)), pa.array(lengths.astype(np.int64)), pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)), pa.array(np.add.reduceat(base, starts)), pa.array(np.add.reduceat(np.log10(p), starts))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCORES)


def _pieces(words: list[np.ndarray], size: int = 1_000_000):
    for i in range(0, len(words[-1]), size):
        yield [w[i : i + size] for w in words]


def held_out_rule(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def op1_query(spark: SparkSession, sf_dir: str, order: int = 2) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(spark, docs.where(~held_out_rule(F.col("doc_id"))).select("text"), order)
    out = score(docs, model)
    return out.select("doc_id", held_out_rule(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def op1_registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_query(spark, sf_dir, ORDER)
