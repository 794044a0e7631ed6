"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text's ASCII letters are lower-cased, bytes of other letters kept and all else becomes a space.
Subwords are the 2-, 3- and 4-grams of bytes that result; each is hashed to one of ``BUCKETS`` rows
of an embedding matrix, and the mean of the rows goes through a linear softmax. Both are trained by
stochastic gradient descent in numpy on snippets of a hash sample: of every language about ``PER_LANGUAGE``
labelled documents, fewer where there are so many languages that ``SAMPLE`` rows would not do (but
``LEAST`` of each at least), which bounds the driver's work. No language and no document is left out by
rule; of a text above ``MAX_BYTES`` bytes, slices from its start, middle and end are the sample's text.
Prediction is linear in the rows, so it uses one row of class scores per bucket and reads whole
texts in blocks, in bounded memory.

A fifth of each language's sample calibrates: a temperature that minimizes log loss of whole texts, and the
rejection bound. Its answers, right and wrong, and those on their texts with shuffled bytes (which are in no
language), give the least confidence from which on at most ``ERROR`` of the answers are wrong; the bound is
that, but no more than ``LOST`` of the right answers may fall below it. ``rejected`` marks texts below it and texts
without a letter.

A null text, or one without a letter, gets ``und`` with score 0. Null langs are not learned from.
With no labelled row at all, every text is ``und``. Rows with a null or repeated doc_id are
predicted like any other; they count as doc_id text "" for the held-out rule. Further columns stay out of
the query; ``predict`` keeps them, those named like an added one as ``_<name>_given``. An empty table
gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from arborspark.llm.common import lean, materialize, release, utf8_rows

BUCKETS, DIM, GRAMS = 1 << 16, 16, (2, 3, 4)
PER_LANGUAGE, SAMPLE, LEAST, MAX_BYTES, SLICE = 1200, 48_000, 8, 20_000, 5_000
SNIPPETS, EPOCHS, RATE = 3, 5, 4.0
ERROR, LOST = 0.005, 0.0005
BLOCK = 1 << 18

_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: bytes) -> np.ndarray:
    return np.frombuffer(b"  " + text.translate(_FOLD) + b"   ", dtype=np.uint8)


def gram_buckets(block: np.ndarray) -> np.ndarray:
    """(len(GRAMS), n - 3) hashed subwords that start at each byte of a block with 3 bytes of margin."""
    b = block.astype(np.uint32)
    n = len(b) - 3
    two = b[:n] | b[1 : n + 1] << np.uint32(8)
    three = two | b[2 : n + 2] << np.uint32(16)
    four = three | b[3 : n + 3] << np.uint32(24)
    return np.stack([(g * np.uint32(m)) >> np.uint32(16) for g, m in ((two, 0x9E3779B1), (three, 0x85EBCA77), (four, 0xC2B2AE3D))])


def mean_scores(texts: list[bytes], scores: np.ndarray) -> np.ndarray:
    """Mean class scores of each whole text. Short texts share a block; long ones take several."""
    out = np.zeros((len(texts), scores.shape[1]))
    total = np.zeros(len(texts))
    held, owner, size = [], [], 0

    def flush():
        nonlocal held, owner, size
        if held:
            block = np.concatenate(held)
            starts = np.concatenate(([0], np.cumsum([len(h) for h in held])[:-1]))
            grams = gram_buckets(np.append(block, np.full(3, 32, np.uint8)))
            for row in grams:
                np.add.at(out, owner, np.add.reduceat(scores[row], starts, axis=0))
            np.add.at(total, owner, [len(GRAMS) * len(h) for h in held])
        held, owner, size = [], [], 0

    for i, text in enumerate(texts):
        data = folded(text)
        for at in range(0, len(data), BLOCK):
            part = data[at : at + BLOCK]
            held.append(part), owner.append(i)
            size += len(part)
            if size >= BLOCK:
                flush()
    flush()
    return out / np.maximum(total, 1)[:, None]


def train(texts: list[bytes], langs: list[str], seed: int = 7) -> dict:
    """Fit on labelled texts; returns classes, per-bucket scores, temperature and rejection bound."""
    classes = sorted(set(langs))
    y = np.searchsorted(np.array(classes), langs)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    order = order[np.argsort(y[order], kind="stable")]
    nth = np.arange(len(order)) - np.searchsorted(y[order], y[order])
    valid, fit = order[nth % 5 == 4], order[nth % 5 != 4]  # of each language
    examples = []
    for i in fit:
        data = folded(texts[i])
        for _ in range(SNIPPETS):
            n = int(rng.choice((24, 60, 150, 400)))
            at = int(rng.integers(0, max(1, len(data) - n)))
            part = data[at : at + n]
            if len(part) > 4:
                examples.append((gram_buckets(part).ravel(), y[i]))
    rows = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, len(classes)))
    steps, done = max(1, EPOCHS * len(examples)), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(examples)):
            grams, label = examples[k]
            mean = rows[grams].mean(axis=0)
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            rate = RATE * (1 - done / steps)
            pull = out @ p
            out -= 0.1 * rate * np.outer(mean, p)
            rows[grams] -= rate * pull / np.sqrt(len(grams))
            done += 1
    scores = (rows @ out).astype(np.float32)
    model = {"classes": classes, "scores": scores, "temperature": 1.0, "bound": 0.0}
    if len(valid):
        z, label = mean_scores([texts[i] for i in valid], scores), y[valid]
        loss = {t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), label], 1e-12)).mean() for t in np.geomspace(0.05, 20, 60)}
        model["temperature"] = min(loss, key=loss.get)
        p = softmax(z / model["temperature"])
        noise = [bytes(rng.permutation(np.frombuffer(texts[i], np.uint8))) for i in valid]
        q = softmax(mean_scores(noise, scores) / model["temperature"]).max(axis=1)
        model["bound"] = rejection_bound(p.max(axis=1), p.argmax(axis=1) == label, q)
    return model


def rejection_bound(confidence: np.ndarray, right: np.ndarray, noise: np.ndarray) -> float:
    """The least confidence from which on at most ERROR of all answers are wrong, but LOST of the right ones stay below at most."""
    if not right.any():
        return 0.0
    c, wrong = np.concatenate([confidence, noise]), np.concatenate([~right, np.ones(len(noise), bool)])
    order = np.argsort(-c, kind="stable")
    c, share = c[order], np.cumsum(wrong[order]) / np.arange(1, len(c) + 1)
    last = np.append(c[1:] != c[:-1], True)
    good = np.flatnonzero(last & (share <= ERROR))
    least = c[good[-1]] if len(good) else c[0]
    return float(min(least, np.quantile(confidence[right], LOST)))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out_rule(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(labelled: DataFrame) -> tuple[list[bytes], list[str]]:
    """A hash sample of (text, lang) for the driver: of each language about as many rows as the docstring says."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = materialize(labelled.sparkSession, rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "lang-counts")
    each = max(LEAST, min(PER_LANGUAGE, SAMPLE // max(1, counts.count())))
    share = counts.select(F.col("lang").alias("_lang"), F.least(F.lit(1 << 30), F.lit(float(each << 30)) / F.col("_n")).cast("long").alias("_share"))
    n, mid = F.char_length("text"), F.lit(SLICE // 2)
    slices = F.concat_ws(" ", F.substring("text", 1, SLICE), F.substr("text", (n / 2).cast("int") - mid, F.lit(SLICE)), F.substr("text", n - SLICE, F.lit(SLICE)))
    text = F.when(F.octet_length("text") <= MAX_BYTES, F.col("text")).otherwise(slices)
    picked = F.xxhash64("doc_id", "text", F.lit(11)).bitwiseAND((1 << 30) - 1)
    got = rows.withColumn("_h", picked).join(share, F.col("lang") == F.col("_lang")).where(F.col("_h") < F.col("_share")).select(text.alias("text"), "lang", "_h").toPandas()
    got = got.sort_values(["_h", "lang", "text"])
    release(labelled.sparkSession, counts)
    return [t.encode() for t in got["text"]], list(got["lang"])


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """Adds lang_pred, score and rejected to every row of ``docs`` (columns kept; ``text`` is read)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    names = ("lang_pred", "score", "rejected")
    clash = {c: f"_{c}_given" for c in docs.columns if c in names}
    rows = docs.withColumnsRenamed(clash) if clash else docs
    schema = StructType([*rows.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())])

    def run(frames):
        m = held.value
        for frame in frames:
            texts = list(utf8_rows(frame.column("text")))
            letters = [bool(t) and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
            lang, score, out = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = np.flatnonzero(letters)
            if m and len(at):
                p = softmax(mean_scores([texts[i] for i in at], m["scores"]) / m["temperature"])
                score[at], out[at] = p.max(axis=1), p.max(axis=1) < m["bound"]
                for i, c in zip(at, p.argmax(axis=1)):
                    lang[i] = m["classes"][c]
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(out)], names=[*frame.schema.names, *names])

    return rows.mapInArrow(lean(run), schema)


def fit(docs: DataFrame) -> dict | None:
    """Train on the documents that the held-out rule leaves for learning."""
    texts, langs = sample(docs.select("doc_id", "text", "lang").where(~held_out_rule(F.col("doc_id"))))
    return train(texts, langs) if texts else None


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit(docs)).select("doc_id", "lang_pred", "score", "rejected")
    return out.withColumn("held_out", held_out_rule(F.col("doc_id")))
