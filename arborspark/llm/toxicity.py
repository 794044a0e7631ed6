"""Toxicity by a classifier chain of linear models over hashed words.

The categories of a label table are predicted in order; the probability of each earlier category is
a feature of every later model. For training, those probabilities come from models that did not see
the row (out of fold), so a later model meets them as they will be in use.

Words are letters between white space after punctuation is stripped, lower-cased, hashed to
``BUCKETS``. Near copies among all labelled documents count once, so a copied text does not look like
evidence for its rare words: a row is a copy if ``AGREE`` of ``SIGNS`` minimum hashes of its five-word
shingles equal those of the smallest row that shares a band of them. A model keeps the words whose
presence has a log-likelihood ratio of at least ``EVIDENCE`` (at most ``FEATURES`` words), counted in
Spark over all labelled documents, plus shape features (length, share of capitals, digits and marks), and
is fitted by Newton steps with a ridge. Only the categories in ``SHAPED`` see the shapes. Its decision
bound maximizes the F1 score of the out-of-fold probabilities; words are chosen per fold as well.

The weights are fitted on a hash sample of about ``MAX_TRAIN`` labelled documents that are no copies, of
which the driver holds the presence of chosen words only; scoring reads whole texts. A null text is
empty. Documents without a label are scored like others; a label row that repeats a doc_id counts with
its largest label; labels other than 0 and 1 are left out. Without labels every probability is 0. Rows
with null or repeated ids are scored as rows of their own; in training, rows with a null id are
left out, and rows that repeat both id and text count each. An empty table gives an empty table; a
very long text is read whole, by words and, for its minimum hashes, in pieces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from arborspark.llm.common import cut_by_bucket, lean, materialize, release, run_sum, shuffle_partitions, unpack_records, utf8_rows

BUCKETS, FEATURES, EVIDENCE, MAX_TRAIN, FOLDS, RIDGE = 1 << 31, 400, 28.0, 16_000, 5, 2.0
SIGNS, BANDS, AGREE, ROWS, COUNT_CHUNK = 18, 6, 13, 1000, 4_000_000
COUNT = np.dtype([("word", "<u4"), ("cell", "<u4"), ("n", "<u4")])
CATEGORIES = ("low_quality", "toxic")
#: Categories that also see shape features; words alone decide the others, so an odd shape is never toxic.
SHAPED = ("low_quality",)
SHAPES = 5
_MARKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))


class WordBucket(dict):
    """word bytes (lower case, marks around it) -> bucket; cleared at ``limit`` words."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.strip(_MARKS)) & (BUCKETS - 1)
        return h


def features(text: bytes, cache: WordBucket) -> tuple[np.ndarray, list[float], list[int]]:
    """Distinct word buckets, shape features, and the word buckets in order of a whole text."""
    if len(cache) > 200_000:
        cache.clear()
    words = text.lower().split()
    ids = np.fromiter(map(cache.__getitem__, words), dtype=np.int64, count=len(words))
    n = max(1, len(text))
    marks = n - len(text.translate(None, _MARKS)) - text.count(b" ")
    shape = [np.log1p(len(words)), (n - len(text.translate(None, _UPPER))) / n, (n - len(text.translate(None, _DIGIT))) / n, marks / n, len(set(words)) / max(1, len(words))]
    return np.unique(ids), shape, ids


_SIGN = np.random.default_rng(41).integers(1 << 62, 1 << 63, (SIGNS, 1)).astype(np.uint64) | np.uint64(1)


def signature(ids: np.ndarray) -> np.ndarray:
    """Minimum of ``SIGNS`` hashes over the five-word shingles; empty without words."""
    if not len(ids):
        return np.zeros(0, np.int32)
    v = ids.astype(np.uint64)
    w = min(5, len(v))
    h = np.zeros(len(v) - w + 1, np.uint64)
    for i in range(w):
        h = h * np.uint64(0x9E3779B97F4A7C15) + v[i : len(v) - w + 1 + i]
    least = np.full(SIGNS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(h), 4096):  # a long text in pieces
        g = (h[i : i + 4096] ^ (h[i : i + 4096] >> np.uint64(31))) * _SIGN
        g ^= g >> np.uint64(29)
        np.minimum(least, (g * np.uint64(0xC4CEB9FE1A85EC53)).min(axis=1), out=least)
    return (least >> np.uint64(16)).astype(np.uint32).view(np.int32)


def g_statistic(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of presence in a of n1 positives against b of n0 negatives."""
    total, n = a + b, n1 + n0
    out = np.zeros(len(a))
    for seen, rows, share in ((a, n1, total), (b, n0, total), (n1 - a, n1, n - total), (n0 - b, n0, n - total)):
        expected = rows * share / n
        out += np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return 2 * out


def dense(sets: list[np.ndarray], words: np.ndarray) -> np.ndarray:
    """(documents, words) presence as 0 or 1; ``words`` is sorted."""
    out = np.zeros((len(sets), len(words)), np.float32)
    if len(words) and len(sets):
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        word = np.concatenate(sets)
        at = np.minimum(np.searchsorted(words, word), len(words) - 1)
        hit = words[at] == word
        out[doc[hit], at[hit]] = 1
    return out


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def best_bound(p: np.ndarray, y: np.ndarray) -> float:
    """The bound with the largest F1, halfway to the next lower probability."""
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    last = np.append(p[order][1:] != p[order][:-1], True)
    at = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][at] + (p[order][at + 1] if at + 1 < len(p) else 0)) / 2)


def train_chain(sets: list[np.ndarray], shapes: np.ndarray, fold: np.ndarray, labels: dict[str, np.ndarray], chosen: dict[tuple[int, int], np.ndarray]) -> dict:
    """``chosen`` has the words of each category without each fold, and at fold ``FOLDS`` those of all rows."""
    mean, scale = shapes.mean(axis=0), np.maximum(shapes.std(axis=0), 0.01)
    shape = np.clip((shapes - mean) / scale, -3, 3)
    earlier = np.zeros((len(sets), 0))
    chain = []
    for k, (name, y) in enumerate(labels.items()):
        known = y >= 0
        extra = np.hstack([shape, earlier]) if name in SHAPED else earlier
        oof = np.zeros(len(sets))
        for f in range(FOLDS + 1):
            x = np.hstack([dense(sets, chosen[k, f]), extra])
            rows, at = known & (fold != f), fold == f
            w = fit_linear(x[rows], y[rows].astype(float))
            oof[at] = linear(x[at], w)
        chain.append({"name": name, "words": chosen[k, FOLDS], "weights": w, "bound": best_bound(oof[known], y[known])})
        earlier = np.hstack([earlier, oof[:, None]])
    return {"mean": mean, "scale": scale, "chain": chain}


def _lists(rows, kind) -> pa.Array:
    """A list column of numpy rows, without Python numbers."""
    ends = np.cumsum([0, *(len(x) for x in rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else [], kind))


def _taken(take, names: list[str]):
    """(doc_id, row, text) -> doc_id, row and the columns that ``take`` makes of (words, shape, ids) lists."""

    def run(frames):
        cache = WordBucket()
        for frame in (whole.slice(i, ROWS) for whole in frames for i in range(0, whole.num_rows, ROWS)):
            rows = [features(text, cache) for text in utf8_rows(frame.column("text"))]
            if rows:
                yield pa.RecordBatch.from_arrays([frame.column("doc_id"), frame.column("row"), *take(rows)], names=["doc_id", "row", *names])

    return lean(run)


def kept_rows(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """``docs(doc_id, row, text)``, ``marks(doc_id, cell)`` -> (doc_id, row, cell, times) of labelled rows, near copies once; a scratch table."""
    spark = docs.sparkSession
    signs = docs.mapInArrow(_taken(lambda rows: [_lists([signature(ids) for _, _, ids in rows], pa.int32())], ["sign"]), "doc_id long, row long, sign array<int>")
    rows = materialize(spark, signs.join(marks, "doc_id"), "toxicity-signs")
    wide = SIGNS // BANDS
    keys = [F.xxhash64(F.lit(b), *(F.col("sign")[b * wide + i] for i in range(wide))) for b in range(BANDS)]
    bands = rows.where("size(sign) > 0").select("row", F.explode(F.array(*keys)).alias("band"))
    first = bands.groupBy("band").agg(F.min("row").alias("first"), F.max("row").alias("last")).where("first < last").select("band", "first")
    pairs = bands.join(first, "band").where("row > first").select("row", "first").distinct()
    signs = rows.select("row", "sign")
    agree = F.aggregate(F.zip_with("sign", "held", lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, x: n + x)
    copies = pairs.join(signs, "row").join(signs.select(F.col("row").alias("first"), F.col("sign").alias("held")), "first").where(agree >= AGREE).select("row").distinct()
    out = materialize(spark, rows.join(copies, "row", "left_anti").groupBy("doc_id", "row", "cell").agg(F.count(F.lit(1)).alias("times")), "toxicity-rows")
    release(spark, rows)
    return out


def choose_words(docs: DataFrame, kept: DataFrame, pos: np.ndarray, neg: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
    """The words of each category without each fold (``FOLDS``: of all rows), counted over all kept rows.

    ``pos`` and ``neg`` hold the rows of each category outside each fold. Tasks count (word, cell) and send
    the counts packed, dealt by word; of every task's words the best ``FEATURES`` go on.
    """
    spark, n_cat = docs.sparkSession, len(pos)
    parts = shuffle_partitions(spark)
    sets = docs.mapInArrow(_taken(lambda rows: [_lists([w.astype(np.int32) for w, _, _ in rows], pa.int32())], ["words"]), "doc_id long, row long, words array<int>")

    def packed(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        out = np.zeros(len(key), COUNT)
        out["word"], out["cell"], out["n"] = key >> 32, key & 0xFFFFFFFF, n
        rows = list(cut_by_bucket(out, (key >> 32) * parts // BUCKETS, parts))
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "blob"])

    def local(frames):
        held, total = [], 0
        for frame in frames:
            words, cell = frame.column("words"), frame.column("cell").to_numpy(zero_copy_only=False).astype(np.int64)
            n = words.value_lengths().to_numpy(zero_copy_only=False)
            held.append((words.flatten().to_numpy(zero_copy_only=False).astype(np.int64) << 32) | np.repeat(cell, n))
            total += len(held[-1])
            if total >= COUNT_CHUNK:
                yield packed(held)
                held, total = [], 0
        if total:
            yield packed(held)

    def merge(frames):
        held = [unpack_records(blob.as_py(), COUNT) for frame in frames for blob in frame.column("blob")]
        if not held:
            return
        held = np.concatenate(held)
        key, n = run_sum((held["word"].astype(np.int64) << 32) | held["cell"], held["n"].astype(np.int64))
        words, at = np.unique(key >> 32, return_inverse=True)
        cell = key & 0xFFFFFFFF
        for k in range(n_cat):
            mark, fold = cell // 3 ** (n_cat - 1 - k) % 3, cell // 3**n_cat
            for f in range(FOLDS + 1):
                if not pos[k, f] or not neg[k, f]:
                    continue
                a, b = (np.bincount(at, n * ((mark == m) & (fold != f)), minlength=len(words)) for m in (2, 1))
                g = g_statistic(a, b, int(pos[k, f]), int(neg[k, f]))
                best = np.argsort(-g, kind="stable")[: int(min(FEATURES, (g >= EVIDENCE).sum()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), k * (FOLDS + 1) + f, np.int32)), pa.array(words[best]), pa.array(g[best])], names=["set", "word", "g"])

    # dealt at every size: a broadcast of the labelled rows would grow with them
    counted = sets.join(kept.hint("merge"), ["doc_id", "row"]).select("words", "cell").mapInArrow(lean(local), "bucket int, blob binary")
    best = materialize(spark, counted.repartitionById(parts, "bucket").mapInArrow(lean(merge), "set int, word long, g double"), "toxicity-words")
    out = {}
    for k in range(n_cat):
        for f in range(FOLDS + 1):
            rows = best.where(F.col("set") == k * (FOLDS + 1) + f).orderBy(F.desc("g"), "word").limit(FEATURES).collect()
            out[k, f] = np.sort(np.array([r["word"] for r in rows], np.int64))
    release(spark, best)
    return out


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES) -> dict:
    """``docs(doc_id, text)`` and ``labels(doc_id, <category> 0/1...)`` -> a model for ``score``."""
    spark, n_cat = docs.sparkSession, len(categories)
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.col(c).cast("int")).alias(c) for c in categories))
    cell = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    for c in categories:  # a digit for the fold, then one per category: 0 unknown, 1 no, 2 yes
        cell = cell * 3 + F.when(F.col(c) == 1, 2).when(F.col(c) == 0, 1).otherwise(0)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    kept = kept_rows(rows, marks.select("doc_id", cell.cast("int").alias("cell")))
    n = np.zeros([FOLDS] + [3] * n_cat, np.int64)
    for r in kept.groupBy("cell").agg(F.sum("times").alias("times")).collect():
        n.reshape(-1)[r["cell"]] = r["times"]
    by_fold = [n.sum(axis=tuple(1 + j for j in range(n_cat) if j != k)) for k in range(n_cat)]
    pos, neg = (np.array([[x[:, m].sum() - (x[f, m] if f < FOLDS else 0) for f in range(FOLDS + 1)] for x in by_fold]) for m in (2, 1))
    none = {"mean": np.zeros(SHAPES), "scale": np.ones(SHAPES), "chain": [{"name": c, "words": np.zeros(0, np.int64), "weights": np.append(np.zeros(i + SHAPES if c in SHAPED else i), -30.0), "bound": 0.5} for i, c in enumerate(categories)]}
    if not pos[:, FOLDS].all() or not neg[:, FOLDS].all():
        release(spark, kept)
        return none
    chosen = choose_words(rows, kept, pos, neg)
    union = np.unique(np.concatenate(list(chosen.values())))
    share = F.xxhash64("doc_id", F.lit(23)).bitwiseAND((1 << 30) - 1) < int((1 << 30) * min(1.0, MAX_TRAIN / n.sum()))
    take = _taken(lambda got: [_lists([w[np.isin(w, union)].astype(np.int32) for w, _, _ in got], pa.int32()), pa.array([s for _, s, _ in got], pa.list_(pa.float64()))], ["words", "shape"])
    sample = rows.where(share).mapInArrow(take, "doc_id long, row long, words array<int>, shape array<double>").join(kept, ["doc_id", "row"])
    got = sample.toPandas().sort_values(["doc_id", "row"], kind="stable")
    release(spark, kept)
    cells = got["cell"].to_numpy(dtype=np.int64)
    marks_of = {c: cells // 3 ** (n_cat - 1 - k) % 3 - 1 for k, c in enumerate(categories)}
    if not len(got) or any(len(set(y[y >= 0])) < 2 for y in marks_of.values()):
        return none
    return train_chain([np.asarray(x, np.int64) for x in got["words"]], np.array(got["shape"].tolist()), cells // 3**n_cat, marks_of, chosen)


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Adds p_<category> and is_<category> for every category to every row (columns kept).

    A given column of such a name is kept as ``_<name>_given``. Names of the added columns come from the model.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = [(f"p_{c['name']}", "double") for c in model["chain"]] + [(f"is_{c['name']}", "boolean") for c in model["chain"]]
    clash = {c: f"_{c}_given" for c in docs.columns if c in dict(added)}
    rows = docs.withColumnsRenamed(clash) if clash else docs
    schema = StructType([*rows.schema.fields, *(StructField(k, BooleanType() if v == "boolean" else DoubleType()) for k, v in added)])

    def run(frames):
        m, cache = held.value, WordBucket()
        for frame in (whole.slice(i, ROWS) for whole in frames for i in range(0, whole.num_rows, ROWS)):
            sets, shapes = [], []
            for text in utf8_rows(frame.column("text")):
                words, shape, _ = features(text, cache)
                sets.append(words), shapes.append(shape)
            shape = np.clip((np.array(shapes).reshape(-1, SHAPES) - m["mean"]) / m["scale"], -3, 3)
            earlier, ps = np.zeros((len(sets), 0)), []
            for c in m["chain"]:
                extra = np.hstack([shape, earlier]) if c["name"] in SHAPED else earlier
                p = linear(np.hstack([dense(sets, c["words"]), extra]), c["weights"])
                ps.append(p)
                earlier = np.hstack([earlier, p[:, None]])
            yes = [p >= c["bound"] for p, c in zip(ps, m["chain"])]
            yield pa.RecordBatch.from_arrays([*frame.columns, *map(pa.array, ps), *map(pa.array, yes)], names=[*frame.schema.names, *(k for k, _ in added)])

    return rows.mapInArrow(lean(run), schema)


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return table.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, fit(docs, label_table(spark, sf_dir)))
    return out.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
