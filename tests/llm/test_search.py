"""Exact top-k search: repeated ids, ties, and how little is resolved."""

from collections import Counter

import duckdb
import numpy as np

from arborspark.llm import exact_topk

KIND = "vec_id long, embedding array<double>"


def brute(rows, modulus, k):
    good = [(i, np.floor(np.array(v) * 256)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and i is not None]
    out = Counter()
    for a, (i, x) in enumerate(good):
        if i % modulus == 0:
            best = sorted((-int(x @ y), j) for b, (j, y) in enumerate(good) if a != b and len(x) == len(y))[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(best))
    return out


def test_repeated_ids_and_ties(spark):
    rng = np.random.default_rng(5)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.5, 0.0])]
    assert Counter(map(tuple, exact_topk.top_k(spark, spark.createDataFrame(rows, KIND), 50, 5).collect())) == brute(rows, 50, 5)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 200, 700), rng.integers(-2, 3, (700, 6)))]  # many ties at rank k, repeated ids and rows
    rows += rows[:30] + [(10, [1.0] * 3), (20, [2.0] * 3), (None, [1.0] * 6), (30, None), (40, []), (50, [None] * 6)]
    want = brute(rows, 10, 5)
    got = Counter(map(tuple, exact_topk.top_k(spark, spark.createDataFrame(rows, KIND).repartition(5), 10, 5).collect()))
    assert got == want


def test_waves(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "WAVE", 7)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(300, 16)))]
    assert Counter(map(tuple, exact_topk.top_k(spark, spark.createDataFrame(rows, KIND), 10, 3).collect())) == brute(rows, 10, 3)


def test_no_whole_score_before_the_cutoff_and_few_after_it():
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(20_000, 64)) / 8 * 256)
    x, q = exact_topk.fitting(x, x[:200])
    assert x.dtype == np.float32
    row = np.arange(len(x))
    own = np.stack([row[:200], row[:200]], axis=1)
    first = exact_topk.gathered(row, row, x, own, q, 5)
    assert len(first[0]) <= 200 * exact_topk.LISTS * 6
    best = exact_topk._held_best(None, first, 5)
    cut = best[1].reshape(200, 5).min(axis=1)
    found, resolved = exact_topk.sufficient(row, row, x, own, q, cut)
    assert resolved < 0.01 * 200 * len(x)
    scores = x @ q.T
    scores[row[:200], row[:200]] = -np.inf
    assert np.array_equal(np.sort(exact_topk._held_best(None, found, 5)[1].reshape(200, 5)), np.sort(np.sort(scores.T)[:, -5:]))


def test_sql_on_repeated_ids(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(rng.integers(0, 120, 200), rng.normal(size=(200, 8)))]
    table = spark.createDataFrame(rows, KIND)
    c = duckdb.connect()
    embeddings = table.toPandas()  # noqa: F841
    want = Counter(c.execute(exact_topk.OP3_SQL).fetchall())
    assert Counter(map(tuple, exact_topk.top_k(spark, table).collect())) == want
