"""Pipeline stages on odd tables; source mixing against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborspark.llm import source_mixing
from tests.llm.test_llm import DOCS, ODD, SF, odd

CLASH = ("score", "p_toxic", "is_toxic", "rejected", "lang_pred", "size", "target", "taken", "_id", "_key", "_tie", "quota", "words", "n", "component_id", "row", "_copy", "a.b")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_with_clashing_columns(spark, docs, name, stage):
    plain = spark.createDataFrame(docs.orderBy("doc_id").limit(60).collect() + ODD, DOCS)
    wide = plain.select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in CLASH))
    got, want = stage(spark, wide, SF), stage(spark, plain, SF)
    if name == "best_fit_packing":
        assert sorted(map(str, got.collect())) != [] and got.count() == want.count()
        return
    assert got.columns == wide.columns and want.columns == plain.columns
    rows = got.collect()
    assert Counter(tuple(r[c] for c in plain.columns) for r in rows) == Counter(map(tuple, want.collect()))
    assert all(r[c] == c + ("?" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for c in CLASH)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage_of_an_empty_table(spark, name, stage):
    got = stage(spark, odd(spark, 0), SF)
    assert got.count() == 0 and (name == "best_fit_packing" or got.columns == odd(spark, 0).columns)


def test_repeated_ids_are_one_document(spark):
    a, b, c = ("p q r s t u v", "k l m n o p q", "unlike the other ones in here")
    rows = [(3, a, "x", None, 1), (5, a, "x", None, 1), (5, b, "x", None, 1), (7, b, "x", None, 1), (9, c, "x", None, 1), (9, c, "y", None, 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), SF)
    assert sorted(map(tuple, got.collect()), key=str) == [(3, a, "x", None, 1), (9, c, "x", None, 1)]


def brute(w, seats):
    a = np.zeros(len(w), int)
    for _ in range(seats):
        a[np.argmax(np.where(w > 0, w / (2 * a + 1), -1))] += 1
    return a.tolist()


@pytest.mark.parametrize("w,seats", [([10000.0] + [0.49] * 1000, 10490), ([1.0] * 7, 3), ([3.0, 1.0, 1.0, 1.0], 2), ([5.0, 3.0, 1.0], 4), ([1e6, 1e3, 1.0, 0.0], 500), ([0.51] * 900 + [500.0], 700), ([2.0], 0)])
def test_sainte_lague_of_skewed_weights(spark, w, seats):
    rows = spark.createDataFrame([(i, float(x), seats) for i, x in enumerate(w)], "i int, w double, seats long")
    got = {r["i"]: r["n"] for r in source_mixing.sainte_lague(rows, [], "w", "seats", F.col("i"), "n").collect()}
    assert [got[i] for i in range(len(w))] == brute(np.array(w), seats)


def test_sainte_lague_in_groups(spark):
    rng = np.random.default_rng(3)
    w = rng.pareto(0.6, (5, 30)) * 10
    rows = [(g if g else None, i, float(w[g, i]), 40 + g) for g in range(5) for i in range(30)]
    got = source_mixing.sainte_lague(spark.createDataFrame(rows, "g int, i int, w double, seats long"), ["g"], "w", "seats", F.col("i"), "n").collect()
    got = {(r["g"] or 0, r["i"]): r["n"] for r in got}
    for g in range(5):
        assert [got[g, i] for i in range(30)] == brute(w[g], 40 + g)


def test_mix_of_rows_equals_the_taken_words(spark, docs):
    words = lambda t: (t or "").encode().split()
    alike = [(900_001, "u v w x y z", "twin", "twin", 11)] * 41 + [(900_002, "lone words here", "tiny", "tiny", 15)]
    table = spark.createDataFrame(docs.collect() + ODD + alike, DOCS)
    narrow = source_mixing.with_size(table)
    taken = source_mixing.take(narrow, *source_mixing.plan(spark, narrow)).collect()
    want = Counter()
    for r in taken:
        want[r["doc_id"], r["source"], r["text"]] += r["taken"]
    got = Counter()
    for r in source_mixing.mixed_documents(spark, table).collect():
        whole = next(t for t in {x["text"] for x in taken if x["doc_id"] == r["doc_id"] and x["source"] == r["source"]} if words(t)[: len(words(r["text"]))] == words(r["text"]))
        got[r["doc_id"], r["source"], whole] += len(words(r["text"]))
    assert +got == +want
    for s in {r["source"] for r in taken}:
        rows = [r for r in taken if r["source"] == s]
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= 0.1 * rows[0]["target"] + 1, s
