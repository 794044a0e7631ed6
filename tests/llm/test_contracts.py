"""Odd rows and brute force for queries that SQL cannot express."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborspark.llm import best_fit_packing, chat_formatting, embedding_dedup, language_id, lm_scoring, ngram_join, toxicity
from tests.llm.test_llm import SF, odd

CHAT = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "EPOCHS", 1)
    rows = [(i, f"word{i % 1100} text of it", f"l{i % 1100:04}") for i in range(2200)]
    texts, langs = language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(langs)) == 1100 and len(texts) == 2200
    long = [(1, "début " * 9000 + "mitte " * 9000 + "ending " * 9000, "x")]
    ((text,), _) = language_id.sample(spark.createDataFrame(long, "doc_id long, text string, lang string"))
    assert all(w in text.decode() for w in ("début", "mitte", "ending")) and len(text) < 20_000


def test_rejection_bound_follows_errors():
    right = np.array([True] * 990 + [False] * 10)
    confidence = np.concatenate([np.linspace(0.6, 1, 990), np.linspace(0.3, 0.55, 10)])
    bound = language_id.rejection_bound(confidence, right, np.full(500, 0.4))
    kept = confidence >= bound
    assert 0.4 < bound <= np.quantile(confidence[right], language_id.LOST) and (kept & ~right).sum() <= language_id.ERROR * kept.sum()
    assert language_id.rejection_bound(confidence, ~right & False, np.zeros(3)) == 0.0


def test_language_prediction_equals_each_text_alone(spark, docs):
    model = language_id.fit(docs)
    rows = docs.orderBy("doc_id").limit(80)
    for r in language_id.predict(rows, model).collect():
        text = (r["text"] or "").encode()
        data = np.append(language_id.folded(text), np.full(3, 32, np.uint8))
        z = np.mean([model["scores"][g].mean(axis=0) for g in language_id.gram_buckets(data)], axis=0) / model["temperature"]
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        if language_id._LETTER.search(r["text"] or ""):
            assert r["lang_pred"] == model["classes"][int(p.argmax())] and r["score"] == pytest.approx(p.max(), rel=1e-3)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_toxicity_equals_the_chain_by_hand(spark, docs):
    model = toxicity.fit(docs.select("doc_id", "text"), toxicity.label_table(spark, SF))
    cache = toxicity.WordBucket()
    for r in toxicity.score(docs.orderBy("doc_id").limit(60), model).collect():
        words, shape, _ = toxicity.features((r["text"] or "").encode(), cache)
        extra, earlier = np.clip((np.array(shape) - model["mean"]) / model["scale"], -3, 3), []
        for c in model["chain"]:
            x = [float(w in set(words.tolist())) for w in c["words"].tolist()] + (extra.tolist() if c["name"] in toxicity.SHAPED else []) + earlier + [1.0]
            p = 1 / (1 + math.exp(-float(np.clip(np.dot(x, c["weights"]), -30, 30))))
            assert r[f"p_{c['name']}"] == pytest.approx(p, abs=1e-6) and r[f"is_{c['name']}"] == (p >= c["bound"])
            earlier.append(p)


def test_packing_is_no_worse_than_plain_best_fit(spark, docs):
    rng = np.random.default_rng(9)
    lengths = [int(x) for x in rng.integers(1, 2049, 3000)]
    room = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=room.__getitem__)] -= n
        else:
            room.append(2048 - n)
    used = {first + i for _, _, n, each, first, _ in best_fit_packing.best_fit_plan(dict(Counter(lengths))) for i in range(-(-n // each))}
    assert len(used) <= len(room)
    assert best_fit_packing.pack_documents(spark, odd(spark, 0)).count() == 0


def test_repeated_vector_ids(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [0.999, 0.001], 0), (3, [1.0, 0.0, 0.0], 0), (4, [1.0, 0.0], 1), (5, [-0.0, 0.0], 0)]
    got = Counter(tuple(r) for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == Counter([(1, 2, 1, True), (1, 2, 1, True), (1, 0, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)])


def test_many_vectors_in_one_bucket(spark):
    """A large near-copy group over several blocks, beside small ones and another length."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    rows = [(i, [float(x) for x in base + rng.normal(size=16) * 0.02], 0) for i in range(600)] + [(1000 + i, [float(x) for x in rng.normal(size=8)], 0) for i in range(50)]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array([r[1] for r in rows[:600]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.98).sum(axis=1) - 1
    assert [got[i]["n_links"] for i in range(600)] == near.tolist()
    assert {got[i]["component_id"] for i in range(600) if near[i]} == {min(i for i in range(600) if near[i])}


def test_chat_levels_and_odd_rows(spark):
    turns = [("user", "<|end|>\n"), ("assistant", "\\</s>|>"), ("tool|>\n", ""), ("user", "plain")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(None, 0, "user", "a"), (None, 0, "user", "a"), (2, None, None, None)]
    table = spark.createDataFrame(rows, CHAT).withColumn("clash", F.lit(1)).withColumn("turns", F.lit(2))
    out = chat_formatting.format_conversations(table).collect()
    assert Counter(r["conv_id"] for r in out) == {1: 1, 2: 1, None: 2}
    text = next(r["formatted"] for r in out if r["conv_id"] == 1)
    assert text.count("<|turn! ") == 3 and "<|turn user|>\nplain<|end|>\n" in text  # only conflicting turns are escaped
    assert chat_formatting.format_conversations(spark.createDataFrame([], CHAT)).count() == 0
    source = spark.createDataFrame([(turns,)], "turns array<struct<role: string, text: string>>")
    for level in (1, 2):
        back = source.select(chat_formatting.parse(chat_formatting.render("turns", level))).first()[0]
        assert [tuple(t) for t in back] == turns
    assert [tuple(t) for t in source.select(chat_formatting.parse(chat_formatting.render("turns", 0))).first()[0]] != turns
    digest = chat_formatting.digest(chat_formatting.format_conversations(table)).where("conv_id = 1").first()
    assert digest["loss_chars"] == len(turns[1][1]) and digest["n_turns"] == 4


def test_hot_lists_are_dealt_and_buckets_follow_the_postings(spark, monkeypatch):
    rng = np.random.default_rng(12)
    shared = " ".join(f"s{i}" for i in range(30))
    rows = [(i, f"{shared} " + " ".join(f"w{k}" for k in rng.integers(0, 40, 4))) for i in range(120)]
    want = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    monkeypatch.setattr(ngram_join, "HOT_LIST", 20)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 100)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) < 120


def test_lm_counts_are_wide_and_remote_segments_are_read(tmp_path):
    key = np.arange(5, dtype=np.uint64) << np.uint64(40)
    lm_scoring.write_segment(str(tmp_path / "grams-2-0"), key, [np.array([1, 2, 300, 1, 6_000_000_000])])
    model = {"path": str(tmp_path), "parts": 1}
    (got,) = lm_scoring._segment_lookup(model, "grams-2", 1, np.zeros(6, np.int64), np.append(key, np.uint64(77 << 40)))
    assert got.tolist() == [1, 2, 300, 1, 6_000_000_000, 0]
    raw = lm_scoring._fetched(f"file://{tmp_path}/grams-2-0")
    assert raw.tobytes() == (tmp_path / "grams-2-0").read_bytes() and lm_scoring._fetched(f"file://{tmp_path}/none") is None
    words, ids, c = np.array([3, 9, 1 << 47], np.uint64), [np.array([2, 0]), np.array([1, 1])], np.array([1, 7_000_000_000])
    back, n = lm_scoring.unpack_grams(lm_scoring.pack_grams(words, ids, c))
    assert [x.tolist() for x in back] == [[1 << 47, 3], [9, 9]] and n.tolist() == c.tolist()
