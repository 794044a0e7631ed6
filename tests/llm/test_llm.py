"""Training-data operators against brute force, exact round trips and held-out accuracy."""

import math
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborspark.llm import best_fit_packing, chat_formatting, embedding_dedup, exact_topk, html_extraction, language_id, lm_scoring, ngram_join, source_mixing, toxicity
from arborspark.llm.common import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "one two", None, None, 7), (3, "one two", None, None, 7), (None, "a b c d e f", "fr", "b", 11), (4, "x " * 30_000, "en", "a", 60_000), (5, "Ünï " * 7, "de", "b", 28), (6, "Ünï " * 7, "de", "b", 28)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark, n=None):
    return spark.createDataFrame(ODD[:n] if n is not None else ODD, DOCS)


def roots(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    want = roots(edges, {n for e in edges for n in e})
    got = {r["node"]: r["component"] for r in connected_components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(want[n] == got.get(n, n) for n in want)
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_lm_scores_match_brute_force(spark):
    rows = {r["doc_id"]: r for r in lm_scoring.op1_query(spark, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    c, b = Counter(), Counter()
    for i, w in tokens.items():
        if zlib.crc32(str(i).encode()) % 10:
            c.update(w)
            b.update(zip([0] + w[:-1], w))
    n, v = sum(c.values()), len(c)
    left, total, kinds = Counter(w for _, w in b), Counter(), defaultdict(lambda: [0, 0, 0])
    for (x, _), k in b.items():
        total[x] += k
        kinds[x][min(k, 3) - 1] += 1
    counts = lambda x: np.bincount(np.minimum(list(x.values()), 5), minlength=6)
    d2, d1, low = lm_scoring.discounts(counts(b)), lm_scoring.discounts(counts(left)), 0.0
    nl = counts(left)
    low = (d1[0] * nl[1] + d1[1] * nl[2] + d1[2] * nl[3:].sum()) / len(b)
    p1 = lambda w: max(left[w] - (0, *d1)[min(left[w], 3)], 0) / len(b) + low / (v + 1)

    def p(x, w):
        if not total[x]:
            return p1(w)
        k = b[x, w]
        return max(k - (0, *d2)[min(k, 3)], 0) / total[x] + sum(a * z for a, z in zip(d2, kinds[x])) / total[x] * p1(w)

    assert len(rows) == len(tokens)
    for i, w in tokens.items():
        r = rows[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p(x, y)) for x, y in zip([0] + w[:-1], w)), rel=1e-6)


def test_lm_odd_rows(spark):
    model = lm_scoring.train(spark, odd(spark).select("text"))
    got = lm_scoring.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r["score"]) for r in got)
    empty = lm_scoring.train(spark, odd(spark, 0).select("text"))
    assert {r["score"] for r in lm_scoring.score(odd(spark, 2), empty).collect()} == {0.0}


def test_lm_of_order_three_matches_brute_force(spark, docs):
    from arborspark.llm.registry import QUERIES

    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in docs.collect()}
    grams = lambda w: zip([0, 0] + w[:-1], [0] + w[:-1], w)
    count = {3: Counter(), 2: Counter(), 1: Counter()}
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            count[3].update(grams(w))
    for (_, v, w), k in count[3].items():
        count[2][v, w] += k if v == 0 else 1
    for _, w in count[2]:
        count[1][w,] += 1
    total, kinds, d = Counter(), defaultdict(lambda: [0, 0, 0]), {}
    for n, table in count.items():
        d[n] = lm_scoring.discounts(np.bincount(np.minimum(list(table.values()), 5), minlength=6))
        for g, k in table.items():
            total[n, g[:-1]] += k
            kinds[n, g[:-1]][min(k, 3) - 1] += 1

    def p(g):
        n, low = len(g), p(g[1:]) if len(g) > 1 else 1 / (len(count[1]) + 1)
        if not total[n, g[:-1]]:
            return low
        k, s = count[n][g], total[n, g[:-1]]
        return max(k - (0, *d[n])[min(k, 3)], 0) / s + sum(a * z for a, z in zip(d[n], kinds[n, g[:-1]])) / s * low

    for r in QUERIES["op1_lm_scoring"](spark, SF).collect():
        assert r["score"] == pytest.approx(sum(math.log10(p(g)) for g in grams(texts[r["doc_id"]])), rel=1e-5)


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(best_fit_packing.default_vocabulary())
    table = docs.unionByName(odd(spark)).select("doc_id", "text")
    got = best_fit_packing.pack_documents(spark, table).toPandas()
    texts = [r["text"] or "" for r in table.collect()]
    ids = [[*e.ids, 0] for e in enc.encode_batch(texts, add_special_tokens=False)]
    want = Counter()
    for x in ids:
        at, n = 0, len(x) % 2048 or 2048
        while at < len(x):
            want[at, n, zlib.crc32(np.array(x[at : at + n], "<u4").tobytes())] += 1
            at, n = at + n, 2048
    assert Counter(zip(got.start, got.length, got.ids_crc32)) == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        ends = np.cumsum(seq.length)
        assert ends.iloc[-1] <= 2048 and list(seq.offset) == [0, *ends.iloc[:-1]]
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) * 1.01 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing_plan_holds_every_capacity(rule):
    rng = np.random.default_rng(1)
    counts = dict(Counter(int(x) for x in rng.integers(1, 2049, 5000)))
    cap = (2048, 5, 1_500_000)
    counts = {k: v for k, v in counts.items() if k * k <= cap[2]}
    bins = defaultdict(list)
    for length, _, n, each, first, offset in best_fit_packing.best_fit_plan(counts, cap, rule):
        for i in range(n):
            bins[first + i // each].append((offset + i % each * length, length))
    assert Counter(x for b in bins.values() for _, x in b) == counts
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == list(np.cumsum([0] + [x for _, x in b])[:-1])
        assert sum(x for _, x in b) <= cap[0] and len(b) <= cap[1] and sum(x * x for _, x in b) <= cap[2]


def vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    near = base[0] + rng.normal(size=(30, 16)) * 0.02
    rows = [(i, [float(x) for x in v], i % 2) for i, v in enumerate(np.vstack([base, near, base[:1], base[:1]]))]
    rows += [(200, None, 0), (201, [float("nan")] * 16, 0), (202, [0.0] * 16, 0), (203, [1.0, 2.0], 0), (204, [None] * 16, 1), (205, [1.0] * 16, None), (206, [], 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), rows


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_top_k(spark):
    table, rows = vectors(spark)
    q = {i: np.floor(np.array(v) * 256).astype(int) for i, v, _ in rows if usable(v)}
    want = set()
    for i in q:
        if i % 10 == 0:
            best = sorted((-int(q[i] @ q[j]), j) for j in q if j != i and len(q[j]) == len(q[i]))[:5]
            want |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(spark, table, 10, 5).collect()}
    assert got == want
    assert exact_topk.top_k(spark, table.where("vec_id < 0")).count() == 0
    big = spark.createDataFrame([(0, [1e6, 1e6]), (1, [2e6, 1.0]), (2, [2e6, 2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in exact_topk.top_k(spark, big, 50, 1).collect()] == [(0, 1, 2, 256000000 * 512000000 + 256000000 * 512)]


def test_embedding_dedup(spark):
    table, rows = vectors(spark)
    good = {i: (np.array(v), lab) for i, v, lab in rows if usable(v) and any(v) and lab is not None}
    links = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.98]
    want = roots(links, [r[0] for r in rows])
    n = Counter(x for e in links for x in e)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark, table).collect()}
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], want[i], want[i] == i) for i in want}
    assert embedding_dedup.near_duplicates(spark, table.where("vec_id < 0")).count() == 0


def test_embedding_recall():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    r = rng.normal(size=a.shape)
    r -= (r * a).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + math.sqrt(1 - 0.98**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    salt = np.zeros(len(a), np.uint64)
    x, y = embedding_dedup.buckets(a, salt), embedding_dedup.buckets(b, salt)
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).mean() > 0.999


def test_language_id(spark, docs):
    got = language_id.op4_query(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    out = language_id.predict(odd(spark), language_id.fit(docs)).collect()
    assert [r["lang_pred"] for r in out][:2] == ["und", "und"] and len(out) == len(ODD)
    assert {r["lang_pred"] for r in language_id.predict(odd(spark), language_id.fit(odd(spark, 0))).collect()} == {"und"}


def test_html():
    page = "<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><div class='ad'>Buy the best of it now.</div><article><h1>A head</h1><p><b>The first of the blocks &amp; so on, which is long enough to be decided on its own.<br><p>Short\n one.</p></article><div class=comments><p>I think that this is the best page of all, and it is long enough to be counted as text.</p></div><footer>&copy; x</footer>"
    assert html_extraction.main_text(page).split("\n") == ["A head", "The first of the blocks & so on, which is long enough to be decided on its own.", "Short one."]
    assert html_extraction.main_text(None) == "" and html_extraction.main_text("<p") == ""


def test_html_wrappers_and_cards():
    body = "The first of the blocks and so on, which is long enough to be decided on its own by the words in it."
    other = "I think that this is the best page of all, and it is long enough to be counted as text of a reader."
    text = html_extraction.main_text
    for page in ("<body class='no-sidebar'><p>{}</p>", "<body class='skin-search'><article><p>{}</p></article>", "<div class='content-with-sidebar'><article><p>{}</p></article></div>", "<div class='content-with-sidebar'><p>{}</p></div>", "<form><p>{}</p></form>", "<svg width='1' /><p>{}</p><svg><text>x</text></svg>"):
        assert text(page.format(body)) == body, page
    cards = "".join(f"<article><p>Card {i}</p></article>" for i in range(3))
    assert body in text(f"<div><p>{body}</p><p>{body}</p></div>{cards}")
    assert text(f"<div class='layout-sidebar'><article><p>{body}</p></article><div class=comments><article class=comment><p>{other}</p></article><p>{other}</p></div></div>") == body
    assert text(f"<div class='layout-sidebar'><p>{body}</p><div class=comments><p>{other}</p></div></div>") == body


def test_html_keeps_the_article(spark, docs):
    line = lambda t: "\n".join(" ".join(x.split()) for x in t.split("\n") if x.split())
    known = {line(r["text"]) for r in docs.collect()}
    got = html_extraction.op6_query(spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"].partition("\n")[2] in known for r in got) >= 0.99 * len(got)


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(400):
        text = " ".join(rng.choice(words, 40)) + (" you slimeball and dirtbag" if i % 5 == 0 else "")
        rows.append((i, text)), marks.append((i, i % 2, int(i % 5 == 0)))
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, low_quality int, toxic int")
    model = toxicity.fit(table, labels)
    got = toxicity.score(table, model).collect()
    assert all(r["is_toxic"] == (r["doc_id"] % 5 == 0) for r in got)
    out = toxicity.score(odd(spark).withColumn("p_toxic", F.lit("x")), model).collect()
    assert len(out) == len(ODD) and not any(r["is_toxic"] for r in out)
    none = toxicity.fit(table, labels.where("doc_id < 0"))
    assert not any(r["is_toxic"] for r in toxicity.score(table, none).collect())


def test_toxicity_counts_all_labels_and_copies_once(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_TRAIN", 300)
    rng = np.random.default_rng(8)
    footer = " ".join(f"f{i}" for i in range(40))  # a passage of every text makes no copies of them
    rows = [(i, " ".join(f"w{k}" for k in rng.integers(0, 300, 40)) + (" slimeball" if i % 100 == 0 else "") + " " + footer) for i in range(3000)]
    rows += [(5000 + i, f"{rows[1][1]} copied {i}") for i in range(40)]
    marks = [(i, i % 2, int(i % 100 == 0 or i >= 5000)) for i, _ in rows]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, low_quality int, toxic int")
    words = set(toxicity.fit(table, labels)["chain"][1]["words"].tolist())
    cache = toxicity.WordBucket()
    assert cache[b"slimeball"] in words and cache[b"copied"] not in words


def brute_links(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return sets, roots(links, ids)


def test_ngram_join(spark, docs):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 120)]
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for i in range(60):  # a large group of near copies, some chained
        t = list(base)
        for at in rng.integers(0, 120, int(rng.integers(0, 6))):
            t[at] = f"x{i}"
        rows.append((10_000 + i, " ".join(t)))
    rows += [(20_000, None), (20_001, "  "), (20_002, "a B"), (20_003, "A b"), (20_004, "a b c")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sets, want = brute_links(rows)
    got = ngram_join.near_duplicates(spark, table).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in want}


def test_ngram_join_odd_rows(spark):
    got = ngram_join.near_duplicates(spark, odd(spark)).collect()
    assert len(got) == len(ODD) and sum(r["component_id"] is None for r in got) == 1
    kept = ngram_join.deduplicated(spark, odd(spark)).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 1, 2, 3, 4, 5]
    assert ngram_join.near_duplicates(spark, odd(spark, 0)).count() == 0


def test_chat_round_trip(spark):
    texts = ["", None, "<|end|>\n", "\\<|", "a\\\\|>b", "<s>[INST]x[/INST]</s>", "<<SYS>>\\", "<|turn user|>\nhi<|end|>\n", "\n", "ok"]
    rows = [(i, t, role, texts[(i + t) % len(texts)]) for i in range(12) for t, role in enumerate(("system", "user", "assistant", "a|>\nb", None))]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_formatting.format_conversations(table).withColumn("turns", chat_formatting.parse("formatted"))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in out.collect()}
    assert got == {i: [(r or "", t or "") for k, _, r, t in sorted(rows, key=lambda x: x[:2]) if k == i] for i in range(12)}
    plain = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "bc")], "conv_id long, turn long, role string, text string")
    spans = chat_formatting.loss_spans(chat_formatting.format_conversations(plain)).first()
    text = chat_formatting.format_conversations(plain).first()["formatted"]
    assert text[spans["start"] : spans["end"]] == "bc"


def test_sql_queries(spark):
    c = duckdb.connect()
    for t in "documents embeddings conversations".split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for fn, sql in ((chat_formatting.op9_query, chat_formatting.OP9_SQL), (exact_topk.op3_query, exact_topk.OP3_SQL), (embedding_dedup.op5_query, embedding_dedup.OP5_SQL)):
        df = fn(spark, SF)
        want = c.execute(sql)
        cols = [d[0] for d in want.description]
        assert Counter(map(tuple, df.select(cols).collect())) == Counter(want.fetchall())


def test_mixing(spark, docs):
    table = docs.unionByName(odd(spark))
    narrow = source_mixing.with_size(table)
    got = source_mixing.take(narrow, *source_mixing.plan(spark, narrow)).toPandas()
    size = got.groupby(got.source.fillna("\U0010ffff"))["size"].sum().sort_index()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(size.index)}
    target, open_ = {}, set(size.index)
    while True:
        left, w = size.sum() - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w >= 3 * size[s]}
        if not over:
            break
        target |= {s: 3.0 * size[s] for s in over}
        open_ -= over
    target |= {s: left * weight[s] / w for s in open_}
    for s, part in got.groupby(got.source.fillna("\U0010ffff")):
        assert part.target.iloc[0] == pytest.approx(target[s]) and abs(part.taken.sum() - target[s]) <= 2 * source_mixing.BLOCK + 0.01 * target[s]
    assert (got.taken <= 3 * got["size"]).all() and len(got) == table.count()
    mixed = source_mixing.mixed_documents(spark, table)
    assert mixed.columns == table.columns and mixed.agg(F.sum(F.regexp_count("text", F.lit(source_mixing.WORD)))).first()[0] == got.taken.sum()


def test_sainte_lague(spark):
    rng = np.random.default_rng(6)
    w = rng.integers(1, 1000, 40).astype(float)
    seats = 333
    a = np.zeros(40, int)
    for _ in range(seats):
        a[np.argmax(w / (2 * a + 1))] += 1
    rows = spark.createDataFrame([(i, float(x), seats) for i, x in enumerate(w)], "i int, w double, seats long")
    got = {r["i"]: r["n"] for r in source_mixing.sainte_lague(rows, [], "w", "seats", F.col("i"), "n").collect()}
    assert [got[i] for i in range(40)] == a.tolist()


def test_pipeline_keeps_columns_and_drops_copies(spark, docs):
    table = docs
    for name, stage in corpus_pipeline.STAGES[1:4]:
        table = corpus_pipeline.materialize(spark, stage(spark, table, SF), "test")
        assert table.columns == docs.columns and table.count() > 0, name
    packed = corpus_pipeline.pack_sequences(spark, table, SF)
    assert packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048
