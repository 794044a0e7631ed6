"""op1: tokens, sorting and counting by whole arrays."""

import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from arborspark.llm import lm_scoring


def frame(texts, cut=0):
    return pa.RecordBatch.from_arrays([pa.array([None] * cut + texts, pa.string())], names=["text"]).slice(cut)


def calls(fn):
    """How many calls, those of C functions included, ``fn`` makes."""
    n = 0

    def count(_, event, __):
        nonlocal n
        n += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        fn()
    finally:
        sys.setprofile(None)
    return n


def test_reading_and_counting_make_no_call_per_word_or_text():
    texts = [" ".join(f"w{i}-{j}" for j in range(50)) for i in range(2000)]
    read = lambda: list(lm_scoring.token_blocks([frame(texts)], 1 << 20))
    read()  # modules are loaded at the first use
    assert calls(read) < 1000


@pytest.mark.parametrize("read", [1, 40, 1 << 21])
def test_tokens_are_those_of_split(monkeypatch, read):
    monkeypatch.setattr(lm_scoring, "READ_BYTES", read)
    rng = np.random.default_rng(0)
    letters = np.array(list("aAbZz@[`{ \t\n\r\x0b\x0c\x1c\x00\x85\xa0é漢 "))
    texts = ["".join(rng.choice(letters, n)) for n in [*rng.integers(0, 60, 300), 5000]]
    texts += ["", None, " ", "a" * 7, "a" * 8, "A" * 9, "a" * 16, "a" * 17, "b" * 64, "b" * 65, "B" * 65, "b" * 66, "\x00", "\x00\x00", "x", "Y"]
    for cut in (0, 3):
        got = [(first, t, n) for _, first, t, n in lm_scoring.token_blocks([frame(texts, cut), frame([], cut)], 500)]
        assert [x[0] for x in got] == [0, *np.cumsum([len(n) for *_, n in got])[:-1]]
        want = [[*(t or "").encode().lower().split(), None] for t in texts]
        assert [len(w) for w in want] == np.concatenate([n for *_, n in got]).tolist()
        pairs = set(zip(sum(want, []), np.concatenate([t for _, t, _ in got]).tolist()))
        assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs}) and (None, lm_scoring.END) in pairs


@pytest.mark.parametrize("bits", [8, 48, 62, 64])
def test_sorting_is_exact(bits):
    rng = np.random.default_rng(1)
    for key in (rng.integers(0, 1 << min(bits, 63), 3000), rng.integers(0, 9, 3000), np.zeros(0, int), np.zeros(1, int)):
        key = key.astype(np.uint64)  # numbers below 9 differ only in bits that places take
        order, k = lm_scoring.sorting(key, bits)
        assert sorted(order.tolist()) == list(range(len(key))) and (key[order] == k).all() and (k == np.sort(key)).all()
        uniq, first, at = lm_scoring.distinct(key, bits)
        assert (uniq == np.unique(key)).all() and (uniq[at] == key).all() and (key[first] == uniq).all()
        h, n = lm_scoring.key_sum(key, np.ones(len(key), int), bits=bits)
        assert dict(zip(h.tolist(), n.tolist())) == Counter(key.tolist())


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_distinct_grams_of_any_order(order):
    ids = list(np.random.default_rng(2).integers(0, 4, (order, 2000)))
    got, c = lm_scoring.distinct_grams(ids)
    assert Counter(dict(zip(zip(*(x.tolist() for x in got)), c.tolist()))) == Counter(zip(*(x.tolist() for x in ids)))
    assert order > 3 or (np.diff(got[-2]) >= 0).all()


def test_frequent_contexts_are_found_by_the_whole_key():
    keys = np.array([1 << 50, (1 << 50) + 1, 7, 1 << 63], np.uint64)
    assert lm_scoring.among(np.array([7, 1 << 50], np.uint64), keys).tolist() == [True, False, True, False]
    assert not lm_scoring.among(keys[:0], keys).any()


def test_flags_are_summed_as_numbers():
    h, n = lm_scoring.key_sum(np.zeros(300, np.uint64), np.ones(300, bool))
    assert (h.tolist(), n.tolist(), n.dtype) == ([0], [300], np.int64)
