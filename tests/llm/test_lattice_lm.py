import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lattice_lm as lm
from quarry.llm.queries import vocabulary
from tests.llm.data import awkward, clash, empty, frame

PATH = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return lm.load_pieces(PATH)


def segmentations(p, s):
    """Every way to write s in pieces, by recursion."""
    if not s:
        yield 0.0
        return
    for n in range(1, len(s) + 1):
        k = p.ids.get(s[:n])
        w = p.logp[k] if k is not None else p.spell_logp(s[0]) if n == 1 else None
        if w is not None:
            for rest in segmentations(p, s[n:]):
                yield w + rest


WORDS = ["the", "hello", "naïve", "日本", "a", "zzzz", "x1y2", "thation"]


def test_marginals_sum_all_segmentations(pieces):
    got = lm.marginals(pieces, WORDS)
    want = [math.log10(sum(math.exp(v) for v in segmentations(pieces, lm.MARK + w))) for w in WORDS]
    assert np.allclose(got, want)


def test_long_words_agree_with_short_path(pieces, monkeypatch):
    words = ["the" * 9, "q" * 40, "日本語" * 8]
    a = lm.marginals(pieces, words)
    ea = lm.expected_counts(pieces, words, np.array([1.0, 2.0, 3.0]))
    monkeypatch.setattr(lm, "LONG_WORD", 2)
    assert np.allclose(a, lm.marginals(pieces, words))
    assert np.allclose(ea, lm.expected_counts(pieces, words, np.array([1.0, 2.0, 3.0])))


def brute(rows):
    toks = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c, ends = Counter(), 0
    for i, t in rows:
        if not held(i):
            c.update(toks(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    d = math.log10(n + v + 1)
    out = []
    for i, t in rows:
        x = toks(t)
        out.append((i, held(i), len(x) + 1, sum(c[w] > 0 for w in x) + (ends > 0), n,
                    sum(math.log10(c[w] + 1) - d for w in x) + math.log10(ends + 1) - d))
    return out


def test_base_matches_brute_force_with_and_without_hot_words(spark):
    rows = awkward(long_words=600)
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[2], r[5]))
    scores = []
    for hot in (1 << 17, 3):
        got = lm.score_texts(clash(frame(spark, rows), "row", "word", "score"), PATH, hot_words=hot).collect()
        got = sorted(got, key=lambda r: (str(r["doc_id"]), r["n_tokens"], r["base_score"]))
        assert len(got) == len(want)
        for g, w in zip(got, want):
            assert (g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:5]
            assert math.isclose(g["base_score"], w[5], rel_tol=1e-9)
            assert g["score"] < 0 and math.isfinite(g["score"])
        scores.append([g["score"] for g in got])
    assert np.allclose(*scores)


def test_long_frequent_words_are_joined_not_shipped(spark, monkeypatch):
    rows = [(i, f"{'q' * 300} a {'日' * 40} b{i % 3}") for i in range(30)] + [(30, "q" * 300), (31, None)]
    want = sorted(brute(rows))
    scores = []
    for most in (1 << 20, lm.HOT_WORD_BYTES, 1):
        monkeypatch.setattr(lm, "HOT_WORD_BYTES", most)
        got = sorted(lm.score_texts(frame(spark, rows), PATH).collect(), key=lambda r: r["doc_id"])
        for g, w in zip(got, want, strict=True):
            assert (g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == w[:5]
            assert math.isclose(g["base_score"], w[5], rel_tol=1e-9)
        scores.append([g["score"] for g in got])
    assert np.allclose(scores[0], scores[1]) and np.allclose(scores[0], scores[2])


def test_training_raises_likelihood(spark, pieces):
    words = spark.createDataFrame([("thation", 50), ("renda", 30), ("selvor", 20)], "word string, c long")
    fitted = lm.fit_pieces(words, pieces, 10, rounds=3)
    assert abs(np.exp(fitted.logp).sum() - 1) < 1e-9
    assert (lm.marginals(fitted, ["thation", "renda"]) > lm.marginals(pieces, ["thation", "renda"])).all()


def test_empty(spark):
    assert lm.score_texts(empty(spark), PATH).collect() == []
