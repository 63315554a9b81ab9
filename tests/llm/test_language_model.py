import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import language_model
from quillspark.llm.elias_fano import EliasFano


@pytest.mark.parametrize("top", [1, 5, 1000, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 3000])
def test_elias_fano(top, n):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
    ef = EliasFano.of(EliasFano(v).arrays())
    assert np.array_equal(ef.get(np.arange(n)), v)
    q = np.unique(np.concatenate((v, v + np.uint64(1), r.integers(0, top, 200, dtype=np.uint64, endpoint=True), np.array([0, top], np.uint64))))
    assert np.array_equal(ef.find(q), np.searchsorted(v, q))
    there = np.isin(q, v)
    got = ef.locate(q)
    assert np.array_equal(got >= 0, there) and np.array_equal(v[got[there]], q[there])


def plain(rows, order):
    words = lambda t: [*(t or "").encode().lower().split(), b" "]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [words(t) for i, t in rows if not out(i)]
    grams = [Counter(tuple(w[a : a + k]) for w in train for a in range(len(w) - k + 1)) for k in range(order + 1)]
    uni, n = grams[1] if order else Counter(), sum(map(len, train))
    v = len(uni)
    kinds = [Counter(g[:-1] for g in grams[k]) for k in range(order + 1)]

    def p(w, a, k):
        if k == 1:
            return (uni[w[a],] or 1) / (n + v) if n + v else 1.0
        context, lower = tuple(w[a - k + 1 : a]), p(w, a, k - 1)
        if not grams[k - 1][context]:
            return lower
        c, t = grams[k - 1][context], kinds[k][context]
        return (grams[k][tuple(w[a - k + 1 : a + 1])] + t * lower) / (c + t)

    for i, t in rows:
        w = words(t)
        base = sum(math.log10((uni[x,] + 1) / (n + v + 1)) for x in w)
        score = sum(math.log10(p(w, a, min(order, a + 1))) for a in range(len(w)))
        yield i, out(i), len(w), sum(uni[x,] > 0 for x in w), n, base, score


@pytest.mark.parametrize("order", [2, 3])
def test_scores(spark, order):
    r = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "The", "THE"]
    rows = [(i, " ".join(r.choice(vocabulary, int(r.integers(0, 60)))) + " lone%d" % i) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n\x0b"), (None, "the w1 w2"), (3, rows[3][1]), (203, "w1 w2\x1cw3 new words here"), (204, "w1 w2 " * 30000)]
    df = spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "doc_id long, text string, score double, part int")
    key = lambda x: (x[0] is not None, x[0] or 0, x[2])
    got = sorted(map(tuple, language_model.held_out_scores(df, order=order).collect()), key=key)
    for a, b in zip(got, sorted(plain(rows, order), key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9)
        assert abs(a[6] - b[6]) <= 2e-4 * a[2]  # codes of 1 / 4096 of a power of ten


def test_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert language_model.held_out_scores(df.limit(0)).count() == 0
    [row] = language_model.score(df, language_model.train(df.limit(0))).collect()
    assert tuple(row) == (1, 3, 0, 0, 0.0, 0.0)


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_model.held_out_scores(docs).where("held_out").collect()
    base, own = sum(r.base_score for r in rows), sum(r.score for r in rows)
    print("held-out log10 a token: base", base / sum(r.n_tokens for r in rows), "model", own / sum(r.n_tokens for r in rows))
    assert own > base


def test_parts_are_closed_beyond_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c w{i} w{i + 1} d e") for i in range(80)], "doc_id long, text string")
    model = language_model.train(docs, order=2)
    level = model.levels[1]
    assert len(level.files) > 1
    contexts, words = np.repeat(np.arange(model.vocabulary), model.vocabulary), np.tile(np.arange(model.vocabulary), model.vocabulary)
    want = level.find(contexts, words)
    assert (want >= 0).any() and len(level.open) == len(level.files)
    monkeypatch.setattr(language_model, "MOST_HELD", 1)
    level.open, level.held = {}, {}
    assert np.array_equal(level.find(contexts, words), want) and len(level.open) == 1
