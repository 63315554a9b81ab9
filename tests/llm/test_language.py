import zlib

import numpy as np

from quillspark.llm import language
from quillspark.llm.queries import op6_language


def plain_vector(text, dimensions, seed):
    """Letter by letter, position by position."""
    base = {}

    def of(p):
        if p not in base:
            base[p] = np.random.default_rng([seed, p]).integers(0, 2, dimensions, np.int8) * 2 - 1
        return base[p].astype(int)

    words, total = "".join(c.lower() if c.isalpha() else " " for c in text).split(), np.zeros(dimensions, int)
    for w in words:
        w = [0, *map(ord, w), 0]
        for a, b, c in zip(w, w[1:], w[2:]):
            total += np.roll(of(a), 2) * np.roll(of(b), 1) * of(c)
    return total


def test_bundle_equals_plain_sum():
    for text in ("Ab cdé. x", "аб вг the the", "a"):
        got = language.letters(128, 5).bundle(*np.unique(language.grams(text.encode()), return_counts=True))
        assert np.array_equal(got, plain_vector(text, 128, 5))


def test_cases(spark):
    rows = [(1, "the cat and the hat", "en", "q"), (2, "der hund und das haus", "de", "q"), (3, None, "en", "q"), (4, "", None, "q"), (5, "123 !!", "de", "q"), (None, "the and", None, "q"), (1, "the cat and the hat", "en", "q"), (6, "the hat " * 40000, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    profiles = language.learn(df)
    got = sorted(((r.doc_id or 0), r.lang_pred) for r in language.identify(df, profiles).collect())
    assert got == [(0, "en"), (1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "en")]
    kept = language.keep_known(df, profiles)
    assert kept.schema == df.schema and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6]
    assert language.identify(df.limit(0), profiles).count() == 0
    nothing = language.learn(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_prediction_equals_plain_version(spark):
    """Prototypes, cosines, scores and ties, letter by letter; two languages share one text."""
    r = np.random.default_rng(2)
    parts = {"xa": ["tha", "ing", "ou"], "xb": ["der", "sch", "ein"], "xc": ["que", "ée", "la"]}
    rows = [(n, " ".join("".join(r.choice(p, int(r.integers(1, 4)))) for _ in range(12)), lang) for n, (lang, p) in enumerate([*parts.items()] * 4)]
    rows += [(100, "Twin text", "zb"), (101, "Twin text", "za"), (102, "twin", None), (103, "…!", None), (104, None, None), (105, "Unlike anything", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language.learn(df, dimensions=128, seed=5)
    sums = {}
    for _, text, lang in rows:
        if lang:
            sums[lang] = sums.get(lang, 0) + plain_vector(text, 128, 5)
    got = {x.doc_id: (x.lang_pred, x.score) for x in language.identify(df, profiles).collect()}
    for i, text, _ in rows:
        own = plain_vector(text or "", 128, 5)
        if not own.any():
            assert got[i] == ("und", 0.0)
            continue
        cosines = {k: float(v @ own) / (float(v @ v) ** 0.5 * float(own @ own) ** 0.5) for k, v in sums.items()}
        best = max(sorted(cosines), key=lambda k: round(cosines[k], 9))
        assert got[i][0] == best and abs(got[i][1] - min(1, max(0, cosines[best]))) < 1e-9
    assert got[102][0] == got[100][0] == "za"
    nothing = language.learn(df.limit(0))
    assert sorted(x.doc_id for x in language.keep_known(df, nothing).collect()) == sorted(i for i, t, _ in rows if any(c.isalpha() for c in t or ""))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = [r for r in op6_language(spark, "/root/testdata/sf0.01").collect()]
    assert len(rows) == len(truth)
    test = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = sum(r.lang_pred == truth[r.doc_id] for r in test)
    print("accuracy", right / len(test), sorted(r.score for r in rows)[:20])
    assert right >= 0.97 * len(test)
