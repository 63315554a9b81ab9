import corpus_pipeline
import numpy as np
from quillspark.llm import similar


def plain_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_first(rows):
    sets, names = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                old, new = names[i], names[j]
                names = [new if x == old else x for x in names]
    groups = {}
    for (i, _), n in zip(rows, names, strict=True):
        groups.setdefault(n, []).append((i is None, i or 0))
    return sorted(min(g) for g in groups.values())


def test_near_copies_go(spark):
    r = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(3000)])
    rows = []
    for n, (size, changes) in enumerate([(100, 1), (200, 3), (400, 8), (100, 4), (60, 2), (200, 12)] * 20):
        base = list(r.choice(words, size))
        copy = list(base)
        for at in r.choice(size, changes, replace=False):
            copy[int(at)] = "changed"
        rows += [(2 * n, " ".join(base)), (2 * n + 1, " ".join(copy))]
    hot = list(r.choice(words, 120))
    for n in range(400):
        copy = list(hot)
        for at in r.choice(120, int(r.integers(0, 6)), replace=False):
            copy[int(at)] = f"c{n}"
        rows.append((1000 + n, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, "One two"), (2003, "one TWO"), (None, "one two"), (2004, "x"), (None, "nothing like it")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.drop_near(spark, df, "")
    assert got.columns == df.columns
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got.collect()) == plain_first(rows)
    assert corpus_pipeline.drop_near(spark, df.limit(0), "").count() == 0


def test_links_beside_the_first_holder(spark):
    """Families that share a passage, so keys, with a first holder that is like none of them."""
    r = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for n in range(40):
        own = [f"f{n}w{i}" for i in range(30)]
        for m in range(3):
            rows.append((10 * n + m, " ".join([*passage, *own[:15], f"only{n}" if m else "x", *own[15:]])))
    rows += [(1000 + n, " ".join([*passage, *(f"lone{n}x{i}" for i in range(int(r.integers(20, 200))))])) for n in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for piece in (7, 2048):
        pairs = []
        kept = similar.links_within

        def small(members, n_words, radius, share, piece=piece, kept=kept):
            pairs.append(members.count())
            return kept(members, n_words, radius, share, piece)

        similar.links_within = small
        try:
            got = similar.keep_first(df)
        finally:
            similar.links_within = kept
        assert pairs[0] > 50 and sorted((False, x.doc_id) for x in got.collect()) == plain_first(rows)


def test_clashing_names_and_repeats(spark):
    df = spark.createDataFrame([(1, "a b", 5, 6, 7), (1, "a b", 5, 6, 7), (2, "A b", 1, 2, 3), (3, "c", 1, 2, 3)], "doc_id long, text string, row int, ROW_ int, node int")
    got = similar.keep_first(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [(1, "a b", 5, 6, 7), (3, "c", 1, 2, 3)]
