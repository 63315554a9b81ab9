import numpy as np

from quillspark.llm import line_dedup


def shared_runs(own, others, min_chars):
    """Positions of ``own`` in any run of ``min_chars`` characters that one of ``others`` holds, by trying every run."""
    gone = set()
    for other in others:
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if sum(map(len, own[a:b])) >= min_chars and any(other[c : c + b - a] == own[a:b] for c in range(len(other) - (b - a) + 1)):
                    gone |= set(range(a, b))
    return sorted(gone)


def brute(rows, min_chars=50):
    """Each document against all earlier ones, run by run, without hashes, keys or the code under test."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = [[x.strip(" ") for x in (t or "").split("\n")] for _, t in order]
    out = []
    for n, (i, t) in enumerate(order):
        if t is None:
            out.append((i, None))
            continue
        held = set(lines[n]) - {""}
        others = list({tuple(x): x for x in lines[:n] if held & set(x)}.values())
        gone = set(shared_runs(lines[n], others, min_chars))
        out.append((i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)))
    return out


def test_alignment():
    own, other = list("abcXdefgg"), list("Zabcdefgg")
    got = line_dedup.aligned(own, other)
    assert got == sorted(got) and [own[i] for i, _ in got] == list("abcdefgg")
    assert all(own[i] == other[j] for i, j in got)
    assert line_dedup.aligned([], list("ab")) == []
    assert line_dedup.aligned(list("aaaa"), list("aa")) == [(0, 0), (1, 1)]
    r = np.random.default_rng(0)
    for _ in range(200):
        a, b = r.integers(0, 12, 15).tolist(), r.integers(0, 12, 15).tolist()
        got = line_dedup.aligned(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    pool = [f"line {i} " + "word " * int(r.integers(1, 12)) for i in range(60)]
    rows = [(i, "\n".join(pool[int(j)] if r.random() < 0.5 else f"own {i} {k} text that nobody else has" for k, j in enumerate(r.integers(0, 60, int(r.integers(1, 14)))))) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(60)] + [(300, None), (301, ""), (302, "\n\n"), (None, rows[5][1]), (303, "  " + pool[0] + "\n" + pool[1]), (304, "\n".join(pool) * 2)]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_lines int, key string")
    got = line_dedup.dedup_lines(df)
    assert set(got.columns) == {"doc_id", "text", "key", "n_lines", "n_removed"}
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted([(x.doc_id, x.text) for x in got.collect()], key=key) == sorted(brute(rows), key=key)
    twice = df.limit(5).union(df.limit(5))
    assert line_dedup.dedup_lines(twice).where("n_removed > 0").count() == line_dedup.dedup_lines(df.limit(5)).where("n_removed > 0").count() * 2
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_repeated_and_moved_passages_go():
    common = lambda own, other, least: line_dedup.common_lines([x or None for x in own], list(map(len, own)), [x or None for x in other], least)
    assert common(["a", "P" * 9, "b"], ["c", "P" * 9, "x", "P" * 9, "d"], 9) == [1]
    assert common(["c", "P" * 9, "x", "P" * 9, "d"], ["a", "P" * 9, "b"], 9) == [1, 3]
    assert common(["Q" * 9, "own", "P" * 9], ["P" * 9, "other", "Q" * 9], 9) == [0, 2]
    r = np.random.default_rng(7)
    pool = ["", "a", "bb", "ccc", "dddd", "eeeee", "f" * 12]
    for n in range(1500):
        own, other = ([pool[int(i)] for i in r.integers(0, 3 + n % 5, int(r.integers(0, 14)))] for _ in range(2))
        assert common(own, other, 10) == shared_runs(own, [other], 10), (own, other)
    assert common([*[""] * 50_000, "P" * 9, *[""] * 50_000], ["P" * 9, ""], 9) == [50_000, 50_001]


def test_blocks_of_any_earlier_document_go(spark):
    short, p, q = [f"short line {c} of thirty letters" for c in "abc"], "passage P " * 6, "passage Q " * 6
    texts = ["\n".join([short[0], "x1"]), "\n".join([short[1], "x2"]), "\n".join([short[2], "x3"]), "\n".join(["own 3", *short]), "\n".join(["own 4", *short, "more"])]
    texts += [f"{p}\nown 5\n{q}", f"{q}\nown 6", f"{q}\nown 7\n{p}", f"{p}\n{p}\nown 8\n{q}\n\n{q}"]
    r = np.random.default_rng(11)
    pool = ["", *(f"{c} " + "word " * int(r.integers(1, 11)) for c in "abcdefghijklmno")]
    texts += ["\n".join(pool[int(i)] if r.random() < 0.7 else f"own {n} {k}" for k, i in enumerate(r.integers(0, len(pool), int(r.integers(1, 14))))) for n in range(150)]
    rows = [*enumerate(texts), (None, texts[20])]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    want = dict(brute(rows))
    assert want[4] == "own 4\nmore" and want[7] == "own 7" and want[8] == "own 8\n"
    assert {x.doc_id: x.text for x in got.collect()} == want


def test_rarity_changes_the_way_not_the_result(spark):
    r = np.random.default_rng(12)
    pool = ["", *(f"{n} " + "word " * int(r.integers(1, 11)) for n in range(40))]
    texts = ["\n".join(pool[int(r.integers(0, 41) ** 2 / 41)] if r.random() < 0.8 else f"own {n} {k}" for k in range(int(r.integers(1, 12)))) for n in range(120)]
    texts += ["A " * 12 + "\nB", "C\n" + "D " * 14, "A " * 12 + "\n" + "D " * 14, "A " * 12 + "\n" + "D " * 14 + "\nown"]
    rows = [*enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert dict(want)[123] == "own"
    for rare in (0, 2, 8, 1000):
        assert sorted((x.doc_id, x.text) for x in line_dedup.dedup_lines(df, rare=rare).collect()) == want


def test_both_sides_of_the_least_length(spark):
    texts = ["x" * 49 + "\nfirst", "x" * 49 + "\nsecond", "y" * 50 + "\nthird", "y" * 50 + "\nfourth", "short", "short"]
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == {i: t for i, t in enumerate(texts)} | {3: "fourth"}
