import numpy as np
import xxhash

from quillspark.llm import simhash
from quillspark.llm.components import components


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, ids, radius=4):
    names = list(range(len(prints)))

    def root(i):
        while names[i] != i:
            i = names[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                names[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(root(i), []).append(ids[i])
    return [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(prints))]


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, bits string, label int")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    prints = [plain_print(t) for _, t in rows]
    want = classes(prints, [i for i, _ in rows])
    assert got == sorted((i is None, i or 0, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, want, strict=True))


def test_documents(spark):
    r = np.random.default_rng(0)
    words = [f"w{i}" for i in range(500)]
    base = [list(r.choice(words, 300)) for _ in range(15)]
    rows = []
    for i in range(150):
        w = list(base[i % 15])
        for _ in range(int(r.integers(0, 4))):
            w[int(r.integers(0, 300))] = "Ä"
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "One two"), (204, "one TWO"), (None, "one two"), (205, "x"), (5, rows[5][1]), (206, "lone\x1cword \x0b b c d e f g " * 3000)]
    check(spark, rows)
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_join_all_that_is_within_the_radius(spark):
    r = np.random.default_rng(1)
    hot = int(r.integers(0, 1 << 63))
    prints = {hot ^ sum(1 << int(b) for b in r.choice(64, int(r.integers(0, 4)), replace=False)) for _ in range(300)}
    prints |= {int(x) for x in r.integers(0, 1 << 63, 300)} | {0, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "bits long")
    labels = {r.node: r.label for r in components(simhash.links(df, 4, piece=50)).collect()}
    want = classes(prints, signed)
    assert [labels.get(p, p) for p in signed] == want


def test_band_masks_find_every_pair():
    r = np.random.default_rng(2)
    for n in (10, 10**5, 10**7, 10**9):
        masks = simhash.band_masks(n, 4)
        for _ in range(200):
            diff = sum(1 << int(b) for b in r.choice(64, 4, replace=False))
            assert any(not diff & m for m in masks)


def test_components_of_long_chains(spark):
    """The least id at either end of a path, and a star: few rounds, no cap."""
    edges = [(i, i + 1) for i in range(1, 300)] + [(1300 - i, 1299 - i) for i in range(299)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7), (9000, 9000)]
    df = spark.createDataFrame(edges, "a long, b long")
    got, rest = ({r.node: r.label for r in components(df, n).collect()} for n in (0, 300))
    assert rest == got == {r.node: r.label for r in components(df).collect()}
    want = {i: 1 for i in range(1, 301)} | {i: 1001 for i in range(1001, 1301)} | {i: 5000 for i in range(5000, 5060)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
