import numpy as np

from quillspark.llm import topk


def brute(rows, queries, k, scale=256.0):
    ok = [(i, [int(np.floor(scale * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=9) / 3).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(40)]  # a hot vector: ties at the border
    rows += [(400, None), (401, [1.0, None] + [0.0] * 7), (402, [float("nan")] * 9), (450, [0.0] * 9), (500, [5000.0, -7000.0]), (501, [1.0, 2.0]), (550, [float("inf")] * 9), (None, [1.0] * 9), (600, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score long, block string")
    got = topk.top_k(df, df.where("vec_id % 50 = 0"), k=5, block_rows=64, block_queries=3)
    assert sorted(map(tuple, got.collect())) == brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert topk.top_k(df.limit(0), df, k=5).count() == 0


def test_digits():
    for v in range(-300, 301):
        assert sum(s << p for p, s in topk.signed_digits(v)) == v
