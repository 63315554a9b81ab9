import hashlib

import numpy as np

from quillspark.llm import substring_dedup
from quillspark.llm.suffix_array import repeat_classes, suffix_array


def test_suffix_array():
    r = np.random.default_rng(0)
    for k in (1, 2, 4, 200):
        for n in [*range(12), 50, 301, 1000]:
            x = r.integers(0, k, n)
            assert suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
    big = r.integers(0, 1 << 30, 500)
    assert suffix_array(big).tolist() == sorted(range(500), key=lambda i: big[i:].tolist())
    data = r.integers(0, 2, 400).astype(np.uint8)
    starts = np.arange(0, 380)
    for length in (5, 8, 11):
        got = repeat_classes(data, starts, length)
        names = {}
        want = [names.setdefault(data[s : s + length].tobytes(), len(names)) for s in starts]
        assert len(set(zip(got.tolist(), want))) == len(set(want)) == len(set(got.tolist()))


def brute(rows, length=100):
    """Each byte covered by a string seen before, by a set of all strings; rows of one id must be equal."""
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if i in out:
            continue
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return sorted((out[i] for i, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0))


def texts():
    r = np.random.default_rng(5)
    words = [f"{w:x}" for w in r.integers(0, 1 << 24, 3000)]
    say = lambda n: " ".join(r.choice(words, n))
    passage, rows = say(60), []
    for i in range(120):
        parts = [say(int(r.integers(1, 60)))]
        if i % 3 == 0:
            parts.append(passage[int(r.integers(0, 40)) :])
        if i % 7 == 0 and i:
            old = rows[int(r.integers(0, i))][1]
            parts.append(old[int(r.integers(0, 50)) : int(r.integers(100, 400))])
        parts.append(say(int(r.integers(0, 40))))
        rows.append((i, "é".join(parts)))
    rows += [(200 + i, rows[5][1]) for i in range(9)]
    near = rows[8][1]
    rows += [(300 + i, near[: 40 + 7 * i] + "#" + near[41 + 7 * i :]) for i in range(30)]
    rows += [(400, None), (401, ""), (402, "x" * 99), (403, "x" * 100), (404, "x" * 350), (405, "ab" * 300), (None, rows[3][1]), (7, rows[7][1]), (406, say(9000))]
    rows.append((407, rows[-1][1][5000:30000]))
    return rows


def check(spark, rows, **limits):
    df = spark.createDataFrame([(i, t, "p", 1) for i, t in rows], "doc_id long, text string, part string, id int")
    got = sorted(map(tuple, substring_dedup.substring_digest(df, **limits).collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert got == brute(rows)


def test_against_all_strings(spark):
    check(spark, texts())


def test_many_contexts_and_chunks(spark):
    check(spark, texts()[:70], many=3, chunk=500)


def test_cut_texts(spark):
    shared = "".join(chr(0xE0 + i * i % 23) + chr(0xE0 + i * 7 % 19) for i in range(60))
    rows = [(1, shared + "tail"), (2, "x" + shared), (3, None), (3, None)]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, runs int")
    got = sorted((r.doc_id, r.text or "", r.runs) for r in substring_dedup.cut_texts(df).collect())
    assert got == [(1, shared + "tail", 7), (2, "x", 7), (3, "", 7), (3, "", 7)]
    assert substring_dedup.substring_digest(df.limit(0)).count() == 0
