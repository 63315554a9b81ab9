"""The pipeline against a plain version that goes document by document."""

import zlib

import corpus_pipeline
import pytest
from tests.llm.test_line_dedup import brute as plain_lines
from tests.llm.test_similar import plain_set
from tests.llm.test_tokens import truth

SF = "/root/testdata/sf0.001"


def plain_cut(rows, length=100):
    import numpy as np

    seen, out = set(), []
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10_000, None, "en", "s", 0), (10_001, "", None, None, None), (10_002, "12 34 !!", "en", "s", 8), (10_003, "one word only text", None, "s", 18)], docs.schema)
    docs = docs.unionByName(odd)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def table(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "SimHash near-dedup", "suffix-array dedup", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages(stages):
    docs, known, lines, near, cut, packed = stages
    assert all(s.columns == docs.columns for s in stages[:5])
    given = [(i, t) for i, t in table(known)]
    lost = {i for i, _ in [(r.doc_id, r.text) for r in docs.collect()]} - {i for i, _ in given}
    assert lost == {10_000, 10_001, 10_002}
    want = sorted((i, t) for i, t in plain_lines(given) if t.strip())
    assert table(lines) == want
    sets = [plain_set(t) for _, t in want]
    names = list(range(len(want)))
    for i in range(len(want)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and names[i] != names[j]:
                names = [names[j] if x == names[i] else x for x in names]
    seen = set()
    want = [w for w, n in zip(want, names, strict=True) if n not in seen and not seen.add(n)]
    assert table(near) == want
    want = sorted((i, t) for i, t in plain_cut(want) if t.strip())
    assert table(cut) == want
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    ids = {i: truth(t) + [2] for i, t in want}
    pieces = {}
    for r in packed.collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {i: sum(n for _, n in p) for i, p in pieces.items()} == {i: len(x) for i, x in ids.items()}


def test_empty_null_repeated_and_clashing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, "plain words of a text\nand a line", "en", "s", 0, 1, 2), (1, "plain words of a text\nand a line", "en", "s", 0, 1, 2), (None, "another text without an id", None, None, None, 3, 4), (None, None, None, None, None, None, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row int, key int")
    for given in (docs.limit(0), odd, odd.limit(0)):
        out = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SF).persist()
            assert out.columns == given.columns
        assert {r.text for r in out.collect()} == {r.text for r in given.collect()} - {None}
        packed = corpus_pipeline.STAGES[-1][1](spark, out, SF)
        assert packed.count() >= out.count()
