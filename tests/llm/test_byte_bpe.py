import hashlib

import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillspark.llm import byte_bpe
from quillspark.llm.tokens import tokenizer_path

PATH = tokenizer_path(byte_bpe.BYTE_FILE)
BPE, LIBRARY = byte_bpe.ByteBpe(PATH), Tokenizer.from_file(PATH)
TEXTS = [None, "", " ", "a\n\n b \t c  ", "it's We'LL 'x", "<|endoftext|> hi<|endoftext|><|endoftext|>", "été ñ 日本語 👍🏽\x1c\x85\xa0q", "aaaaaaaaaaaaaaaa" * 40, "\r\n\r\n12345 x²½", " " * 700, "word " * 5000]


def same(text):
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    got = BPE.encode(text)
    assert got.tolist() == ids
    assert BPE.decode(got) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_cases():
    for t in TEXTS:
        same(t or "")
    for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist():
        same(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abetinhs '.\n1é日 "), max_size=60))
def test_random_words(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=20))
def test_any_ids_decode(ids):
    import numpy as np

    assert BPE.decode(np.array(ids, "<u4")) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_operator(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "x", 1), (1, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    got = byte_bpe.encode_decode(df, with_ids=True).collect()
    assert len(got) == len(rows)
    for r, (i, t, _) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert (r.doc_id, r.n_tokens, r.ids, r.decoded) == (i, len(ids), ids, t or "")
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.encode_decode(df.limit(0)).count() == 0
