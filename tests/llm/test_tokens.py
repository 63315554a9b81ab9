import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quillspark.llm import packing, token_files
from quillspark.llm.tokens import WordIds, tokenizer_path

TEXTS = [None, "", "a", "Hello, World!! it's 'S 12.5 -.- x", "été. ﬁ  ok\x1cz\n\nq",
         "Ünï—dash… “quote”. <|endoftext|>!! a<|startoftext|>b", "word " * 9000, "x" * 3000, "ΣΑΣ. ИЖ! 日本語。 ok"]
ROWS = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(None, "tail one", None, None, None), (3, "twice", "en", "s", 1), (3, "twice", "en", "s", 1)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, sequence_id string, start long")


def truth(text):
    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_cached_words_equal_library():
    for most in (3, 400_000):
        encoder = WordIds(tokenizer_path(), most=most, longest=20)
        for _ in range(2):
            got = encoder.documents(pa.array(TEXTS, pa.string()))
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [truth(t) for t in TEXTS]


def test_any_text_equals_library():
    r = random.Random(1)
    signs = [*"aabcXYZé ÉßÿÞ÷×ªµº'\u0301\u030c\u00a0\u2003\t\n\x0b\x1c\x00\x7f01239.,!?-<|>|&#  日Σςİﬁ½²٣", "<|endoftext|>", "<|startoftext|>", "<|", "'S", "It's", "é.", "a1b2", "x'll"]
    texts = pa.array([*("".join(r.choice(signs) for _ in range(r.randint(0, 30))) for _ in range(5000)), None, "", "  ", "a"])
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(tokenizer_path()).encode_batch([x or "" for x in texts.to_pylist()], add_special_tokens=False)]
    encoder = WordIds(tokenizer_path(), most=2000)
    assert list(encoder.documents(texts, 1 << 12)) == list(encoder.documents(texts.cast(pa.large_string()))) == want
    assert list(encoder.documents(texts.slice(7, 90))) == want[7:97]
    assert list(encoder.documents(texts.slice(0, 0))) == []


def test_other_kinds_of_file_are_refused():
    with pytest.raises(ValueError):
        WordIds(tokenizer_path("byte_bpe_50k.json"))


@pytest.mark.parametrize("bits", [1, 3, 8, 13, 16, 17, 31])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000).astype(np.uint32)
    data = np.frombuffer(token_files.pack(ids, bits), np.uint8)
    assert len(data) == (1000 * bits + 7) // 8
    for a, n in ((0, 1000), (17, 3), (999, 1), (5, 0)):
        assert token_files.unpack(data, bits, a, n).tolist() == ids[a : a + n].tolist()


def test_token_files(spark):
    got = token_files.token_file_digest(frame(spark), block_ids=7).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None), r[1] or ""))
    start, want = 0, []
    for r in order:
        ids = truth(r[1]) + [1]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_files.token_file_digest(frame(spark, [])).count() == 0


def test_packing(spark):
    got = packing.pack_sequences(frame(spark), with_ids=True, block_tokens=6000).collect()
    want = sorted((truth(r[1]) + [2] for r in ROWS), key=str)
    by_seq, by_doc = {}, {}
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.ids))
    for pieces in by_seq.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0
    assert sum(n for p in by_seq.values() for _, n in p) == sum(map(len, want))
    assert sorted(i for _, p in by_doc.items() for _, ids in p for i in ids) == sorted(i for w in want for i in w)
    whole = {k: [i for _, ids in sorted(p) for i in ids] for k, p in by_doc.items() if k[0] not in (3,)}
    assert all(v in want for v in whole.values())
    assert packing.pack_sequences(frame(spark, [])).count() == 0


def test_assignment_is_balanced():
    lengths = np.random.default_rng(1).integers(1, 3000, 900).tolist()
    pieces = packing.assign(lengths)
    full = {}
    for _, _, n, s, _ in pieces:
        full[s] = full.get(s, 0) + n
    assert sum(full.values()) == sum(lengths) and all(v & (v - 1) == 0 for v in full.values())
    assert len(pieces) < 1.6 * len(lengths)


def plain_assignment(lengths, length=4096, quadratic=1 / 4096):
    """The rule in words: full sequences first, then the longest rest to the cheapest sequence with room for it, else cut over the cheapest."""
    full = [n // length for n in lengths]
    rest = [n % length for n in lengths]
    total = sum(rest)
    room = [length] * (total // length) + [1 << b for b in range(20, -1, -1) if total % length >> b & 1]
    cost, pieces = [0.0] * len(room), {}
    for i in sorted(range(len(lengths)), key=lambda i: -rest[i]):
        whole = [s for s in range(len(room)) if room[s] >= rest[i]]
        while rest[i]:
            fits = whole or [s for s in range(len(room)) if room[s]]
            s = min(fits, key=lambda s: (cost[s], s))
            n = min(rest[i], room[s])
            pieces.setdefault(i, []).append((n, sum(full) + s))
            room[s], cost[s], rest[i] = room[s] - n, cost[s] + n + quadratic * n * n, rest[i] - n
    return full, pieces


def test_assignment_equals_the_rule():
    for seed in range(5):
        lengths = np.random.default_rng(seed).integers(1, [300, 3000, 9000, 5, 4097][seed], 150).tolist()
        full, want = plain_assignment(lengths)
        got, whole = {}, [0] * len(lengths)
        for i, _, n, s, _ in packing.assign(lengths):
            if s < sum(full):
                whole[i] += 1
            else:
                got.setdefault(i, []).append((n, s))
        assert whole == full and got == want


def test_balance():
    """Costs of full sequences lie close together, closer than if documents are packed in their order."""
    lengths = np.random.default_rng(8).integers(20, 900, 2000).tolist()
    cost = lambda pieces: np.array([sum(n + n * n / 4096 for n in p) for p in pieces])
    by_sequence = {}
    for _, _, n, s, _ in packing.assign(lengths):
        by_sequence.setdefault(s, []).append(n)
    own = cost([p for p in by_sequence.values() if sum(p) == 4096])
    in_order, rest = [[]], 4096
    for n in lengths:
        while n:
            part = min(n, rest)
            in_order[-1].append(part)
            n, rest = n - part, rest - part
            if not rest:
                in_order.append([])
                rest = 4096
    assert own.std() < 0.6 * cost(in_order[:-1]).std()


def test_decomposed_capitals_are_composed_first():
    for text in ("J\u030cohn", "T\u0308om met J\u030cOHN, Tom and JOHN", "plain J\u030cohn <|x"):
        assert next(WordIds(tokenizer_path()).documents(pa.array([text]))) == b"".join(x.to_bytes(4, "little") for x in truth(text))
