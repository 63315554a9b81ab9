import hashlib
import zlib

import numpy as np
import pytest

from quillspark.llm import webp
from tests.llm import vp8l_writer


def picture(colours, shape=(13, 21), seed=1):
    r = np.random.default_rng(seed)
    table = r.integers(0, 1 << 32, colours, dtype=np.uint64).astype(np.uint32)
    out = table[r.integers(0, colours, shape)]
    out[5] = out[4]
    out[8:, 3:9] = table[0]
    return out


@pytest.mark.parametrize("kinds", [(), (0,), (1,), (2,), (0, 1, 2), (2, 1, 0), (3,), (3, 0), (1, 3)])
@pytest.mark.parametrize("colours", [1, 2, 4, 15, 60])
@pytest.mark.parametrize("extra", [{}, {"cache_bits": 4}, {"block": 2}, {"cache_bits": 7, "block": 3}, {"search": False}])
def test_every_feature(kinds, colours, extra):
    if kinds == (1, 3):
        colours = min(colours, 1)
    want = picture(colours)
    got = webp.decode(vp8l_writer.write(want, kinds, **extra))
    assert np.array_equal(got, want.view(np.uint8).reshape(*want.shape, 4)[..., [2, 1, 0, 3]])


def test_near_distances():
    assert len(webp.NEAR) == len(set(webp.NEAR)) == 120
    far = [x * x + y * y for x, y in webp.NEAR]
    assert far == sorted(far)


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 5000, 70_000, 192 * 16384 + 5])
def test_texts_round_trip(n):
    r = np.random.default_rng(n)
    for alphabet in (1, 2, 3, 40, 256):
        text = bytes(r.integers(0, alphabet, n, dtype=np.uint8)) if alphabet == 256 else bytes(r.integers(97, 97 + alphabet, n, dtype=np.uint8))
        if n > 1_000_000 and alphabet != 40:
            continue
        pixels = webp.media_pixels(webp.text_media(text)).tobytes()
        assert pixels == text + b" " * (-n % 192 or (192 if not n else 0))


def test_steep_counts_stay_short():
    counts = np.array([1 << i for i in range(30)])
    lengths = webp.code_lengths(counts)
    assert lengths.max() <= 12 and sum(2.0 ** -lengths) == 1


def test_damage_is_noticed():
    data = webp.text_media(b"some text " * 100)
    for cut in (4, 19, 30, len(data) // 2):
        with pytest.raises(ValueError):
            webp.media_pixels(data[:cut])


def test_operator(spark):
    rows = [(1, "héllo", 5), (2, None, 5), (3, "", 5), (None, "x", 5), (1, "héllo", 5), (4, "long " * 60000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature int")
    got = webp.media_columns(df, with_media=True).collect()
    want = {t or "": None for _, t, _ in rows}
    assert len(got) == len(rows)
    for r in got:
        text = dict((i, t or "") for i, t, _ in rows)[r.doc_id].encode()
        payload = text + b" " * (-len(text) % 192 or (192 if not text else 0))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.pixels == payload and r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        want[text.decode()] = want[text.decode()] or (r.feature, r.media)
        assert want[text.decode()] == (r.feature, r.media)
    assert webp.media_columns(df.limit(0)).count() == 0
