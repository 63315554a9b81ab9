import numpy as np
import pytest

from quillspark.llm.suffix_ranks import suffix_ranks


@pytest.mark.parametrize("text", ["", "a", "mississippi", "a" * 31, "abcabcabd" * 4, "yabbadabbado"])
def test_order_of_suffixes(spark, text):
    df = spark.createDataFrame([*enumerate(text.encode())], "i long, c long")
    got = [r.i for r in sorted(suffix_ranks(df, at_once=6).collect(), key=lambda r: r.place)]
    assert got == sorted(range(len(text)), key=lambda i: text[i:])


def test_long_repeats(spark):
    x = np.random.default_rng(1).integers(97, 99, 150).tolist() * 2
    df = spark.createDataFrame([*enumerate(x)], "i long, c long").repartition(3)
    got = [r.i for r in sorted(suffix_ranks(df, at_once=100).collect(), key=lambda r: r.place)]
    assert got == sorted(range(len(x)), key=lambda i: x[i:])
