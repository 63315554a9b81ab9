"""Results that do not depend on how many rows there are or how Spark deals them out."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspark import registry
from quillspark.operators import fulltext, sections


@pytest.mark.parametrize("seed", range(4))
def test_random_article_counts_in_order_of_entry(spark, seed):
    n = 300_000
    entries = spark.range(0, n, 1, 8).select((F.col("id") * 7 - n).alias("entry"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if there were too much for one task
    try:
        assert [r["entry"] for r in sections.random_article(entries, seed).collect()] == [sections.mixed_seed(seed) % n * 7 - n]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("values", [[], [5], [None], [3, None, 3, 1], [-(1 << 63), (1 << 63) - 1, 0, -1, None, 1 << 40], [2, 1026, 1025]])
def test_random_article_of_few(spark, values):
    entries = spark.createDataFrame([(v,) for v in values], "entry long")
    ordered = sorted(values, key=lambda v: (v is None, v))
    for seed in range(3):
        assert [r["entry"] for r in sections.random_article(entries, seed).collect()] == ([ordered[sections.mixed_seed(seed) % len(values)]] if values else [])


def test_suggest_rows_where_entries_are_shared(spark, tmp_path):
    """Keys a million apart: an article's key is also the entry of another one's alias."""
    parts = [(i * 1000000 + 1, "red bolt", f"Brand#{i}", "SMALL") for i in range(5)]
    lines = [(o, i * 1000000 + 1) for i, n in enumerate((9, 1, 7, 6, 5)) for o in range(n)]  # 1 + 3 + 3 + 3 rows, then 2 that the limit cuts off
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    answer = con.execute(registry.ORACLE_SQL["suggest_rows"])
    columns = [d[0] for d in answer.description]
    assert sorted(map(str, answer.fetchall())) == sorted(str(tuple(r)) for r in registry.QUERIES["suggest_rows"](spark, str(tmp_path)).select(*columns).collect())


@pytest.mark.parametrize("only", [None, ["be", "other", "absent"], []])
def test_stems_take_words_to_python_not_texts(spark, only):
    """A batch of Python holds so many words, however long the texts are."""
    bodies = ["being others Being", None, "", "x-ray others' other beings " * 300, "the die, dying"]
    docs = spark.createDataFrame([(n, "Others be" if n % 2 else None, b) for n, b in enumerate(bodies)], "entry long, title string, body string")
    posted = fulltext.postings(docs, ("title", "body"), stem=True, only=only)
    plan = posted._jdf.queryExecution().optimizedPlan().toString()
    assert "stem_all(" not in plan and ("stem_each(term" in plan or only == [])
    want = Counter()
    for n, b in enumerate(bodies):
        for field, value in (("title", "others be" if n % 2 else ""), ("body", (b or "").lower())):
            words = value.replace("-", " ").replace("'", " ").replace(",", " ").split()
            want.update((fulltext.stemmed(w), field, n, len(words)) for w in words if only is None or fulltext.stemmed(w) in only)
    assert {(r["term"], r["field"], r["entry"], r["len"]): r["tf"] for r in posted.collect()} == want
