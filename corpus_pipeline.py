"""A corpus pipeline over ``documents``: five stages, each made of one training-data operator.

Every stage takes ``(spark, docs, sf_dir)`` and returns a table that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``, with ``n_chars`` brought up to date wherever a text changes.

Defined cases: documents without text or without a letter have no language and go at once;
a document that a cut leaves without any character but white space goes; ids may be null
or repeated (see the operators); an empty table gives an empty table of the last schema.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import language, line_dedup, packing, similar, storage, substring_dedup


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; profiles are learned from all that name theirs.

    Only ``und`` is rejected: short clean texts have low scores too.
    """
    return language.keep_known(docs, language.learn(docs), least=0.0)


def _left(docs: DataFrame, columns: list[str]) -> DataFrame:
    kept = docs.where(F.col("text").rlike(r"\S")).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the line blocks that an earlier document holds too."""
    return _left(line_dedup.dedup_lines(docs), docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return similar.keep_first(docs)


def drop_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier."""
    return _left(substring_dedup.cut_texts(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences balanced by cost."""
    return packing.pack_sequences(docs)


STAGES = [
    ("language ID", identify),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near),
    ("suffix-array dedup", drop_substrings),
    ("packing", pack),
]
#: Alignment, fingerprints and tokens are beyond SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = storage.settle(docs, f"stage-{n}")
    return docs
