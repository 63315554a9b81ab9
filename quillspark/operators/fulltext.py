"""Full-text search: postings, BM25 over weighted fields, boost by in-links."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

FIELD_WEIGHTS = {"title": 4.0, "alt_titles": 3.0, "body": 1.0}
K1, B = 1.2, 0.75


FIELDS = tuple(FIELD_WEIGHTS)


def _words(field: str) -> Column:
    return text.terms(F.coalesce(field, F.lit("")))


def postings(docs: DataFrame, fields: tuple[str, ...] = FIELDS, stem: bool = False, only: list[str] | None = None) -> DataFrame:
    """``(term, field, entry, tf, len)`` of ``docs (entry, *fields)``; len counts the field's terms.

    With ``only``, postings of these terms alone: other words are dropped before they become rows.
    Texts do not go to Python to be stemmed: with ``only`` it sees each different word once, and the
    forms of these terms, as few as a stem has endings, are looked up; else it sees a row a word.
    """
    by_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), _words(f).alias("words")) for f in fields]))
    # Counted before the words become rows, so that no row of a word carries all of them.
    found = docs.select("entry", by_field.alias("f")).select("entry", "f.field", F.size("f.words").alias("len"), "f.words")
    kept = F.col("words") if only is None or stem else F.filter("words", lambda w: w.isin(only))
    rows = found.select("entry", "field", "len", F.explode(kept).alias("term"))
    if stem and only is not None:
        known = found.select(F.explode("words").alias("term")).distinct().withColumn("stem", stem_each("term"))
        rows = rows.join(F.broadcast(known.where(F.col("stem").isin(only))), "term").drop("term").withColumnRenamed("stem", "term")
    elif stem:
        rows = rows.withColumn("term", stem_each("term"))
    return rows.groupBy("term", "field", "entry", "len").agg(F.count("*").alias("tf")).select("term", "field", "entry", "tf", "len")


def field_stats(posted: DataFrame, docs: DataFrame) -> DataFrame:
    """``(field, avg_len, n_docs)``, three rows: mean terms over all documents."""
    lengths = posted.select("field", "entry", "len").distinct().groupBy("field").agg(F.sum("len").alias("total"))
    return lengths.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs")))).select("field", (F.col("total") / F.col("n_docs")).alias("avg_len"), "n_docs")


def lengths(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``field_stats`` from the documents themselves, stemmed or not, in one pass that exchanges a row a task."""
    sums = docs.agg(F.count("*").alias("n_docs"), *[F.sum(F.size(_words(f))).alias(f) for f in fields])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("total")) for f in fields])).alias("s")
    return sums.select("n_docs", each).select("s.field", (F.col("s.total") / F.col("n_docs")).alias("avg_len"), "n_docs").where("avg_len > 0")


def term_statistics(docs: DataFrame, field: str = "body") -> DataFrame:
    """``(term, df, cf)``: documents and occurrences of each term, summed in each task before the exchange."""
    words = _words(field)
    seen = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    met = F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    return docs.select(F.inline(F.concat(seen, met))).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def query_terms(spark: SparkSession, query: str, stem: bool = False) -> list[str]:
    """The terms that ``search`` looks for."""
    found = text.terms(text.clean_query(F.lit(query)))
    return spark.range(1).select((stem_all(found) if stem else found).alias("w")).first()["w"]


def bm25(posted: DataFrame, stats: DataFrame, words: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``(entry, matched, score)``: documents with any of ``words (term)``, distinct words matched, weighted BM25."""
    weights = weights or FIELD_WEIGHTS
    hits = posted.join(F.broadcast(words.select("term").distinct()), "term")
    df = hits.groupBy("term", "field").agg(F.count("*").alias("df"))
    weight = F.coalesce(*[F.when(F.col("field") == f, F.lit(w)) for f, w in weights.items()])
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len"))) * weight
    # Both small sides hold one row a field and query word at most, whatever the data.
    scored = hits.join(F.broadcast(df), ["term", "field"]).join(F.broadcast(stats), "field").select("entry", "term", part.alias("part"))
    return scored.groupBy("entry").agg(F.countDistinct("term").alias("matched"), F.sum("part").alias("score"))


def search(posted: DataFrame, stats: DataFrame, inbound: DataFrame, query: str, limit: int = 10, stem: bool = False) -> DataFrame:
    """``(entry, score)``: documents with all words of a query, or with any if none has all; best first."""
    spark = posted.sparkSession
    cleaned = text.clean_query(F.lit(query))
    found = text.terms(cleaned)
    words = spark.range(1).select(F.explode(stem_all(found) if stem else found).alias("term")).distinct()
    if limit <= 0:
        return posted.limit(0).select("entry", F.lit(0.0).alias("score"))
    n = words.agg(F.count("*").alias("__n"))
    hits = bm25(posted, stats, words).crossJoin(F.broadcast(n))
    full = hits.agg(F.coalesce(F.max(F.col("matched") == F.col("__n")), F.lit(False)).alias("__all"))
    kept = hits.crossJoin(F.broadcast(full)).where(~F.col("__all") | (F.col("matched") == F.col("__n")))
    boosted = kept.join(inbound.withColumnRenamed("node", "entry"), "entry", "left").select("entry", text.boosted(F.col("score"), F.coalesce("inbound", F.lit(0))).alias("score"))
    return boosted.orderBy(F.desc("score"), "entry").limit(limit)


def blended(title_hits: DataFrame, text_hits: DataFrame, limit: int) -> DataFrame:
    """Title hits ``(entry, position)``, then text hits that are none, cut at ``limit``."""
    new = text_hits.join(title_hits.select("entry"), "entry", "left_anti")
    both = title_hits.select("entry", "position", F.lit(0).alias("source")).unionByName(new.select("entry", "position", F.lit(1).alias("source")))
    return both.orderBy("source", "position").limit(limit)


VOWELS = "aeiouy"
# Fixed values of the published English stemmer.
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
LI_ENDINGS = "cdeghkmnrt"
STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
WHOLE = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")


def _after_vowel(w: str, start: int) -> int:
    for i in range(start + 1, len(w)):
        if w[i] not in VOWELS and w[i - 1] in VOWELS:
            return i + 1
    return len(w)


def _short(w: str) -> bool:
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


@lru_cache(maxsize=50_000)
def stemmed(word: str) -> str:
    """English (Porter2) stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in WHOLE:
        return WHOLE[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in VOWELS) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _after_vowel(w, 0) if r1 is None else r1
    r2 = _after_vowel(w, r1)
    has_vowel = lambda s: any(c in VOWELS for c in s)
    for end in ("'s'", "'s", "'"):
        if w.endswith(end):
            w = w[: -len(end)]
            break
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and has_vowel(w[:-2]):
        w = w[:-1]
    if w in AFTER_1A:
        return w
    if w.endswith(("eedly", "eed")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    else:
        end = next((e for e in ("ingly", "edly", "ing", "ed") if w.endswith(e)), "")
        if end and has_vowel(w[: -len(end)]):
            w = w[: -len(end)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif _short(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"
    end = next(((a, b) for a, b in STEP2 if w.endswith(a)), None)
    if end:
        if len(w) - len(end[0]) >= r1:
            w = w[: -len(end[0])] + end[1]
    elif w.endswith("ogi"):
        w = w[:-1] if len(w) - 3 >= r1 and w[-4:-3] == "l" else w
    elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] and w[-3] in LI_ENDINGS:
        w = w[:-2]
    end = next(((a, b) for a, b in STEP3 if w.endswith(a)), None)
    if end:
        if len(w) - len(end[0]) >= r1:
            w = w[: -len(end[0])] + end[1]
    elif w.endswith("ative") and len(w) - 5 >= r2:
        w = w[:-5]
    end = next((a for a in STEP4 if w.endswith(a)), None)
    if end:
        if len(w) - len(end) >= r2:
            w = w[: -len(end)]
    elif w.endswith("ion") and len(w) - 3 >= r2 and w[-4:-3] in ("s", "t"):
        w = w[:-3]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stem_all(words: pd.Series) -> pd.Series:
    """Arrow function: stems of an array of words; for queries, since a batch of texts may be large."""
    return words.map(lambda ws: [stemmed(w) for w in ws], na_action="ignore")


@F.pandas_udf(T.StringType())
def stem_each(words: pd.Series) -> pd.Series:
    """Arrow function: the stem of a word."""
    return words.map(stemmed, na_action="ignore")
