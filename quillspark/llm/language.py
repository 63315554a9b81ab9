"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. An
n-gram (three letters of a word, its borders counting as a sign) binds its letters'
vectors, each rotated by its place, through multiplication; a text bundles its n-grams by
adding them, and so does a language over all its training texts. A text gets the language
whose prototype has the highest cosine with it; that cosine, cut to 0 .. 1, is the score.

Training sums n-gram counts per task and language before any vector is made, and gives
one partial prototype a task and language; their sums (languages x dimensions, checked
against ``MOST_LANGUAGES``) are all that reaches the driver.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is every
text if nothing was learned; rows without language teach nothing; ties go to the first
language by name; null and repeated ids each give a row; an empty table gives no rows;
other columns are ignored (``keep_known`` passes all columns through).
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage

UNKNOWN = "und"
MOST_LANGUAGES = 2000


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """Code point -> its lower-case letter, 0 where it is no letter."""
    out = np.zeros(0x110000, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def grams(text: bytes) -> np.ndarray:
    """Codes of the three-letter groups around each letter of a text."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    x = np.zeros(len(points) + 2, np.int64)
    x[1:-1] = folded()[points]
    inner = x[1:-1]
    return (x[:-2] << 42 | inner << 21 | x[2:])[inner != 0]


class Letters:
    """Random vectors of letters, and bound vectors of n-grams."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.place = np.full(0x110000, -1, np.int32)
        self.tables = [np.empty((0, dimensions), np.int8)] * 3

    def _rows(self, points: np.ndarray) -> np.ndarray:
        if (self.place[points] < 0).any():
            new = np.unique(points[self.place[points] < 0])
            made = np.stack([np.random.default_rng([self.seed, int(p)]).integers(0, 2, self.dimensions, np.int8) * 2 - 1 for p in new])
            self.place[new] = len(self.tables[0]) + np.arange(len(new))
            self.tables = [np.concatenate((t, np.roll(made, 2 - i, axis=1))) for i, t in enumerate(self.tables)]
        return self.place[points]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the n-grams' vectors, each as often as it counts."""
        out = np.zeros(self.dimensions)
        mask = (1 << 21) - 1
        for at in range(0, len(codes), 4096):
            part = codes[at : at + 4096]
            a, b, c = (self._rows(part >> s & mask) for s in (42, 21, 0))
            first, second, third = self.tables
            out += counts[at : at + 4096].astype(np.float32) @ (first[a] * second[b] * third[c]).astype(np.float32)
        return out


@lru_cache(maxsize=4)
def letters(dimensions: int, seed: int) -> Letters:
    return Letters(dimensions, seed)


class Profiles:
    """Language prototypes, small enough to go with a task."""

    def __init__(self, sums: dict[str, np.ndarray], dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.names = sorted(k for k, v in sums.items() if np.abs(v).any())
        self.unit = np.stack([sums[k] / np.linalg.norm(sums[k]) for k in self.names]) if self.names else np.empty((0, dimensions))

    def predict(self, text: bytes) -> tuple[str, float]:
        codes = grams(text) if self.names and text else ()
        if not len(codes):
            return UNKNOWN, 0.0
        vector = letters(self.dimensions, self.seed).bundle(*np.unique(codes, return_counts=True))
        norm = float(np.linalg.norm(vector))
        if not norm:
            return UNKNOWN, 0.0
        cosines = self.unit @ vector / norm
        best = int(cosines.argmax())
        return self.names[best], float(min(1.0, max(0.0, cosines[best])))


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = 512, seed: int = 11) -> Profiles:
    """Prototypes of the languages of all rows of ``df`` that have text and language."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at in range(0, batch.num_rows, 1024):
                seen: dict[str, list[np.ndarray]] = {}
                for lang, text in zip(langs[at : at + 1024], storage.texts_of(batch.column(0).slice(at, 1024)), strict=True):
                    if text:
                        seen.setdefault(lang, []).append(grams(text))
                for lang, codes in seen.items():
                    made = letters(dimensions, seed).bundle(*np.unique(np.concatenate(codes), return_counts=True))
                    sums[lang] = sums.get(lang, 0) + np.rint(made).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.int64()))], ["lang", "part"])

    labelled = df.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = labelled.mapInArrow(storage.tidy(count), "lang string, part array<long>")
    total = parts.select("lang", F.posexplode("part").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"))
    rows = total.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v")).limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    return Profiles({r["lang"]: np.array([x["v"] for x in r["v"]], float) for r in rows}, dimensions, seed)


def identify(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, lang_pred, score)`` of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                found = [profiles.predict(t) for t in storage.texts_of(batch.column(1).slice(at, 1024))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1024), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(storage.tidy(run), "doc_id long, lang_pred string, score double")


def keep_known(df: DataFrame, profiles: Profiles, text_col: str = "text", least: float = 0.1) -> DataFrame:
    """Rows of ``df``, all columns, whose text has a language with a score of ``least`` or more.

    If nothing was learned, no text has a language, and rows with a letter stay.
    """
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                texts = storage.texts_of(part.column(at))
                if profiles.names:
                    kept = [name != UNKNOWN and score >= least for name, score in map(profiles.predict, texts)]
                else:
                    kept = [len(grams(t)) > 0 for t in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

    return df.mapInArrow(storage.tidy(run), df.schema)


def held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether a row is kept for testing; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == part
