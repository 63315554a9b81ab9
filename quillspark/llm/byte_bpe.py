"""Byte-level BPE: exact merges in linear time by backtracking over longest matches.

An Aho-Corasick automaton finds, in one pass over a word, the longest token from every
position. The encoder appends that token if it may follow the last one, tries its longest
proper prefix token if not, and takes back the last token when no prefix is left. Two
tokens may stand side by side if merging their join again would give just those two; the
answers are kept in a pair table. Positions that turned out to be dead ends are marked, so
each is left once. Decoding gathers byte runs of one blob through an offset table.

Words (pieces of the pre-tokenizer's pattern) are encoded once per worker while the
bounded cache holds them. Texts may hold special tokens, which stand for themselves.

Defined cases: a null or empty text has no tokens; null and repeated ids each give a row;
ill-formed UTF-8 is read as U+FFFD; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .tokens import tokenizer_path

BYTE_FILE = "byte_bpe_50k.json"
# The White_Space characters of Unicode, and the public pre-tokenizer pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The file's letter for each byte: printable Latin-1 stands for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    def __init__(self, path: str, most: int = 800_000, longest: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocabulary = {raw(t): i for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        # Inner numbers follow the order of merging: bytes, then merges by rank.
        self.token: list[bytes] = [bytes([b]) for b in range(256)]
        self.left, self.right = list(range(256)), list(range(256))
        number, self.pair = {t: n for n, t in enumerate(self.token)}, {}
        for merge in spec["model"]["merges"]:
            a, b = (raw(x) for x in (merge if isinstance(merge, list) else merge.split(" ")))
            if a + b in number:
                raise ValueError("two merges make one token")
            number[a + b] = self.pair[number[a], number[b]] = len(self.token)
            self.token.append(a + b)
            self.left.append(number[a])
            self.right.append(number[b])
        self.size = [len(t) for t in self.token]
        self.id = [vocabulary[t] for t in self.token]
        self.shorter = [next((number[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in number), -1) for t in self.token]
        self.automaton = ahocorasick.Automaton()
        for n, t in enumerate(self.token):
            self.automaton.add_word(t.decode("latin-1"), (len(t), n))
        self.automaton.make_automaton()
        self.beside: dict[tuple[int, int], bool] = {}
        text_of = {i: t for t, i in vocabulary.items()} | {i: t.encode() for t, i in self.specials.items()}
        most_id = max(text_of)
        self.blob, self.offsets = self._table([text_of.get(i, b"") for i in range(most_id + 1)])
        self.numerals, self.numeral_offsets = self._table([b"%d," % i for i in range(most_id + 1)])
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.known: dict[str, bytes] = {}
        self.most, self.longest = most, longest

    @staticmethod
    def _table(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a b`` stays as it is: no merge across the border comes before those that make a and b."""
        known = self.beside.get((a, b))
        if known is None:
            if len(self.beside) > 2_000_000:
                self.beside.clear()
            known = self.beside[a, b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        # Undo the merges of both sides from the last one back; ``before`` is the merge undone
        # last, so a pair that joins earlier than it would have been merged in its place.
        before = len(self.token)
        while True:
            if self.pair.get((a, b), before) < before:
                return False
            # On the same rank the left part merges first, hence the half step for b.
            if a > b and a >= 256:
                before, a = a, self.right[a]
            elif b >= 256:
                before, b = b + 1, self.left[b]
            else:
                return True

    def word(self, raw: bytes) -> list[int]:
        """Inner numbers of one word's tokens."""
        n = len(raw)
        if not n:
            return []
        longest = [-1] * n
        for end, (size, number) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - size + 1] = number
        size, shorter, compatible = self.size, self.shorter, self.compatible
        dead, out, at, token = bytearray(n + 1), [], 0, longest[0]
        while True:
            end = at + size[token]
            if not dead[end] and (not out or compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                # its end is dead now, so the next round tries its prefixes

    def _ids(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = b"".join([self.id[t].to_bytes(4, "little") for t in self.word(piece.encode())])
            if len(piece) <= self.longest:
                self.known[piece] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        out = []
        for n, part in enumerate(self.split.split(text) if self.split else [text]):
            if n % 2:
                out.append(self.specials[part].to_bytes(4, "little"))
            else:
                pieces = self.pattern.findall(part)
                try:
                    out += map(self.known.__getitem__, pieces)
                except KeyError:
                    del out[n:]
                    out.append(b"".join(map(self._ids, pieces)))
                    continue
                out[n:] = [b"".join(out[n:])]
        return np.frombuffer(b"".join(out), "<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return gather(self.blob, self.offsets, ids)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def numerals_of(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return gather(self.numerals, self.numeral_offsets, ids)[:-1]


def gather(blob: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
    """The byte runs of ``ids`` in turn."""
    starts = offsets[ids]
    sizes = offsets[ids.astype(np.int64) + 1] - starts
    ends = np.cumsum(sizes)
    if not len(ends):
        return b""
    return blob[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes()


_HELD: dict[str, ByteBpe] = {}


def byte_bpe(path: str) -> ByteBpe:
    if path not in _HELD:
        _HELD[path] = ByteBpe(path)
    return _HELD[path]


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode it again; digests, and with ``with_ids`` ids and text."""
    path = path or tokenizer_path(BYTE_FILE)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                got: list[list] = [[] for _ in range(6)]
                for text in storage.texts_of(batch.column(1).slice(at, 1024)):
                    ids = bpe.encode(text.decode("utf-8", "replace"))
                    decoded = bpe.decode(ids)
                    row = (len(ids), hashlib.sha256(bpe.numerals_of(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    for column, v in zip(got, (row + (ids, decoded)) if with_ids else row, strict=False):
                        column.append(v)
                columns = [batch.column(0).slice(at, 1024), pa.array(got[0], pa.int64()), pa.array(got[1], pa.string()), pa.array(got[2], pa.string())]
                if with_ids:
                    columns += [pa.array([x.astype(np.int64) for x in got[3]], pa.list_(pa.int64())), pa.array(got[4], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(storage.tidy(run), schema)
