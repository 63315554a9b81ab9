"""Token ids of whole texts by a public tokenizer file, cached by piece.

The file ``word_bpe_49k.json`` drops white space and cuts texts into pieces that are encoded
by themselves: runs of letters, single digits, runs of other signs. A batch of texts is cut
so in numpy, Arrow numbers the distinct pieces, and only those are looked up; each goes
through the ``tokenizers`` library once per worker (until the bounded cache is emptied).

Cut here are the white-space-separated chunks of Latin-1 letters, digits and ASCII signs but
the apostrophe, which has rules of its own; every other chunk (and one with the start of a
special token) stays whole. A piece of letters is lower case, composed and one pre-token,
so it goes straight to the library's BPE model, spelt in the byte alphabet that the file's
last pre-tokenizer writes; anything else takes the whole library path.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from .words import LOWER, laid_out, lots, numbered

WORD_FILE = "word_bpe_49k.json"
BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[33:127] = SIGN
KIND[[9, 10, 11, 12, 13, 32]] = BLANK
KIND[ord("0") : ord("9") + 1] = DIGIT
KIND[ord("a") : ord("z") + 1] = KIND[ord("A") : ord("Z") + 1] = LETTER
KIND[ord("'")] = OTHER
#: The byte alphabet: printable Latin-1 stands for itself, the other bytes follow from 256 on.
_OTHER = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SPELT = {b: 256 + n for n, b in enumerate(_OTHER)}


def cut(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of UTF-8 bytes: their bytes without gaps, where each ends there, where each begins in ``data``, their kinds."""
    kind, low = KIND[data], LOWER[data]
    # U+00C0 to U+00FF are two bytes, 0xC3 first; all but the signs of multiplication and division are letters.
    if len(wide := np.flatnonzero(data[:-1] == 0xC3)):
        second = data[wide + 1]
        wide = wide[(second >= 0x80) & (second <= 0xBF) & (second != 0x97) & (second != 0xB7)]
        kind[wide] = kind[wide + 1] = LETTER
        upper = wide[data[wide + 1] <= 0x9E] + 1
        low[upper] += 0x20
    special = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[special] = OTHER
    full = kind != BLANK
    before = np.concatenate(([False], full[:-1]))
    starts = np.flatnonzero(full & ~before)
    fresh = full & (~before | (kind == DIGIT))
    fresh[1:] |= full[1:] & (kind[1:] != kind[:-1])
    if len(odd := np.flatnonzero(kind == OTHER)):  # their chunks stay whole and as they are
        ends = np.flatnonzero(np.concatenate((before & ~full, full[-1:])))
        chunk = np.unique(np.searchsorted(starts, odd, side="right") - 1)
        a, b = starts[chunk], ends[chunk]
        size = b - a
        inside = np.repeat(a - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        low[inside] = data[inside]
        kind[inside] = OTHER
        fresh[inside] = False
        fresh[a] = True
    begins = np.flatnonzero(fresh)
    place = np.cumsum(full, dtype=np.int32)
    ends = np.concatenate((place[begins[1:]] - 1, place[-1:])) if len(begins) else np.empty(0, np.int64)
    return low[full], ends, begins, kind[begins]


def tokenizer_path(name: str = WORD_FILE) -> str:
    return public_tokenizers.path(name)


def check_kind(path: str) -> None:
    """Refuse a file to which the rules of this module do not apply."""
    with open(path, encoding="utf-8") as source:
        told = json.load(source)
    normal = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
    pieces = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = pieces[0] if pieces else {}
    pattern = split.get("pattern", {}).get("Regex", "")
    byte_level = len(pieces) == 2 and pieces[1]["type"] == "ByteLevel" and not pieces[1].get("use_regex", True) and not pieces[1].get("add_prefix_space", True)
    # The pattern's alternatives of an apostrophe come first; then letters, a digit, other signs.
    cuts = split.get("behavior") == "Removed" and split.get("invert") and pattern.endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+") and all(x.startswith("'") for x in pattern.split("|[")[0].split("|"))
    if normal != ["NFC", "Replace", "Lowercase"] or not cuts or not byte_level or told["model"].get("dropout"):
        raise ValueError(f"{path} is not a lower-casing word tokenizer that drops white space")


class WordIds:
    """Ids of pieces as little-endian unsigned 32-bit integers, kept for the pieces that come again."""

    def __init__(self, path: str, most: int = 400_000, longest: int = 64):
        check_kind(path)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most, self.longest = most, longest
        self.kept: dict[bytes, bytes] = {}

    def _learn(self, pieces: list[bytes], letters: list[bool]) -> list[bytes]:
        """Ids of new pieces; those short enough are kept."""
        tokenize = self.tokenizer.model.tokenize
        plain = [p for p, of_letters in zip(pieces, letters, strict=True) if of_letters]
        rest = [p for p, of_letters in zip(pieces, letters, strict=True) if not of_letters]
        spelt = [p.decode() if p.isascii() else p.decode("latin-1").translate(SPELT) for p in plain]
        new = {p: array("I", [t.id for t in tokenize(s)]).tobytes() for p, s in zip(plain, spelt, strict=True)}
        if rest:
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)
            new.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, found, strict=True))
        self.kept.update((p, b) for p, b in new.items() if len(p) <= self.longest)
        return [new[p] for p in pieces]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a string column, one text after the other, and how many each text has; null counts as empty."""
        data, stops = laid_out(column)
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(0, np.int64)
        packed, ends, begins, kinds = cut(data)
        index, chunks = numbered(packed, ends)
        n = len(chunks)
        kind = np.empty(n, np.uint8)
        kind[index] = kinds  # equal pieces are of one kind
        if len(self.kept) > self.most:
            self.kept.clear()
        found = list(map(self.kept.get, chunks))
        if missing := [i for i, b in enumerate(found) if b is None]:
            for i, b in zip(missing, self._learn([chunks[i] for i in missing], (kind[missing] == LETTER).tolist()), strict=True):
                found[i] = b
        size = np.fromiter(map(len, found), np.int64, n) >> 2
        pool = np.frombuffer(b"".join(found), "<u4")
        begin = np.cumsum(size) - size
        each = size[index]
        after = np.cumsum(each)
        total = int(after[-1]) if len(after) else 0
        ids = pool[np.repeat(begin[index] - after + each, each) + np.arange(total)]
        filled = np.concatenate(([0], after))[np.searchsorted(begins, stops)]
        return ids, np.diff(filled, prepend=0)

    def documents(self, column: pa.Array, most_bytes: int = 1 << 22) -> Iterator[bytes]:
        """The ids of each text in turn, as packed bytes."""
        for at, n in lots(column, most_bytes):
            ids, sizes = self.encode(column.slice(at, n))
            raw, end = ids.tobytes(), 0
            for size in (4 * sizes).tolist():
                yield raw[end : end + size]
                end += size


_HELD: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """This worker's encoder for a file."""
    if path not in _HELD:
        _HELD[path] = WordIds(path)
    return _HELD[path]
