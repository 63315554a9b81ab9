"""An n-gram language model in Elias-Fano tries, and the scores it gives.

Words are ``[^\\x20\\x09-\\x0D]+`` in lower case A-Z; an end token closes every text. Level
1 holds the words, in order of their 64-bit hashes; level k holds, for each context (the
rank of a (k-1)-gram), its successors. In a file, contexts, the pointers to where each
context's successors begin, and the successors (number plus context index times
vocabulary, so that they rise over the whole file) are Elias-Fano sequences; a successor
is searched within the range that its context's pointers give. Beside them stand quantised
relative frequencies, and for every n-gram the quantised weight of the next lower order.

    p(w | context) = (1 - g) * c(context, w) / c(context) + g * p(w | shorter context)

with the Witten-Bell weight g = T / (c + T), T the context's distinct successors; words
have c / (N + V), and unknown words share V / (N + V): as many of them are taken to exist
as known ones, V, so each has 1 / (N + V). The probabilities of all words, known and
unknown, so sum to one after any context.

Counts are reduced in each task and dealt in packed form; a context's successors are dealt
over ``SPREAD`` parts, so a frequent word burdens no single task. Levels are files in the
shared folder, one a part, that scoring tasks map into memory; only the list of files and
the totals N and V go to the driver. A worker opens parts as it needs them and closes the
oldest beyond ``MOST_HELD`` bytes of directories (and of files, where a store cannot be mapped),
so its memory does not grow with the model, but a lot of texts then opens parts again.

Defined cases: null and empty texts are one end token; null ids count as empty text where
rows are held out; repeated rows count and are scored each time; with nothing to learn
from every probability is 1; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import storage
from .elias_fano import EliasFano
from .language import held_out
from .words import lots, words

U = np.uint64
END = b" "  # no word has a blank, so this stands for the end token
SPREAD = 16
STEP = 4096  # codes of a power of ten
MOST_HELD = 1 << 26  # bytes of memory for the open parts of a level in one worker
EXCHANGE = "part int, kind int, size long, blob binary"


def code(p: np.ndarray) -> np.ndarray:
    """16-bit codes of log10 of probabilities, down to 10**-16."""
    with np.errstate(divide="ignore"):
        return np.clip(np.rint(-np.log10(p) * STEP), 0, 65535).astype(np.uint16)


CODED = 10.0 ** (-np.arange(65536) / STEP)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(32)) * U(0x9E3779B97F4A7C15)
    return (x ^ x >> U(29)) * U(0xBF58476D1CE4E5B9)


def word_part(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> U(32)) * U(n) >> U(32)).astype(np.int64)


def gram_part(context: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    return word_part(mixed(context * U(SPREAD) + (word & U(SPREAD - 1))), n)


def packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    blobs = [pa.compress(b, codec="zstd", asbytes=True) for *_, b in rows]
    return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.int32()), pa.array([len(b) for *_, b in rows], pa.int64()), pa.array(blobs, pa.binary())], ["part", "kind", "size", "blob"])


def unpacked(size: int, blob: bytes) -> bytes:
    return pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, each once, with the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[heads], np.add.reduceat(counts, heads) if len(heads) else counts


def save(where: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = (a.dtype.str, len(a), at)
        at += -(-a.nbytes // 8) * 8
    text = json.dumps(head).encode()
    text += b" " * (-len(text) % 8)
    with storage.create(where) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for a in arrays.values():
            out.write(a.tobytes() + bytes(-a.nbytes % 8))


def load(where: str) -> dict[str, np.ndarray]:
    data = storage.mapped(where)
    raw = np.frombuffer(data, np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head = json.loads(raw[8 : 8 + n].tobytes())
    return {k: np.frombuffer(data, np.dtype(kind), count, 8 + n + at) for k, (kind, count, at) in head.items()}


def nested(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{prefix}.{k}": v for k, v in arrays.items()}


def nest(prefix: str, arrays: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k.split(".", 1)[1]: v for k, v in arrays.items() if k.startswith(f"{prefix}.")}


class Level:
    """The files of one order; opened where they are used, as they are needed."""

    def __init__(self, order: int, n_parts: int, files: dict[int, tuple[str, int]], vocabulary: int):
        self.order, self.n_parts, self.files, self.vocabulary = order, n_parts, files, vocabulary
        sizes = [files[p][1] if p in files else 0 for p in range(n_parts)]
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.weights: dict[int, str] = {}
        self.open: dict[int, dict] = {}  # the least recently opened first
        self.held: dict[int, int] = {}  # bytes of memory that an open part takes

    def __getstate__(self):
        return self.__dict__ | {"open": {}, "held": {}}

    def part(self, p: int) -> dict:
        if p not in self.open:
            a = load(self.files[p][0])
            got = {"counts": a.get("counts"), "frequency": a.get("frequency")}
            if self.order == 1:
                got["words"] = EliasFano.of(nest("words", a))
            else:
                got |= {k: EliasFano.of(nest(k, a)) for k in ("contexts", "pointers", "successors")}
            if p in self.weights:
                got["weight"] = load(self.weights[p])["weight"]
            fetched = 0 if storage.mounted(self.files[p][0]) else sum(x.nbytes for x in a.values())
            held = fetched + sum(x.ones_before.nbytes + x.zeros_before.nbytes for x in got.values() if isinstance(x, EliasFano))
            while self.open and sum(self.held.values()) + held > MOST_HELD:
                oldest = next(iter(self.open))
                del self.open[oldest], self.held[oldest]
            self.open[p], self.held[p] = got, held
        return self.open[p]

    def _by_part(self, parts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(parts, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], parts[order][1:] != parts[order][:-1])))[: len(order)]
        for a, b in zip(heads, [*heads[1:], len(order)], strict=False):
            if (p := int(parts[order[a]])) in self.files:
                yield p, order[a:b]

    def find_words(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), -1, np.int64)
        for p, i in self._by_part(word_part(hashes, self.n_parts)):
            at = self.part(p)["words"].locate(hashes[i])
            out[i] = np.where(at >= 0, at + self.starts[p], -1)
        return out

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Ranks of n-grams, -1 where there is none; quickest if equal contexts stand together."""
        out = np.full(len(context), -1, np.int64)
        context, word = context.astype(np.uint64), word.astype(np.uint64)
        for p, i in self._by_part(gram_part(context, word, self.n_parts)):
            f = self.part(p)
            asked = context[i]
            fresh = np.concatenate(([True], asked[1:] != asked[:-1]))  # callers sort by context
            at = f["contexts"].locate(asked[fresh])
            known = np.flatnonzero(at >= 0)
            low, high = np.zeros((2, len(at)), np.int64)
            low[known], high[known] = f["pointers"].get(at[known]).astype(np.int64), f["pointers"].get(at[known] + 1).astype(np.int64)
            which = np.cumsum(fresh) - 1
            chosen = at[which] >= 0
            i, which = i[chosen], which[chosen]
            if not len(i):
                continue
            found = f["successors"].locate(at[which].astype(np.uint64) * U(self.vocabulary) + word[i], low[which], high[which])
            inside = found >= 0
            out[i[inside]] = found[inside] + self.starts[p]
        return out

    def gather(self, ranks: np.ndarray, name: str) -> np.ndarray:
        out = np.zeros(len(ranks), np.int64)
        for p, i in self._by_part(np.searchsorted(self.starts, ranks, side="right") - 1):
            out[i] = self.part(p)[name][ranks[i] - self.starts[p]]
        return out


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of a string column as numbers, the tokens of each text, and the hash of each number."""
    index, sizes, distinct = words(column)
    end = len(distinct)
    ids = np.full(len(index) + len(sizes), end, np.int64)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    ids[inside] = index
    return ids, sizes + 1, np.array([*map(xxh64_intdigest, distinct), xxh64_intdigest(END)], np.uint64)


def places(sizes: np.ndarray) -> np.ndarray:
    """Place of each token in its text, from 0."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


class Model:
    def __init__(self, tokens: int, levels: list[Level]):
        self.tokens, self.levels = tokens, levels
        self.vocabulary = int(levels[0].starts[-1])

    def extended(self, ids: np.ndarray, place: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
        """Rank of the k-gram that ends at each token, from those of the (k-1)-grams; -1 at a text's start or if unknown."""
        context = np.concatenate(([-1], rank[:-1]))
        there = np.flatnonzero((place >= k - 1) & (context >= 0) & (ids >= 0))
        bits = U(max(1, self.vocabulary).bit_length())
        keys, back = np.unique(context[there].astype(np.uint64) << bits | ids[there].astype(np.uint64), return_inverse=True)
        found = self.levels[k - 1].find(keys >> bits, keys & ((U(1) << bits) - U(1)))
        out = np.full(len(ids), -1, np.int64)
        out[there] = found[back]
        return out

    def ranks(self, ids: np.ndarray, place: np.ndarray, order: int) -> np.ndarray:
        rank = ids
        for k in range(2, order + 1):
            rank = self.extended(ids, place, rank, k)
        return rank

    def probabilities(self, ids: np.ndarray, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = self.tokens + self.vocabulary
        if not total:
            return np.ones(len(ids))
        p = np.where(ids >= 0, counts, 1) / total
        place = places(sizes)
        rank = ids
        for k in range(2, len(self.levels) + 1):
            context = np.concatenate(([-1], rank[:-1]))
            there = np.flatnonzero((place >= k - 1) & (context >= 0))
            names, back = np.unique(context[there], return_inverse=True)
            weight = CODED[self.levels[k - 2].gather(names, "weight")][back]
            rank = self.extended(ids, place, rank, k)
            found = rank[there]
            frequency = np.zeros(len(there))
            seen = found >= 0
            names, back = np.unique(found[seen], return_inverse=True)
            frequency[seen] = CODED[self.levels[k - 1].gather(names, "frequency")][back]
            p[there] = (1 - weight) * frequency + weight * p[there]
        return p


LOT = 1 << 22  # bytes of text at once


def _groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows with about ``LOT`` bytes of text at once, and their texts."""
    for batch in batches:
        for at, n in lots(batch.column(column), LOT):
            part = batch.slice(at, n)
            yield part, part.column(column)


def _deal(keys: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> list[tuple[int, int, bytes]]:
    order = np.argsort(parts, kind="stable")
    keys, counts, parts = keys[order], counts[order], parts[order]
    heads = np.flatnonzero(np.concatenate(([True], parts[1:] != parts[:-1]))) if len(parts) else np.empty(0, np.int64)
    # Steps between sorted keys are small numbers, which compress well.
    return [(int(parts[a]), 1, np.diff(keys[a:b], prepend=U(0)).tobytes() + counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(parts)], strict=False)]


def _received(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for batch in batches:
        for size, blob in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            raw = unpacked(size, blob)
            n = len(raw) // 12
            keys.append(np.cumsum(np.frombuffer(raw, np.uint64, n), dtype=np.uint64))
            counts.append(np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64))
    return counted(np.concatenate(keys), np.concatenate(counts))


def _small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32 if not len(x) or x.max() < 1 << 32 else np.uint64)


def _name(folder: str, what: str, part: int) -> str:
    return f"{folder}/{what}-{part:05d}-{TaskContext.get().taskAttemptId()}.ef"


def _manifest(part: int, where: str, n: int, total: int) -> tuple[int, int, bytes]:
    return part, 9, json.dumps([where, n, total]).encode()


def _files(df: DataFrame) -> dict[int, list]:
    return {r["part"]: json.loads(unpacked(r["size"], bytes(r["blob"]))) for r in df.where("kind = 9").collect()}


def count_words(texts: DataFrame, folder: str, n: int) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, texts in _groups(batches, 0):
            ids, _, hashes = tokens_of(texts)
            held.append((hashes, np.bincount(ids, minlength=len(hashes))))
            if sum(len(k) for k, _ in held) > 2_000_000:
                held = [counted(*map(np.concatenate, zip(*held, strict=True)))]
                if len(held[0][0]) > 1_500_000:
                    yield packed(_deal(*held[0], word_part(held[0][0], n)))
                    held = []
        if held:
            keys, counts = counted(*map(np.concatenate, zip(*held, strict=True)))
            yield packed(_deal(keys, counts, word_part(keys, n)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _received(batches)
        if len(keys):
            part = int(word_part(keys[:1], n)[0])
            where = _name(folder, "words", part)
            save(where, nested("words", EliasFano(keys).arrays()) | {"counts": _small(counts)})
            yield packed([_manifest(part, where, len(keys), int(counts.sum()))])

    return texts.mapInArrow(storage.tidy(count), EXCHANGE).repartitionById(n, F.col("part")).mapInArrow(storage.tidy(merge), EXCHANGE)


def count_grams(texts: DataFrame, model: Model, order: int, last: bool, folder: str, n: int) -> DataFrame:
    """Files of level ``order``, and how many successors each context has in each part (kind 1)."""
    bits = U(max(1, model.vocabulary).bit_length())
    lower = model.levels[order - 2]
    if int(lower.starts[-1]).bit_length() + int(bits) > 64:
        raise ValueError("context and word do not fit 64 bits")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for _, texts in _groups(batches, 0):
            ids, sizes, hashes = tokens_of(texts)
            ids = model.levels[0].find_words(hashes)[ids]
            place = places(sizes)
            rank = model.ranks(ids, place, order - 1)
            there = np.flatnonzero(place >= order - 1)
            keys = rank[there - 1].astype(np.uint64) << bits | ids[there].astype(np.uint64)
            held.append(np.unique(keys, return_counts=True))
            if sum(len(k) for k, _ in held) > 3_000_000:
                keys, counts = counted(*map(np.concatenate, zip(*held, strict=True)))
                yield packed(_deal(keys, counts, gram_part(keys >> bits, keys & ((U(1) << bits) - U(1)), n)))
                held = []
        if held:
            keys, counts = counted(*map(np.concatenate, zip(*held, strict=True)))
            yield packed(_deal(keys, counts, gram_part(keys >> bits, keys & ((U(1) << bits) - U(1)), n)))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = _received(batches)
        if not len(keys):
            return
        context, word = keys >> bits, keys & ((U(1) << bits) - U(1))
        part = int(gram_part(context[:1], word[:1], n)[0])
        heads = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
        ends = np.concatenate((heads[1:], [len(keys)]))
        names = context[heads]
        whole = lower.gather(names.astype(np.int64), "counts")
        index = np.repeat(np.arange(len(heads)), ends - heads)
        arrays = nested("contexts", EliasFano(names).arrays()) | nested("pointers", EliasFano(np.concatenate((heads, [len(keys)]))).arrays())
        arrays |= nested("successors", EliasFano(index.astype(np.uint64) * U(model.vocabulary) + word).arrays())
        arrays["frequency"] = code(counts / whole[index])
        if not last:
            arrays["counts"] = _small(counts)
        where = _name(folder, f"level{order}", part)
        save(where, arrays)
        home = np.searchsorted(lower.starts, names.astype(np.int64), side="right") - 1
        yield packed([_manifest(part, where, len(keys), int(counts.sum())), *_deal(names, ends - heads, home)])

    return texts.mapInArrow(storage.tidy(count), EXCHANGE).repartitionById(n, F.col("part")).mapInArrow(storage.tidy(merge), EXCHANGE)


def weigh_contexts(dealt: DataFrame, lower: Level, folder: str, n: int) -> DataFrame:
    """For every n-gram of the lower level, the weight of what is below its successors."""
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = _received(batches)
        if not len(names):
            return
        part = int(np.searchsorted(lower.starts, int(names[0]), side="right") - 1)
        counts = lower.part(part)["counts"].astype(np.float64)
        weight = np.zeros(len(counts), np.uint16)
        at = names.astype(np.int64) - lower.starts[part]
        weight[at] = code(kinds / (counts[at] + kinds))
        where = _name(folder, f"weights{lower.order}", part)
        save(where, {"weight": weight})
        yield packed([_manifest(part, where, len(names), 0)])

    return dealt.where("kind = 1").repartitionById(n, F.col("part")).mapInArrow(storage.tidy(merge), EXCHANGE)


def train(df: DataFrame, text_col: str = "text", order: int = 2) -> Model:
    """A model of all texts of ``df``; its files stay in the shared folder."""
    spark = df.sparkSession
    n, folder = storage.shards(spark), storage.scratch(spark, "ngrams")
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    files = _files(storage.settle(count_words(texts, folder, n), "lm-words"))
    model = Model(sum(f[2] for f in files.values()), [Level(1, n, {p: (f[0], f[1]) for p, f in files.items()}, sum(f[1] for f in files.values()))])
    for k in range(2, order + 1):
        made = storage.settle(count_grams(texts, model, k, k == order, folder, n), "lm-grams")
        lower = model.levels[-1]
        lower.weights = {p: f[0] for p, f in _files(storage.settle(weigh_contexts(made, lower, folder, n), "lm-weights")).items()}
        lower.open, lower.held = {}, {}
        model.levels.append(Level(k, n, {p: (f[0], f[1]) for p, f in _files(made).items()}, model.vocabulary))
    return model


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _groups(batches, 1):
            local, sizes, hashes = tokens_of(texts)
            rank = model.levels[0].find_words(hashes)
            count = np.zeros(len(rank), np.int64)
            count[rank >= 0] = model.levels[0].gather(rank[rank >= 0], "counts")
            ids, counts = rank[local], count[local]
            heads = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10((counts + 1) / (model.tokens + model.vocabulary + 1)), heads)
            own = np.add.reduceat(np.log10(model.probabilities(ids, counts, sizes)), heads)
            known = np.add.reduceat((counts > 0).astype(np.int64), heads)
            columns = [part.column(0), pa.array(sizes), pa.array(known), pa.array(np.full(len(sizes), model.tokens, np.int64)), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(storage.tidy(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def held_out_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2, parts: int = 7, part: int = 2) -> DataFrame:
    """Scores of all rows by a model of those that are not held out."""
    model = train(df.where(~held_out(id_col, parts, part)), text_col, order)
    scored = score(df, model, id_col, text_col)
    return scored.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
