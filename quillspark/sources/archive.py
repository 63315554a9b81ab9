"""Document archives: one file of directory entries and compressed clusters of blobs.

``Archive`` reads a file (from any store that Arrow's file systems reach); ``register``
makes ``spark.read.format("archive")`` give one row a directory entry, with contents. A
partition covers whole clusters, so each cluster is decompressed once. ``write_archive``
makes small files, for tests.
"""

from __future__ import annotations

import hashlib
import lzma
import os
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format.
MAGIC, HEADER = 72173914, struct.Struct("<IHH16sIIQQQQIIQ")
REDIRECT, LINK_TARGET, DELETED, NO_PAGE = 0xFFFF, 0xFFFE, 0xFFFD, 0xFFFFFFFF
LISTING = "listing/titleOrdered/v1"
MOST_CLUSTER, XZ_MEMORY, ZSTD_WINDOW, MOST_STRING = 128 << 20, 256 << 20, 1 << 27, 64 << 10


class DamagedArchive(ValueError):
    pass


@dataclass
class Entry:
    entry: int
    namespace: str
    path: str
    raw_title: str
    kind: str
    mime: str | None = None
    cluster: int | None = None
    blob: int | None = None
    redirect_target: int | None = None

    @property
    def title(self) -> str:
        return self.raw_title or self.path


def open_file(path: str) -> pa.NativeFile:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    if "://" not in path:
        return pa.memory_map(os.path.abspath(path))
    system, name = fs.FileSystem.from_uri(path)
    return pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)


class Archive:
    def __init__(self, path: str):
        self.path, self.file = path, open_file(path)
        self.size = self.file.size()
        if self.size < HEADER.size:
            raise DamagedArchive("smaller than its header")
        (magic, self.major, self.minor, self.uuid, self.entry_count, self.cluster_count, self.paths_at, titles_at, self.clusters_at, self.mimes_at, main, _, self.checksum_at) = HEADER.unpack(self.read(0, HEADER.size))
        if magic != MAGIC:
            raise DamagedArchive("not an archive")
        if self.major not in (5, 6):
            raise DamagedArchive(f"version {self.major} is not known")
        self.titles_at = None if titles_at in (0, (1 << 64) - 1) else titles_at
        self.main = None if main == NO_PAGE else main
        for at, n, what in ((self.mimes_at, 1, "type list"), (self.paths_at, 8 * self.entry_count, "path list"), (self.clusters_at, 8 * self.cluster_count, "cluster list"), (self.titles_at or 0, 4 * self.entry_count * (self.titles_at is not None), "title list"), (self.checksum_at, 16 * (self.checksum_at > 0), "checksum")):
            if at + n > self.size:
                raise DamagedArchive(f"{what} runs past the end")
        self.mimes = self._mimes()
        self._kept: tuple[int, list[bytes]] | None = None

    @property
    def new_namespaces(self) -> bool:
        return self.major >= 6 and self.minor >= 1

    @property
    def article_namespace(self) -> str:
        return "C" if self.new_namespaces else "A"

    def read(self, at: int, n: int) -> bytes:
        if at < 0 or at + n > self.size:
            raise DamagedArchive(f"{n} bytes at {at} run past the end")
        self.file.seek(at)
        return self.file.read(n)

    def _text(self, at: int) -> tuple[bytes, int]:
        data = self.read(at, min(MOST_STRING + 1, self.size - at))
        end = data.find(b"\0")
        if end < 0:
            raise DamagedArchive(f"no end of the text at {at}")
        return data[:end], at + end + 1

    def _mimes(self) -> list[str]:
        out, at = [], self.mimes_at
        while True:
            text, at = self._text(at)
            if not text:
                return out
            out.append(text.decode("utf-8", "replace"))
            if len(out) > DELETED:
                raise DamagedArchive("too many content types")

    def entry(self, i: int) -> Entry:
        if not 0 <= i < self.entry_count:
            raise DamagedArchive(f"no entry {i}")
        [at] = struct.unpack("<Q", self.read(self.paths_at + 8 * i, 8))
        mime, _, namespace, _ = struct.unpack("<HBBI", self.read(at, 8))
        if not 33 <= namespace <= 126:
            raise DamagedArchive(f"namespace byte {namespace}")
        more: dict = {"kind": "other"}
        strings = at + 8
        if mime == REDIRECT:
            more = {"kind": "redirect", "redirect_target": struct.unpack("<I", self.read(at + 8, 4))[0]}
            strings = at + 12
        elif mime not in (LINK_TARGET, DELETED):
            cluster, blob = struct.unpack("<II", self.read(at + 8, 8))
            more = {"kind": "content", "mime": self.mimes[mime] if mime < len(self.mimes) else None, "cluster": cluster, "blob": blob}
            strings = at + 16
        path, strings = self._text(strings)
        title, _ = self._text(strings)
        return Entry(i, chr(namespace), path.decode("utf-8", "replace"), title.decode("utf-8", "replace"), **more)

    def _key(self, i: int) -> tuple[bytes, bytes]:
        e = self.entry(i)
        return e.namespace.encode(), e.path.encode()

    def find(self, namespace: str, path: str) -> int | None:
        """Entry of a path, by bisection of the sorted directory."""
        key = (namespace.encode(), path.encode())
        i = bisect_left(range(self.entry_count), key, key=self._key)
        return i if i < self.entry_count and self._key(i) == key else None

    def namespace_range(self, namespace: str) -> range:
        n, one = namespace.encode(), lambda i: self._key(i)[0]
        return range(bisect_left(range(self.entry_count), n, key=one), bisect_right(range(self.entry_count), n, key=one))

    def resolve(self, i: int, most: int = 50) -> int:
        for _ in range(most):
            e = self.entry(i)
            if e.kind != "redirect":
                return i
            i = e.redirect_target
        raise DamagedArchive("redirects do not end")

    def cluster(self, c: int) -> list[bytes]:
        """All blobs of a cluster; the last one read is kept."""
        if self._kept and self._kept[0] == c:
            return self._kept[1]
        if not 0 <= c < self.cluster_count:
            raise DamagedArchive(f"no cluster {c}")
        [at] = struct.unpack("<Q", self.read(self.clusters_at + 8 * c, 8))
        if c + 1 < self.cluster_count:
            [end] = struct.unpack("<Q", self.read(self.clusters_at + 8 * c + 8, 8))
        else:
            end = min(x for x in (self.size, self.checksum_at or self.size, *(p for p in (self.paths_at, self.titles_at or 0, self.clusters_at) if p > at)) if x > at)
        raw = self.read(at, max(1, end - at))
        packed, width = raw[0] & 15, 8 if raw[0] & 16 else 4
        try:
            if packed in (0, 1):
                data = raw[1:]
            elif packed == 5:
                data = zstandard.ZstdDecompressor(max_window_size=ZSTD_WINDOW).stream_reader(raw[1:]).read(MOST_CLUSTER + 1)
            elif packed == 4:
                data = lzma.LZMADecompressor(memlimit=XZ_MEMORY).decompress(raw[1:], MOST_CLUSTER + 1)
            else:
                raise DamagedArchive(f"compression {packed} is not known")
        except (lzma.LZMAError, zstandard.ZstdError) as e:
            raise DamagedArchive(f"cluster {c}: {e}") from e
        if len(data) > MOST_CLUSTER and packed > 1 or len(data) < width:
            raise DamagedArchive(f"cluster {c} has a size that cannot be")
        kind = "<Q" if width == 8 else "<I"
        [first] = struct.unpack_from(kind, data)
        if first % width or not width <= first <= len(data):
            raise DamagedArchive(f"cluster {c} has a bad table")
        offsets = [x for (x,) in struct.iter_unpack(kind, data[:first])]
        if sorted(offsets) != offsets or offsets[-1] > len(data):
            raise DamagedArchive(f"cluster {c} has a bad table")
        self._kept = (c, [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)])
        return self._kept[1]

    def content(self, i: int) -> bytes:
        e = self.entry(self.resolve(i))
        if e.kind != "content":
            raise DamagedArchive(f"entry {i} has no content")
        blobs = self.cluster(e.cluster)
        if e.blob >= len(blobs):
            raise DamagedArchive(f"no blob {e.blob} in cluster {e.cluster}")
        return blobs[e.blob]

    def metadata(self, name: str) -> str | None:
        i = self.find("M", name)
        return None if i is None else self.content(i).decode("utf-8", "replace")

    def main_entry(self) -> int | None:
        i = self.find("W", "mainPage") if self.new_namespaces else None
        i = self.main if i is None else i
        return None if i is None else self.resolve(i)

    def titles(self) -> list[int] | None:
        """Entries by title, from the old list."""
        return None if self.titles_at is None else [x for (x,) in struct.iter_unpack("<I", self.read(self.titles_at, 4 * self.entry_count))]

    def front_count(self) -> int:
        """Length of the list that names front articles; old lists name other entries too."""
        i = self.find("X", LISTING)
        if i is not None:
            size = len(self.content(i))
            if size % 4:
                raise DamagedArchive("bad title listing")
            return size // 4
        if self.titles_at is None:
            raise DamagedArchive("no title listing")
        return self.entry_count

    def front_articles(self, first: int = 0, stop: int | None = None) -> list[int]:
        """Front articles among places ``first`` to ``stop`` of the list."""
        stop = self.front_count() if stop is None else stop
        i = self.find("X", LISTING)
        if i is not None:
            found = [x for (x,) in struct.iter_unpack("<I", self.content(i)[4 * first : 4 * stop])]
            if any(x >= self.entry_count for x in found):
                raise DamagedArchive("the title listing names unknown entries")
            return found
        kept = []
        for (i,) in struct.iter_unpack("<I", self.read(self.titles_at + 4 * first, 4 * (stop - first))):
            e = self.entry(i)
            if e.namespace == self.article_namespace and (not self.new_namespaces or e.kind == "redirect" or e.mime == "text/html"):
                kept.append(i)
        return kept

    def checksum_holds(self) -> bool:
        """Whether the MD5 of all before it is the stored one."""
        if not self.checksum_at:
            return False
        digest, at = hashlib.md5(), 0
        while at < self.checksum_at:
            part = self.read(at, min(1 << 20, self.checksum_at - at))
            digest.update(part)
            at += len(part)
        return digest.digest() == self.read(self.checksum_at, 16)


SCHEMA = "entry long, namespace string, path string, raw_title string, title string, kind string, mime string, cluster long, blob long, redirect_target long, content binary"
#: What the source can be asked for by its option ``table``; a share reads a range of entries, clusters or list places.
TABLES = {
    "directory": SCHEMA.removesuffix(", content binary"),
    "contents": "cluster long, blob long, content binary",
    "front": "entry long",
}


@dataclass
class Share(InputPartition):
    path: str
    first: int
    stop: int


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.table = options.get("table", "directory")
        self.namespace = options.get("namespace")  # narrows the directory to a range
        self.clusters = int(options.get("clustersPerPartition", 64))
        self.entries = int(options.get("entriesPerPartition", 1 << 17))

    def partitions(self) -> list[Share]:
        archive = Archive(self.path)
        if self.table == "contents":
            whole, step = range(archive.cluster_count), self.clusters
        elif self.table == "front":
            whole, step = range(archive.front_count()), self.entries
        else:
            whole, step = archive.namespace_range(self.namespace) if self.namespace else range(archive.entry_count), self.entries
        return [Share(self.path, a, min(a + step, whole.stop)) for a in range(whole.start, whole.stop, step)] or [Share(self.path, 0, 0)]

    def read(self, partition: Share) -> Iterator[tuple]:
        """Rows of a share: no entry is read by two shares, and no cluster is unpacked twice."""
        archive = Archive(partition.path)
        if self.table == "front":
            yield from ((i,) for i in archive.front_articles(partition.first, partition.stop))
        elif self.table == "contents":
            for c in range(partition.first, partition.stop):
                yield from ((c, b, content) for b, content in enumerate(archive.cluster(c)))
        else:
            for e in map(archive.entry, range(partition.first, partition.stop)):
                yield e.entry, e.namespace, e.path, e.raw_title, e.title, e.kind, e.mime, e.cluster, e.blob, e.redirect_target


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "directory")]

    def reader(self, schema) -> Reader:
        return Reader(self.options)


def read_archive(spark: SparkSession, path: str, namespace: str | None = None, **options) -> DataFrame:
    """The entries of an archive with their contents (null where an entry has none).

    The directory is read in ranges of entries and the contents in ranges of clusters, each
    once; they meet by cluster and place.
    """
    register(spark)
    read = lambda table, **more: spark.read.format("archive").options(table=table, **more, **options).load(path)
    listed = read("directory", **({"namespace": namespace} if namespace else {}))
    return listed.join(read("contents"), ["cluster", "blob"], "left").select(*(x.split()[0] for x in SCHEMA.split(", ")))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def archive_paths(given: list[str]) -> list[str]:
    """Files as they are, folders as the archives directly in them, by name; each file once, by its real path."""
    out: dict[str, str] = {}
    for g in given:
        found = sorted(os.path.join(g, x) for x in os.listdir(g) if x.lower().endswith(".zim")) if os.path.isdir(g) else [g]
        for path in found:
            out.setdefault(os.path.realpath(path), path)
    return list(out.values())


def write_archive(path: str, entries: list[dict], version: tuple[int, int] = (6, 1), compression: int = 5, per_cluster: int = 3, main: str | None = None, front: list[str] | None = None) -> None:
    """``entries``: dicts of namespace, path, title, and mime and content or redirect (a path of the namespace)."""
    entries = [dict(e) for e in entries]
    if version >= (6, 1):
        entries.append({"namespace": "X", "path": LISTING, "mime": "application/octet-stream", "content": b""})
    entries.sort(key=lambda e: (e["namespace"].encode(), e["path"].encode()))
    place = {(e["namespace"], e["path"]): i for i, e in enumerate(entries)}
    for e in entries:
        if e["path"] == LISTING:
            shown = [i for i, x in enumerate(entries) if x["namespace"] == "C" and (x["path"] in front if front is not None else x.get("mime") == "text/html" or "redirect" in x)]
            shown.sort(key=lambda i: entries[i].get("title") or entries[i]["path"])
            e["content"] = struct.pack(f"<{len(shown)}I", *shown)
    mimes = sorted({e["mime"] for e in entries if "mime" in e})
    blobs = [e for e in entries if "redirect" not in e]
    clusters = [blobs[i : i + per_cluster] for i in range(0, len(blobs), per_cluster)]
    body = b""
    for n, group in enumerate(clusters):
        offsets, at = [], 4 * (len(group) + 1)
        for b, e in enumerate(group):
            e["at"] = (n, b)
            offsets.append(at)
            at += len(e["content"])
        data = struct.pack(f"<{len(group) + 1}I", *offsets, at) + b"".join(e["content"] for e in group)
        packed = {1: lambda d: d, 4: lambda d: lzma.compress(d, check=lzma.CHECK_CRC32), 5: zstandard.ZstdCompressor().compress}[compression](data)
        group[0]["start"] = len(body)
        body += bytes([compression]) + packed
    starts = [g[0]["start"] for g in clusters]
    listed = b"".join(m.encode() + b"\0" for m in mimes) + b"\0"
    records = []
    for e in entries:
        strings = e["path"].encode() + b"\0" + e.get("title", "").encode() + b"\0"
        if "redirect" in e:
            records.append(struct.pack("<HBBII", REDIRECT, 0, ord(e["namespace"]), 0, place[e["namespace"], e["redirect"]]) + strings)
        else:
            records.append(struct.pack("<HBBIII", mimes.index(e["mime"]), 0, ord(e["namespace"]), 0, *e["at"]) + strings)
    at = HEADER.size + len(listed)
    spots = []
    for r in records:
        spots.append(at)
        at += len(r)
    paths_at, titles_at = at, at + 8 * len(entries)
    clusters_at = titles_at + 4 * len(entries)
    body_at = clusters_at + 8 * len(clusters)
    by_title = sorted(range(len(entries)), key=lambda i: (entries[i]["namespace"], entries[i].get("title") or entries[i]["path"]))
    first = place.get(("C" if version >= (6, 1) else "A", main), NO_PAGE) if main else NO_PAGE
    head = HEADER.pack(MAGIC, *version, hashlib.md5(path.encode()).digest(), len(entries), len(clusters), paths_at, titles_at, clusters_at, HEADER.size, first, NO_PAGE, body_at + len(body))
    data = head + listed + b"".join(records) + struct.pack(f"<{len(spots)}Q", *spots) + struct.pack(f"<{len(by_title)}I", *by_title) + struct.pack(f"<{len(starts)}Q", *(body_at + s for s in starts)) + body
    with open(path, "wb") as f:
        f.write(data + hashlib.md5(data).digest())
