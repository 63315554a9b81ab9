"""Shared working storage and raw file access for the training-data operators.

Everything that one task writes and another reads goes below the folder that the
session names in ``spark.checkpoint.dir``; a folder of our own is used only where
that setting is absent and the session runs on one machine (tests). What was written
is deleted by ``sweep``, at the latest when the driver's Python ends.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the folder that driver and executors share."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("on a cluster, name a folder that all machines share in spark.checkpoint.dir")
        named = "file://" + tempfile.mkdtemp(prefix="quill-shared-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh, not yet existing folder below the shared one."""
    made = f"{shared_dir(spark)}/quill-{name}-{uuid.uuid4().hex[:12]}"
    _MADE.append(made)
    return made


_MADE: list[str] = []


@atexit.register
def sweep() -> None:
    """Delete all scratch folders of this driver; results that were not written elsewhere go with them."""
    while _MADE:
        try:
            system, path = locate(_MADE.pop())
            system.delete_dir(path)
        except (OSError, ValueError, pa.ArrowException):
            pass  # never written, gone already, or a store that pyarrow does not know


@cache
def _trim() -> Callable[[int], int] | None:
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker, which Spark uses again, gives free memory back to the system."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return tidied


def settle(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df`` by writing it to the shared folder and reading it back."""
    spark = df.sparkSession
    where = scratch(spark, name)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def rows_of(df: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """The rows of ``df`` that ``wanted (id, hash)`` names, each once; ``hash`` is that of the text."""
    key = unused(df, "row")
    keyed = df.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string"))))
    keys = settle(wanted.select(F.xxhash64("id", "hash").alias(key)), "rows")
    return keyed.join(keys.hint("merge"), key, "left_semi").dropDuplicates([key]).drop(key)


def shards(spark: SparkSession) -> int:
    """How many pieces a keyed exchange of ours is dealt into: the session's own number."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; bare paths and ``file:/x`` count as local."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    elif "://" not in uri:
        uri = "file://" + os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def create(uri: str):
    """An output stream to a new file, parents made where the store has folders."""
    system, path = locate(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path)


def mounted(uri: str) -> bool:
    """Whether ``mapped`` maps the file into memory instead of fetching it."""
    return isinstance(locate(uri)[0], fs.LocalFileSystem)


def mapped(uri: str) -> pa.Buffer:
    """The bytes of a file: memory-mapped on a mounted store, fetched whole elsewhere."""
    system, path = locate(uri)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as source:
            return source.read_buffer()
    with system.open_input_file(path) as source:
        return source.read_buffer()


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
