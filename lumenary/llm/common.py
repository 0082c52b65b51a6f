"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import functools
import gc
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumenary.session import scratch

#: Where the public vocabularies are; every tokenizing operator takes a path of its own.
VOCABULARIES = "/opt/tokenizers"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file: the installed package's folder, else VOCABULARIES."""
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(VOCABULARIES, name)
    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, so that a lost executor loses nothing."""
    scratch(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without_collector(function: Callable) -> Callable:
    """Run ``function`` without Python's cycle collector, for work on millions of plain strings."""

    @functools.wraps(function)
    def run(*args, **options):
        gc.disable()
        try:
            return function(*args, **options)
        finally:
            gc.enable()

    return run


_kept: list[Callable[[], None]] = []


def kept_in_worker(cached: Callable) -> Callable:
    """Mark an ``lru_cache`` that tasks of one operator share; another operator's task empties it."""
    _kept.append(cached.cache_clear)
    return cached


def release(keep: bool = False) -> None:
    """Give memory back to the system: what is freed and, unless ``keep``, what workers keep.

    Workers live as long as their executor, so what one task leaves behind counts for all.
    """
    if not keep:
        for clear in _kept:
            clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(function: Callable) -> Callable:
    """``function`` of one group's table, after which a worker holds no memory of the group."""

    def run(table):
        try:
            return function(table)
        finally:
            release()

    return run


def tidy_pair(function: Callable) -> Callable:
    """As ``tidy``, of a cogroup's two tables."""

    def run(left, right):
        try:
            return function(left, right)
        finally:
            release()

    return run


def text_batches(
    batches: Iterable[pa.RecordBatch], text: str | int, bytes_at_once: int = 8 << 20, keep: bool = False
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with their texts (null: empty), each of about ``bytes_at_once``.

    ``text``: the column's name or, where others may have that name, its place. ``keep``: the caller uses what workers keep between tasks.
    """
    release(keep)
    for batch in batches:
        column = batch.column(text)
        step = max(1, int(batch.num_rows * bytes_at_once / max(1, column.nbytes)))
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part, [x or "" for x in column.slice(at, step).to_pylist()]
    release(keep)


def binaries(data: bytes | np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary array over one buffer, cut at ``ends``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
