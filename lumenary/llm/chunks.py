"""Texts kept as compressed chunks of a few megabytes, for operators that pass over them more than once.

A chunk holds whole documents. The chunk table is bucketed by chunk in the session's warehouse,
which driver and executors share, so a later pass joins what concerns a chunk with its texts and
moves only the former.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm.common import partitions, release, text_batches

#: Bytes of text in a chunk, but for a longer document, which is a chunk of its own.
CHUNK_BYTES = 4 << 20

SCHEMA = "chunk long, n_bytes long, doc_ids binary, ends binary, texts binary, rest binary"


def pack_numbers(values: np.ndarray) -> bytes:
    """64-bit numbers, kept small where neighbours are close: differences, byte by byte, zstandard."""
    values = np.asarray(values).astype(np.uint64)
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_rows(rows: pa.Table) -> bytes:
    """Rows of any columns, as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    return zstandard.compress(sink.getvalue().to_pybytes(), 1)


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(data)).read_all()


def chunked(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_BYTES, whole: bool = False
) -> DataFrame:
    """The chunk table of ``docs``; a null text is empty, a null id the least 64-bit number.

    ``rest`` holds, with ``whole``, whether the text is null and the documents' other columns, all
    by their place, so their names do not matter. An empty table has no chunks. The table stays
    until the ``temporary_chunks`` around the call ends, or for good where there is none.
    """
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns if c != text_col] if whole else []
    others = [F.col(c).alias(f"column{k}") for k, c in enumerate(quoted)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held, made = [], [], 0, 0
        more: list[pa.Table] = []

        def out() -> pa.RecordBatch:
            name = (TaskContext.get().partitionId() << 32) + made
            ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
            body = zstandard.compress(b"".join(texts), 3)
            rest = pack_rows(pa.concat_tables(more)) if whole else None
            row = name, int(ends[-1]), pack_numbers(np.array(ids, np.int64)), pack_numbers(ends), body, rest
            kinds = pa.int64(), pa.int64(), *[pa.binary()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip(row, kinds)], names=["chunk", "n_bytes", "doc_ids", "ends", "texts", "rest"]
            )

        least = np.iinfo(np.int64).min
        for part, some in text_batches(batches, 1, size):
            kept = [part.column(1).is_valid(), *part.columns[2:]]
            own = pa.table(kept, names=list(map(str, range(len(kept))))) if whole else None
            for k, (doc, text) in enumerate(zip(part.column(0).to_pylist(), some)):
                data = text.encode("utf-8", "surrogatepass")
                if texts and held + len(data) > size:
                    yield out()
                    ids, texts, held, made = [], [], 0, made + 1
                    more.clear()
                if whole:
                    more.append(own.slice(k, 1))
                ids.append(least if doc is None else doc)
                texts.append(data)
                held += len(data)
        if texts:
            yield out()

    spark, name = docs.sparkSession, f"chunks_{uuid.uuid4().hex}"
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"), *others).mapInArrow(run, SCHEMA)
    n = partitions(spark)
    (
        rows.repartition(n, "chunk").write.format("parquet").option("compression", "none")
        .bucketBy(n, "chunk").saveAsTable(name)
    )
    if (made := _made.get()) is not None:
        made.append(name)
    return spark.table(name)


#: Chunk tables made inside the innermost ``temporary_chunks``.
_made: ContextVar[list[str] | None] = ContextVar("chunks", default=None)


@contextmanager
def temporary_chunks(spark: SparkSession) -> Iterator[None]:
    """Chunk tables that are made inside are dropped at the end; results must be written by then."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


class Chunk:
    """One row of the table, unpacked."""

    def __init__(self, doc_ids: bytes, ends: bytes, texts: bytes):
        release()  # the chunk before
        self.doc_ids = unpack_numbers(doc_ids).astype(np.int64)
        self.ends = unpack_numbers(ends).astype(np.int64)
        self.data = np.frombuffer(zstandard.decompress(texts), np.uint8) if self.ends[-1] else np.zeros(0, np.uint8)

    @classmethod
    def of(cls, table: pa.Table) -> Chunk:
        return cls(*(table.column(name)[0].as_py() for name in ("doc_ids", "ends", "texts")))

    def text(self, k: int) -> bytes:
        return self.data[self.ends[k - 1] if k else 0 : self.ends[k]].tobytes()


def whole_rows(table: pa.Table, schema: pa.Schema, text_col: str, keep: np.ndarray, texts: list[str]) -> pa.Table:
    """Rows ``keep`` (numbers) of a whole chunk as they were, with ``texts`` as their texts."""
    rest = unpack_rows(table.column("rest")[0].as_py()).take(pa.array(keep, pa.int64()))
    own = pa.array([text if there else None for text, there in zip(texts, rest.column(0).to_pylist())], schema.field(text_col).type)
    others = iter(rest.columns[1:])
    return pa.table([own if f.name == text_col else next(others).cast(f.type) for f in schema], schema=schema)
