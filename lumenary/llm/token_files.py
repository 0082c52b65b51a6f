"""Token ids as binary segments: one array of ids, with Elias-Fano document boundaries.

A segment holds consecutive documents in ascending id order:

    magic, width of an id (2 or 4 bytes), ids before it in its range, number of its ids
    document ids (rising, Elias-Fano over their distance from the least; nulls first, counted)
    ends of the documents in the array of ids (Elias-Fano, with the places that select starts from)
    the ids, little-endian

Documents are dealt to ranges of their id (about equal in rows), a range is written by one task,
a few megabytes at a time, and the segments are kept as rows of a table, which any store that
Spark writes to can hold. How many ids come before a range is a sum over ranges, whose number is
the number of partitions; a task that reads a segment needs that number only.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import binaries, partitions, scratch, text_batches
from lumenary.llm.elias_fano import EliasFano
from lumenary.llm.ranges import range_bounds, range_of
from lumenary.llm.tokenizing import piece_tokenizer

MAGIC = b"EFTOKEN1"
_HEAD = struct.Struct("<8sIQQQq")


def write_segment(doc_ids: list[int | None], ids: list[bytes], width: int, before: int) -> bytes:
    """One segment; ``ids`` are little-endian, ``width`` bytes each, documents in ascending order."""
    ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // width)
    nulls = sum(x is None for x in doc_ids)
    known = np.array(doc_ids[nulls:], np.int64)
    least = int(known[0]) if len(known) else 0
    n_ids = int(ends[-1])
    names = EliasFano.of(known - least, int(known[-1]) - least + 1 if len(known) else 1)
    head = _HEAD.pack(MAGIC, width, before, n_ids, nulls, least)
    return b"".join((head, names.to_bytes(), EliasFano.of(ends, n_ids + 1).to_bytes(), *ids))


class Segment:
    """A segment read back; document k's ids are ``ids[start(k):end(k)]``."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, width, self.before, n_ids, self.nulls, self.least = _HEAD.unpack_from(view)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.names, size = EliasFano.from_bytes(view[at:])
        at += size
        self.ends, size = EliasFano.from_bytes(view[at:])
        self.ids = np.frombuffer(view[at + size :], f"<u{width}")
        if len(self.ids) != n_ids:
            raise ValueError("a token segment was cut short")

    def __len__(self) -> int:
        return self.ends.n

    def start(self, k: int) -> int:
        return self.ends[k - 1] if k else 0

    def end(self, k: int) -> int:
        return self.ends[k]

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.names.all() + self.least).tolist()


def write(
    docs: DataFrame, path: str, target: str, *, spaced: bool, end_id: int, width: int = 2,
    segment_bytes: int = 4 << 20, plain: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> None:
    """Tokenize ``docs`` and write its segments to ``target``.

    Documents ascend by id, nulls first, repeated ids by their ids' bytes. ``end_id`` ends every
    document, so a null or empty text is that one id. An empty table writes no segment. ``width``
    2 is for vocabularies of 65,536 ids at most; a greater id is an error. The string of an added
    token is that token, or with ``plain`` ordinary text where it is a special one.
    """
    spark = docs.sparkSession
    bounds = range_bounds(docs, id_col, partitions(spark))

    def tokenize(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = piece_tokenizer(path, spaced, plain=plain), np.array([end_id], np.uint32)
        for part, texts in text_batches(batches, "text", 4 << 20, keep=True):
            found = tokenizer.ids(texts)
            ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
            flat = np.concatenate([x for ids in found for x in (ids, end)])
            if int(flat.max()) >> 8 * width:
                raise ValueError(f"an id of {flat.max()} does not fit {width} bytes")
            flat = flat.astype(f"<u{width}")
            where = range_of(part.column(0), bounds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), part.column(0), binaries(flat, ends * width)], names=["part", "doc_id", "ids"]
            )

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before, size, names, ids = None, 0, 0, [], []

        def out() -> pa.RecordBatch:
            n = size // width
            data = write_segment(names, ids, width, before)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["part", "n_ids", "segment"]
            )

        for batch in batches:
            for where, name, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if names and (where != now or size >= segment_bytes):
                    yield out()
                    before = before + size // width if where == now else 0
                    size, names, ids = 0, [], []
                elif where != now:
                    before = 0
                now = where
                names.append(name)
                ids.append(data)
                size += len(data)
        if names:
            yield out()

    tokens = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        tokenize, "part int, doc_id long, ids binary"
    )
    rows = tokens.repartitionById(partitions(spark), "part").sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "ids")
    rows.mapInArrow(segments, "part int, n_ids long, segment binary").write.option("compression", "none").parquet(
        target
    )


def read(stored: DataFrame) -> DataFrame:
    """``doc_id, start, ids`` of every document in stored segments, its borders by select.

    ``start`` counts the ids of all documents before it; ids that repeat or are null are so read
    back; no segment gives no rows. The driver gets one number for each
    range of document ids (the writer's number of partitions), no more.
    """
    totals = dict(stored.groupBy("part").agg(F.sum("n_ids")).collect())
    bases, total = {}, 0
    for part in sorted(totals):
        bases[part], total = total, total + totals[part]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = Segment(data.as_buffer().to_pybytes())
                ends = np.fromiter(map(held.end, range(len(held))), np.int64, len(held))
                starts = np.fromiter(map(held.start, range(len(held))), np.int64, len(held))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held.doc_ids(), pa.int64()), pa.array(starts + held.before + bases[part], pa.int64()), binaries(held.ids.astype("<u4"), 4 * ends)],
                    names=["doc_id", "start", "ids"],
                )

    return stored.select("part", "segment").mapInArrow(run, "doc_id long, start long, ids binary")


def round_trip(docs: DataFrame, path: str, **options) -> DataFrame:
    """Write ``docs`` to a new folder beside the session's checkpoints and read it back.

    ``options`` are those of ``write``, and so are nulls, empty texts, ties and empty tables.
    """
    target = f"{scratch(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, target, **options)
    return read(docs.sparkSession.read.schema("part int, n_ids long, segment binary").parquet(target))


