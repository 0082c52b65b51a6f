"""Packing of tokenized documents into fixed windows by the sum-of-squares rule.

Each document goes, as it arrives, to the fill level that keeps the sum of squared counts of
partially filled windows least (Csirik et al., "On the sum-of-squares algorithm for bin packing").
The counts by level are one array of ``window`` numbers. A document longer than a window first
fills windows of its own; what is left of it is placed by the rule. The ids of open windows are
bounded in bytes: beyond that the windows of the levels that hold most are poured together,
cutting documents at the borders, which fills windows without padding. At the end of a task all
that is open is poured, so each task leaves one partly filled window at most.

A task packs the documents of its own input split: nothing is shuffled, and a lost task is
simply run again. Sequence numbers are unique; the split's number is in their upper bits.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.llm.common import text_batches
from lumenary.llm.tokenizing import piece_tokenizer

#: Lower bits of a sequence number: its place among its task's sequences.
SEQUENCE_BITS = 36
#: Bytes of ids in a task's open windows from which fullest levels are poured together.
OPEN_BYTES = 32 << 20


class Piece:
    __slots__ = ("doc", "start", "tokens", "ids")

    def __init__(self, doc, start: int, tokens: int, ids: bytes):
        self.doc, self.start, self.tokens, self.ids = doc, start, tokens, ids


class SumOfSquares:
    """Online packer; ``add`` and ``close`` yield finished windows, each a list of pieces."""

    def __init__(self, window: int, most: int = OPEN_BYTES):
        self.window, self.most, self.held = window, most, 0  # held: bytes of ids in open windows
        self.counts = np.zeros(window + 1, np.int64)  # the last stays 0: full windows do not count
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """Fill level for a piece: least change of the sum of squares, a fuller window on ties."""
        n, room = self.counts, self.window - size
        best, change = 0, 2 * n[size] + 1 if size < self.window else 0
        levels = np.flatnonzero(n[1 : room + 1]) + 1
        if len(levels):
            after = levels + size
            cost = np.where(after < self.window, 2 * (n[after] - n[levels]) + 2, 1 - 2 * n[levels])
            k = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[k] <= change:
                best = int(levels[k])
        return best

    def add(self, doc, ids: bytes) -> Iterator[list[Piece]]:
        size, tokens = 4 * self.window, len(ids) // 4
        at = 0
        while len(ids) - at >= size:
            yield [Piece(doc, at // 4, tokens, ids[at : at + size])]
            at += size
        rest = (len(ids) - at) // 4
        if not rest:
            return
        level = self.level(rest)
        pieces = self._take(level) if level else []
        pieces.append(Piece(doc, at // 4, tokens, ids[at:]))
        if level + rest == self.window:
            yield pieces
        else:
            self._put(level + rest, pieces)
            if self.held > self.most:
                size = self.counts[: self.window] * np.arange(self.window)
                order = np.argsort(-size, kind="stable")
                enough = int(np.searchsorted(np.cumsum(size[order]), self.held // 8)) + 1
                yield from self._pour([[self._take(k) for _ in range(self.counts[k])] for k in order[:enough].tolist()], again=True)

    def _take(self, level: int) -> list[Piece]:
        self.counts[level] -= 1
        self.held -= 4 * level
        return self.open[level].pop()

    def _put(self, level: int, pieces: list[Piece]) -> None:
        self.counts[level] += 1
        self.held += 4 * level
        self.open[level].append(pieces)

    def close(self) -> Iterator[list[Piece]]:
        levels = self.open[::-1]
        self.open = [[] for _ in range(self.window)]
        self.counts[:] = self.held = 0
        yield from self._pour(levels)

    def _pour(self, levels: Iterable[list[list[Piece]]], again: bool = False) -> Iterator[list[Piece]]:
        """Full windows of the windows' pieces; what is left is one more, open ``again`` or not."""
        now: list[Piece] = []
        room = 4 * self.window
        for windows in levels:
            for piece in (p for pieces in windows for p in pieces):
                at = 0
                while at < len(piece.ids):
                    part = piece.ids[at : at + room]
                    now.append(Piece(piece.doc, piece.start + at // 4, piece.tokens, part))
                    at, room = at + len(part), room - len(part)
                    if not room:
                        yield now
                        now, room = [], 4 * self.window
        if now and again:
            self._put(self.window - room // 4, now)
        elif now:
            yield now


def _packer(path: str, spaced: bool, plain: bool, end_id: int, window: int, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = piece_tokenizer(path, spaced, plain=plain), np.array([end_id], "<u4").tobytes()
        packer, held, done = SumOfSquares(window), [], 0
        first = TaskContext.get().partitionId() << SEQUENCE_BITS

        def rows(windows: Iterable[list[Piece]]) -> int:
            nonlocal done
            size = 0
            for pieces in windows:
                offset = 0
                for p in pieces:
                    held.append((p.doc, p.start, len(p.ids) // 4, p.tokens, first + done, offset, p.ids))
                    offset += len(p.ids) // 4
                size += 4 * offset
                done += 1
            return size

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held.clear()
            return batch

        size = 0
        for part, texts in text_batches(batches, "text", keep=True):
            for doc, ids in zip(part.column(0).to_pylist(), tokenizer.ids(texts)):
                size += rows(packer.add(doc, ids.tobytes() + end))
                if size > 8 << 20:
                    yield out()
                    size = 0
        rows(packer.close())
        if held:
            yield out()

    return run


def pack(
    docs: DataFrame, path: str, *, spaced: bool, end_id: int, window: int = 4096, plain: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of tokenized documents in windows of ``window`` tokens.

    Returns ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (ids: little-endian
    unsigned 32-bit). ``end_id`` ends every document, so an empty or null text is that one token.
    A null id stays null; repeated rows are separate documents; an empty table gives no rows. Of
    fill levels that are equally good the fullest is taken. The string of an added token is that
    token, as the library has it, or with ``plain`` ordinary text where the token is a special one.
    Other columns are not read.
    """
    spark_schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType)]
        + [T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")]
        + [T.StructField("ids", T.BinaryType())]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _packer(path, spaced, plain, end_id, window, to_arrow_schema(spark_schema))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, spark_schema)
