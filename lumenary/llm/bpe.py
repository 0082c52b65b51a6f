"""Byte-level BPE encoding and decoding by ranks, with a segment tree over each piece.

A text is cut by the vocabulary's pattern. Within a piece, the tree's leaves are byte positions
that hold the rank of the pair which begins there, and every inner node the leftmost least rank
below it, so the root names the next merge. A merge updates three leaves on the way to the root:
the merged token's, its absorbed neighbour's and its live predecessor's. A piece of n bytes takes
O(n log n), whatever it holds. A piece that is itself in the vocabulary is that one id.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenary.llm.common import kept_in_worker, text_batches, without_collector
from lumenary.llm.piece_table import TextCoder, gather

#: Above every key of the tree.
_NONE = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks: lines of base64, a space and the rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank is merged until none has a rank."""
    n = len(piece)
    if piece in ranks:
        return [ranks[piece]]
    bits = n.bit_length()
    at_mask, size = (1 << bits) - 1, 1 << (n - 1).bit_length()
    following, before = list(range(1, n + 1)) + [n], list(range(-1, n))
    get = ranks.get

    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for node in range(size - 1, 0, -1):
        a, b = tree[2 * node], tree[2 * node + 1]
        tree[node] = a if a < b else b

    def put(i: int, key: int) -> None:
        node = size + i
        tree[node] = key
        while node > 1:
            a, b = tree[node], tree[node ^ 1]
            least = a if a < b else b
            node >>= 1
            if tree[node] == least:
                return
            tree[node] = least

    while (least := tree[1]) != _NONE:
        i = least & at_mask
        gone = following[i]
        end = following[gone]
        following[i] = end
        before[end] = i
        put(gone, _NONE)
        rank = get(piece[i : following[end]]) if end < n else None
        put(i, _NONE if rank is None else rank << bits | i)
        previous = before[i]
        if previous >= 0:
            rank = get(piece[previous:end])
            put(previous, _NONE if rank is None else rank << bits | previous)

    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : following[i]]])
        i = following[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; ids of short pieces are kept, ``most`` at a time."""

    def __init__(self, path: str, pattern: str, most: int = 400_000):
        self.ranks = read_ranks(path)
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.bytes, self.ends = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum([0, *map(len, tokens)])
        self.names = list(map(str, range(len(tokens))))
        self.coder = TextCoder(pattern, self._learn, most)
        self.encode = without_collector(self.coder.ids)

    def _learn(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [merge(data[a : a + n].tobytes(), self.ranks) for a, n in zip(starts.tolist(), lengths.tolist())]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.array([id for ids in found for id in ids], np.uint32), counts

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.bytes, self.ends[ids], self.ends[ids + 1])[0].tobytes()

    def listed(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by commas."""
        return ",".join(map(self.names.__getitem__, ids.tolist())).encode()


@kept_in_worker
@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.uint32), *ids]).astype(np.int32)))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: each whole text's ids as an array of int.

    A null or empty text has the empty array; a null id stays null; repeated rows are encoded each
    for itself; an empty table gives no rows. Of pairs of one rank the leftmost merges first.
    Strings of special tokens are ordinary text. Other columns are not read.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for part, texts in text_batches(batches, "text", 4 << 20, keep=True):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(coder.encode(texts)).cast(arrow[1].type)], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, ids, decoded``: the bytes that the ids of ``encode`` stand for.

    An empty array gives no bytes, a null one null; repeated rows are decoded each for itself; an
    empty table gives no rows. Other columns are not read. An id beyond the vocabulary is an error.
    """
    schema = T.StructType([*encoded.select("doc_id", "ids").schema, T.StructField("decoded", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        for batch in batches:
            ids = batch.column(1)
            values, ends = ids.values.to_numpy(), ids.offsets.to_numpy()
            found = [coder.decode(values[a:b]) if known else None for a, b, known in zip(ends, ends[1:], ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(found, pa.binary())], schema=arrow)

    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: whole texts encoded, and their ids decoded.

    The digests are of the decimal ids, joined by commas, and of the decoded bytes. One pass of one
    worker, so neither ids nor bytes leave it. Rows, nulls and special strings as in ``encode``.
    """
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for part, texts in text_batches(batches, "text", 4 << 20, keep=True):
            found = coder.encode(texts)
            columns = [len(ids) for ids in found], [sha(coder.listed(ids)) for ids in found], [sha(coder.decode(ids)) for ids in found]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, [*arrow][1:]))], schema=arrow)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
