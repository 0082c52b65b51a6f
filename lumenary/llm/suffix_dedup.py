"""Removal of byte strings that an earlier document holds, by prefix-free parsing.

Every string of ``length`` bytes that also starts in a document of smaller id is removed, to the
byte, however strings overlap. Suffixes of the whole corpus are never sorted one by one:

* A rolling hash of ``trigger`` bytes cuts documents into phrases: a trigger is where the hash is
  least among those inside some string of ``length`` bytes. Every such string holds a trigger,
  and equal strings hold it at the same place, so equal strings share a trigger's bytes.
* Triggers that one document alone has cannot lie in a repeated string. Which ones several have
  is found from sorted hashes, each kept once for each chunk of documents.
* For the other triggers, the distinct phrase contexts of a chunk form the dictionary: what stands
  before and after the trigger, as far as strings that hold it reach, with the least document.
* Contexts with one trigger are sorted twice, by what follows it (the suffix array of the parse)
  and by what stands before it, read backwards (that of the dictionary), with common prefixes of
  neighbours. A string that begins j bytes before its trigger is one class of either order at its
  length, so two arrays of numbers name all equal strings, and the least document of each.
* A trigger near the end of a common passage has another context in every document. Where one has
  more contexts than a task should sort, its strings themselves are hashed and dealt, each once for
  each chunk, so no trigger's work grows beyond a bound.

Hashes have 64 bits, and bytes of one trigger's contexts are compared as they are sorted; only
which triggers and whole contexts of a chunk are one, and which strings of a hot trigger, is
decided by hash.

What moves between executors is numbers and contexts, dealt by the trigger's hash and made unique
in each chunk first, so a passage that a third of all documents hold is sent once for each chunk.
Texts move once, when chunks are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenary.llm.chunks import Chunk, chunked, pack_numbers, unpack_numbers, whole_rows
from lumenary.llm.common import checkpointed, partitions, release, tidy, tidy_pair
from lumenary.llm.hashing import Rolling, runs

#: String starts that are worked on at once: few enough for arrays of them to stay in a core's cache.
SLICE = 1 << 16
#: Triggers of one bucket, at most, about, and contexts of one trigger from which its strings are dealt.
BUCKET, HOT = 1_500_000, 100_000


class Parse:
    """Triggers of a chunk: ``at`` byte, ``first`` and ``last`` start of the strings that hold it.

    ``hashed`` is the hash of the trigger, ``whole`` that of all bytes of its strings together
    with its place among them, ``doc`` the document's number in the chunk.
    """

    def __init__(self, chunk: Chunk, length: int, trigger: int):
        parts = [np.zeros(0, np.int64)] * 4, [np.zeros(0, np.uint64)] * 2
        found = [self._slice(chunk, a, length, trigger) for a in range(0, max(0, len(chunk.data) - length + 1), SLICE)]
        at, first, last, doc, hashed, whole = (np.concatenate([x, *y]) for x, y in zip((*parts[0], *parts[1]), zip(*found))) if found else (*parts[0], *parts[1])
        self.at, self.first, self.last, self.doc, self.hashed, self.whole = at, first, last, doc, hashed, whole

    @staticmethod
    def _slice(chunk: Chunk, a: int, length: int, trigger: int) -> tuple[np.ndarray, ...]:
        data, ends = chunk.data[a : a + SLICE + length - 1], chunk.ends
        rolling = Rolling(data)
        windows = rolling.windows(trigger)
        # the hash above, the place below: the least is the leftmost of the least hashes
        least = windows & np.uint64(0xFFFFFFFF00000000) | np.arange(len(windows), dtype=np.uint64)
        width, span = length - trigger + 1, 1
        while 2 * span <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < width:
            rest = width - span
            least = np.minimum(least[:-rest], least[rest:])
        inside = np.ones(len(least), bool)
        for end in ends[np.searchsorted(ends, a) : np.searchsorted(ends, a + len(data), side="right")].tolist():
            inside[max(0, end - a - length + 1) : max(0, end - a)] = False
        starts = np.flatnonzero(inside)
        at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(starts, prepend=-2) != 1))
        last = np.concatenate((new[1:], [len(at)])) - 1 if len(at) else new
        at, first, last = at[new], starts[new], starts[last]
        doc = np.searchsorted(ends, first + a, side="right")
        whole = rolling.spans(first, last + length) + (at - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return at + a, first + a, last + a, doc, windows[at], whole


def _bucketed(hashed: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash, and its number there."""
    return (hashed % np.uint64(buckets)).astype(np.int64), hashed >> np.uint64(16)


class Request:
    """A chunk's triggers by bucket and hash: distinct ones, as they are asked for and answered."""

    def __init__(self, parse: Parse, doc_ids: np.ndarray, buckets: int):
        bucket, name = _bucketed(parse.hashed, buckets)
        doc = doc_ids[parse.doc]
        self.order = np.lexsort((doc, name, bucket))
        bucket, name, doc = bucket[self.order], name[self.order], doc[self.order]
        new = np.flatnonzero((np.diff(bucket, prepend=-1) != 0) | np.concatenate(([True], name[1:] != name[:-1]))[: len(name)])
        self.group = np.zeros(len(bucket), np.int64)
        self.group[new[1:]] = 1
        self.group = np.cumsum(self.group)
        last = np.concatenate((new[1:], [len(bucket)])) - 1 if len(new) else new
        self.bucket, self.name, self.several = bucket[new], name[new], doc[new] != doc[last]
        self.buckets, self.cuts = runs(self.bucket)

    def contexts(self, parse: Parse) -> np.ndarray:
        """How many distinct contexts each trigger has."""
        whole = parse.whole[self.order]
        order = np.lexsort((whole, self.group))
        group, whole = self.group[order], whole[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (whole[1:] != whole[:-1])))[: len(group)]
        return np.bincount(group[new], minlength=len(self.bucket)).astype("<u4")

    def classes(self, answers: dict[int, bytes]) -> np.ndarray:
        """Of each trigger of the parse: 0 where one document alone has it, 2 where it is hot, else 1."""
        told = np.zeros(len(self.bucket), np.uint8)
        for bucket, a, b in zip(self.buckets.tolist(), self.cuts, self.cuts[1:]):
            told[a:b] = np.frombuffer(zstandard.decompress(answers[bucket]), np.uint8)
        out = np.zeros(len(self.order), np.uint8)
        out[self.order] = told[self.group]
        return out


def _several(table: pa.Table, hot: int) -> pa.Table:
    """Of one bucket: for each chunk, the classes of its triggers."""
    names = [unpack_numbers(x) for x in table.column("names").to_pylist()]
    flags = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) for x, n in zip(table.column("flags").to_pylist(), names)]
    counts = [np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column("counts").to_pylist()]
    name, flag = np.concatenate(names), np.concatenate(flags).astype(bool)
    order = np.argsort(name, kind="stable")
    ranked = name[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)]
    group = np.cumsum(new) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, flag[order]) > 0)
    told = np.zeros(len(name), np.uint8)
    told[order] = (many + (many & (np.bincount(group, np.concatenate(counts)[order]) > hot)).astype(np.uint8))[group]
    cuts = np.cumsum([len(n) for n in names])[:-1]
    bits = [zstandard.compress(x.tobytes(), 1) for x in np.split(told, cuts)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


class Strings:
    """A chunk's strings that hold hot triggers, distinct ones by bucket and hash."""

    def __init__(self, chunk: Chunk, parse: Parse, hot: np.ndarray, length: int, buckets: int):
        rows = np.flatnonzero(hot)
        size = parse.last[rows] - parse.first[rows] + 1
        ends = np.cumsum(size)
        self.start = np.repeat(parse.first[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        doc = chunk.doc_ids[np.repeat(parse.doc[rows], size)]
        hashed = np.zeros(len(self.start), np.uint64)
        for a in np.unique(self.start // SLICE).tolist():
            on = np.flatnonzero(self.start // SLICE == a)
            at = self.start[on] - a * SLICE
            hashed[on] = Rolling(chunk.data[a * SLICE : (a + 1) * SLICE + length]).spans(at, at + length)
        bucket = (hashed % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, hashed, bucket))
        self.start, doc, hashed, bucket = self.start[order], doc[order], hashed[order], bucket[order]
        new = np.concatenate(([True], (hashed[1:] != hashed[:-1]) | (bucket[1:] != bucket[:-1])))[: len(hashed)]
        heads, self.group = np.flatnonzero(new), np.cumsum(new) - 1
        self.name, self.least = hashed[heads], doc[heads]
        self.later = doc > self.least[self.group]  # an earlier document of the chunk has it
        self.buckets, self.cuts = runs(bucket[heads])

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Starts of the strings that an earlier document has."""
        told = np.zeros(len(self.name), bool)
        for bucket, a, b in zip(self.buckets.tolist(), self.cuts, self.cuts[1:]):
            told[a:b] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=b - a)
        return self.start[self.later | told[self.group]]


def _least(table: pa.Table) -> pa.Table:
    """Of one bucket of strings: for each chunk, which of them an earlier document than its own has."""
    names = [unpack_numbers(x) for x in table.column("contexts").to_pylist()]
    name, doc = np.concatenate(names), np.concatenate([unpack_numbers(x) for x in table.column("docs").to_pylist()]).astype(np.int64)
    order = np.lexsort((doc, name))
    new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
    told = np.zeros(len(name), bool)
    told[order] = doc[order][new][np.cumsum(new) - 1] < doc[order]
    bits = [np.packbits(x).tobytes() for x in np.split(told, np.cumsum([len(n) for n in names])[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


class Contexts:
    """A chunk's dictionary: the distinct contexts of its repeated triggers, by bucket and hash."""

    def __init__(self, chunk: Chunk, parse: Parse, repeated: np.ndarray, length: int, trigger: int, buckets: int):
        self.rows = np.flatnonzero(repeated)
        bucket, _ = _bucketed(parse.hashed[self.rows], buckets)
        doc = chunk.doc_ids[parse.doc[self.rows]]
        whole = parse.whole[self.rows]
        order = np.lexsort((doc, whole, bucket))
        bucket, whole, self.rows, doc = bucket[order], whole[order], self.rows[order], doc[order]
        new = np.concatenate(([True], (whole[1:] != whole[:-1]) | (bucket[1:] != bucket[:-1])))[: len(whole)]
        self.group = np.cumsum(new) - 1
        self.heads = np.flatnonzero(new)
        self.doc, self.least = doc, doc[self.heads]
        self.buckets, self.cuts = runs(bucket[self.heads])
        at = self.rows[self.heads]
        self.left = parse.at[at] - parse.first[at]
        self.right = parse.last[at] + length - parse.at[at] - trigger
        self.at = parse.at[at]

    def bytes_of(self, chunk: Chunk, a: int, b: int, reach: int, trigger: int) -> np.ndarray:
        """Contexts a to b: ``reach`` bytes, trigger, ``reach`` bytes; zero beyond its strings."""
        offsets = np.arange(-reach, trigger + reach)
        at, left, right = self.at[a:b, None], self.left[a:b, None], self.right[a:b, None]
        held = chunk.data[np.clip(at + offsets, 0, len(chunk.data) - 1)]
        return np.where((offsets >= -left) & (offsets < trigger + right), held, 0).astype(np.uint8)


def _ranks(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of byte rows, and how many bytes each has in common with the one before."""
    n, width = columns.shape
    padded = np.zeros((n, -(-width // 8) * 8), np.uint8)
    padded[:, :width] = columns
    keys = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(keys.T[::-1])
    ranked = columns[order]
    differs = ranked[1:] != ranked[:-1]
    common = np.where(differs.any(1), differs.argmax(1), width) if n > 1 else np.zeros(0, np.int64)
    return order, np.concatenate(([0], common)).astype(np.int64)[:n]


def _classes(order: np.ndarray, common: np.ndarray, size: int) -> np.ndarray:
    """For each row the number of its class among rows with the same first ``size`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < size)
    return out


def _earlier(table: pa.Table, length: int, trigger: int) -> pa.Table:
    """Of one bucket: for each context, which of its strings an earlier document than its own has."""
    reach = length - trigger
    blobs = [zstandard.decompress(x) for x in table.column("contexts").to_pylist()]
    sizes = [len(x) // (trigger + 2 * reach) for x in blobs]
    bodies = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, trigger + 2 * reach)
    left, right = (
        np.concatenate([np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column(name).to_pylist()]).astype(np.int64)
        for name in ("lefts", "rights")
    )
    doc = np.concatenate([unpack_numbers(x) for x in table.column("docs").to_pylist()]).astype(np.int64)
    del blobs
    by_doc = np.argsort(doc, kind="stable")  # so that the first of a class is of the least document
    bodies, left, right, doc = bodies[by_doc], left[by_doc], right[by_doc], doc[by_doc]
    after = _ranks(bodies[:, reach:])
    before = _ranks(bodies[:, :reach][:, ::-1])
    told = np.zeros((len(doc), reach + 1), bool)
    for j in range(reach + 1):
        on = np.flatnonzero((left >= j) & (right >= reach - j))
        if len(on) < 2:
            continue
        key = _classes(*after, trigger + reach - j)[on] * np.int64(len(doc) + 1) + _classes(*before, j)[on]
        order = np.argsort(key, kind="stable")
        new = np.concatenate(([True], np.diff(key[order]) != 0))
        least = doc[on[order[new]]][np.cumsum(new) - 1]
        told[on[order], j] = least < doc[on[order]]
    back = np.empty_like(told)
    back[by_doc] = told
    bits = [np.packbits(x).tobytes() for x in np.split(back, np.cumsum(sizes)[:-1])]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})


def _removed(chunk: Chunk, parse: Parse, held: Contexts, hot: np.ndarray, answers: dict[int, bytes], length: int, trigger: int) -> np.ndarray:
    """Which bytes of the chunk are covered by a string of an earlier document; ``hot``: starts known to be so."""
    reach = length - trigger
    told = np.zeros((len(held.heads), reach + 1), bool)
    for bucket, a, b in zip(held.buckets.tolist(), held.cuts, held.cuts[1:]):
        bits = np.frombuffer(answers[bucket], np.uint8)
        told[a:b] = np.unpackbits(bits, count=(b - a) * (reach + 1)).reshape(-1, reach + 1)
    cover = np.zeros(len(chunk.data) + 1, np.int32)
    np.add.at(cover, hot, 1)
    np.add.at(cover, hot + length, -1)
    later = held.doc > held.least[held.group]  # an earlier document of the chunk has all of these strings
    rows = held.rows[later]
    np.add.at(cover, parse.first[rows], 1)
    np.add.at(cover, parse.last[rows] + length, -1)
    same = np.flatnonzero(~later)
    row, j = np.nonzero(told[held.group[same]])
    start = parse.at[held.rows[same[row]]] - j
    np.add.at(cover, start, 1)
    np.add.at(cover, start + length, -1)
    return np.cumsum(cover[:-1]) > 0


def remove_repeats(
    docs: DataFrame, length: int = 50, trigger: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """``doc_id, n_bytes, n_removed, spans, kept`` of every row.

    ``spans`` are the maximal removed runs (``start, stop`` in bytes) and ``kept`` is the rest of
    the text's bytes. Strings are judged on the input. A null text is empty and a text shorter
    than ``length`` keeps all. Rows of one id do not remove each other's strings; a row without an
    id comes before all others. An empty table gives no rows. Other columns are not read.
    """
    shape = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept binary"

    def rows(texts: pa.Table, chunk: Chunk | None, gone: np.ndarray) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if chunk is not None:
            starts = np.concatenate(([0], chunk.ends[:-1]))
            for doc, a, b in zip(chunk.doc_ids.tolist(), starts.tolist(), chunk.ends.tolist()):
                mask = gone[a:b]
                n = int(np.count_nonzero(mask))
                edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0)) if n else np.zeros(0, np.int64)
                out[0].append(None if doc == np.iinfo(np.int64).min else doc)
                out[1].append(b - a)
                out[2].append(n)
                out[3].append([{"start": x, "stop": y} for x, y in edges.reshape(-1, 2).tolist()])
                out[4].append((chunk.data[a:b][~mask] if n else chunk.data[a:b]).tobytes())
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "spans": span, "kept": pa.binary()}
        return pa.table({name: pa.array(column, kind) for (name, kind), column in zip(kinds.items(), out)})

    return _pass(chunked(docs, id_col, text_col), length, trigger, rows, shape, hot)


def without_repeats(
    docs: DataFrame, length: int, trigger: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT
) -> DataFrame:
    """``docs`` with those strings taken out of the texts, all columns kept.

    A character that a removed string cuts goes, too. A document of which nothing visible is left
    goes; one that lost nothing stays as it was, null and empty texts included. Rows of one id do
    not take from each other, and a row without an id comes before all others; an empty table
    gives no rows.
    """
    schema = docs.schema
    arrow = to_arrow_schema(schema)

    def rows(texts: pa.Table, chunk: Chunk | None, gone: np.ndarray) -> pa.Table:
        if chunk is None:
            return arrow.empty_table()
        keep, left = [], []
        for k, (a, b) in enumerate(zip(np.concatenate(([0], chunk.ends[:-1])).tolist(), chunk.ends.tolist())):
            mask = gone[a:b]
            if mask.any():
                text = chunk.data[a:b][~mask].tobytes().decode("utf-8", "ignore")
                if not text.strip():
                    continue
            else:
                text = chunk.text(k).decode("utf-8", "surrogatepass")
            keep.append(k)
            left.append(text)
        return whole_rows(texts, arrow, text_col, np.array(keep, np.int64), left)

    return _pass(chunked(docs, id_col, text_col, whole=True), length, trigger, rows, schema, hot)


def _pass(chunks: DataFrame, length: int, trigger: int | None, rows: Callable, shape, hot: int = HOT) -> DataFrame:
    """``rows(chunk row, chunk, removed bytes)`` of every chunk."""
    trigger = trigger or min(32, max(1, length * 2 // 3))
    if not 0 < trigger < length:
        raise ValueError("a trigger must be shorter than the strings that are removed")
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(partitions(chunks.sparkSession), int(2 * total / (length - trigger + 2) / BUCKET))
    reach = length - trigger

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                chunk = Chunk(*packed)
                parse = Parse(chunk, length, trigger)
                request = Request(parse, chunk.doc_ids, buckets)
                counts = request.contexts(parse)
                own = list(zip(request.buckets.tolist(), request.cuts, request.cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(own), pa.int64()),
                        pa.array([b for b, _, _ in own], pa.int64()),
                        pa.array([pack_numbers(request.name[x:y]) for _, x, y in own], pa.binary()),
                        pa.array([np.packbits(request.several[x:y]).tobytes() for _, x, y in own], pa.binary()),
                        pa.array([zstandard.compress(counts[x:y].tobytes(), 1) for _, x, y in own], pa.binary()),
                    ],
                    names=["chunk", "bucket", "names", "flags", "counts"],
                )
        release()

    asked = chunks.select("chunk", "doc_ids", "ends", "texts").mapInArrow(ask, "chunk long, bucket long, names binary, flags binary, counts binary")
    several = checkpointed(asked.groupBy("bucket").applyInArrow(tidy(lambda t: _several(t, hot)), "chunk long, bucket long, bits binary"))

    def parsed(texts: pa.Table, told: pa.Table) -> tuple[Chunk, Parse, Contexts, Strings]:
        chunk = Chunk.of(texts)
        parse = Parse(chunk, length, trigger)
        answers = dict(zip(told.column("bucket").to_pylist(), told.column("bits").to_pylist()))
        classes = Request(parse, chunk.doc_ids, buckets).classes(answers)
        return chunk, parse, Contexts(chunk, parse, classes == 1, length, trigger, buckets), Strings(chunk, parse, classes == 2, length, buckets)

    def look(texts: pa.Table, told: pa.Table) -> pa.Table:
        rows: dict[str, list] = {k: [] for k in ("chunk", "bucket", "contexts", "lefts", "rights", "docs")}
        if texts.num_rows:
            chunk, _, held, strings = parsed(texts, told)
            packer = zstandard.ZstdCompressor(level=1)
            for b, x, y in zip(held.buckets.tolist(), held.cuts, held.cuts[1:]):
                rows["chunk"].append(texts.column("chunk")[0].as_py())
                rows["bucket"].append(b)
                rows["contexts"].append(packer.compress(held.bytes_of(chunk, x, y, reach, trigger).tobytes()))
                rows["lefts"].append(packer.compress(held.left[x:y].astype("<u4").tobytes()))
                rows["rights"].append(packer.compress(held.right[x:y].astype("<u4").tobytes()))
                rows["docs"].append(pack_numbers(held.least[x:y]))
            for b, x, y in zip(strings.buckets.tolist(), strings.cuts, strings.cuts[1:]):  # buckets beyond those of contexts
                for name, value in zip(rows, (texts.column("chunk")[0].as_py(), buckets + b, pack_numbers(strings.name[x:y]), None, None, pack_numbers(strings.least[x:y]))):
                    rows[name].append(value)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(rows.items(), kinds)})

    contexts = (
        chunks.groupBy("chunk").cogroup(several.groupBy("chunk"))
        .applyInArrow(tidy_pair(look), "chunk long, bucket long, contexts binary, lefts binary, rights binary, docs binary")
    )

    def compare(table: pa.Table) -> pa.Table:
        return _earlier(table, length, trigger) if table.column("bucket")[0].as_py() < buckets else _least(table)

    earlier = checkpointed(
        contexts.groupBy("bucket").applyInArrow(tidy(compare), "chunk long, bucket long, bits binary")
    )
    both = several.withColumn("kind", F.lit(0)).unionByName(earlier.withColumn("kind", F.lit(1)))

    def finish(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return rows(texts, None, np.zeros(0, bool))
        kind = told.column("kind").to_numpy()
        chunk, parse, held, strings = parsed(texts, told.filter(pa.array(kind == 0)))
        own = told.filter(pa.array(kind == 1))
        answers = dict(zip(own.column("bucket").to_pylist(), own.column("bits").to_pylist()))
        again = strings.repeated({bucket - buckets: bits for bucket, bits in answers.items()})
        return rows(texts, chunk, _removed(chunk, parse, held, again, answers, length, trigger))

    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(tidy_pair(finish), shape)
