"""Exact Jaccard join of documents on word n-grams, with a token-group matrix.

Two documents link when 100 times their sets' intersection is at least ``percent`` times their
union. What comes out is connected components, so no pair inside a known one is ever made.

1. Chunks of documents say which n-grams they hold and how many of their distinct sets do; for
   each n-gram the sum over chunks gives a class of frequency. In a linked pair at least
   ``percent`` of either set is shared, so a document with more n-grams of its own than that
   allows is done. The others keep their shared n-grams in order: rarest class first, then by
   hash. Linked sets have one of the first ``size - need + 1`` of that order in common.
2. Documents with equal sets are one node, named by where the set first stands, as ids may be
   absent or repeated. A node is compared with the least node of the same
   least hash, for a few hash functions. Links found so far give first components, and pairs that
   are alike only half as much give looser groups.
3. Groups: a large component, or components of one looser group together, in blocks of bounded
   size. The token-group matrix has a row for each first n-gram and a column for each group, its
   union of them. Groups that share such a row are candidates; inside a group of several
   components, so are blocks that share one. For each query document of one
   block the overlap with the other block's union of all n-grams bounds every possible overlap;
   only where that reaches what the query needs is the block opened, and its documents compared
   exactly. Blocks of one component are never compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lumenary.llm import hashing
from lumenary.llm.chunks import Chunk, chunked, pack_numbers, temporary_chunks, unpack_numbers, whole_rows
from lumenary.llm.common import checkpointed, partitions, release, tidy, tidy_pair
from lumenary.llm.components import components
from lumenary.llm.hashing import mix

#: Hash functions of the first comparison, and the likeness in percent that makes a looser group.
STARS, LOOSE = 2, 50
#: Bytes of text whose n-grams are counted in one bucket, about.
BUCKET_BYTES = 12 << 20
#: Parts that nodes of one least hash are dealt to.
SALTS = 16
#: What chunks have for a null id.
NO_ID = -(1 << 63)
#: Documents of a block, and of a component that is a group of its own.
BLOCK, LARGE = 256, 64

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache(maxsize=8)
def _places(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(data: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each text's distinct word n-grams, rising, and where each text's end.

    Words are what spaces and the bytes 0x09 to 0x0D separate, A-Z in lower case. A text with
    fewer than n words has its whole sequence as one; one without words has none.
    """
    data = _LOWER[data]
    starts, stops, text = hashing.words(data, ends, _INSIDE)
    own = hashing.word_hashes(data, starts, stops)
    places = _places(n)
    count = max(0, len(own) - n + 1)
    grams = np.zeros(count, np.uint64)
    for k in range(n):
        grams += mix(own[k : k + count] + places[k]) * places[k]
    whole = text[:count] == text[n - 1 :][:count]
    grams, where = grams[whole], text[:count][whole]
    words = np.bincount(text, minlength=len(ends))
    few = np.flatnonzero((words > 0) & (words < n))
    if len(few):
        first = np.searchsorted(text, few)
        short = words[few].astype(np.uint64)
        for k in range(n - 1):
            on = words[few] > k
            short[on] += mix(own[first[on] + k] + places[k]) * places[k]
        grams, where = np.concatenate((grams, short)), np.concatenate((where, few))
    order = np.lexsort((grams, where))
    grams, where = grams[order], where[order]
    new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (where[1:] != where[:-1])))[: len(grams)]
    return grams[new], np.searchsorted(where[new], np.arange(len(ends)), side="right")


class Sets:
    """A chunk's distinct n-gram sets; ``of`` names each document's (-1: empty)."""

    def __init__(self, chunk: Chunk, n: int):
        import xxhash

        parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in hashing.strips(chunk.ends):
            start = chunk.ends[a - 1] if a else 0
            found, own = shingles(chunk.data[start : chunk.ends[b - 1]], chunk.ends[a:b] - start, n)
            parts.append(found)
            sizes.append(np.diff(own, prepend=0))
        grams, ends = np.concatenate(parts), np.cumsum(np.concatenate(sizes))
        self.sizes = np.diff(ends, prepend=0)
        self.digests: list[str] = []
        self.of = np.full(len(ends), -1)
        seen: dict[str, int] = {}
        keep = []
        for doc, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends)):
            if b > a:
                name = xxhash.xxh3_128_hexdigest(grams[a:b].tobytes())
                if name not in seen:
                    seen[name] = len(keep)
                    keep.append((a, b))
                    self.digests.append(name)
                self.of[doc] = seen[name]
        self.lengths = np.array([b - a for a, b in keep], np.int64)
        self.grams = np.concatenate([np.zeros(0, np.uint64), *(grams[a:b] for a, b in keep)])
        self.set = np.repeat(np.arange(len(keep)), self.lengths)


def _node(chunk: int, own: int) -> int:
    """A number of its own for each set of each chunk, from the chunk's partition and place in it."""
    part, made = chunk >> 32, chunk & 0xFFFFFFFF
    if part >> 21 or made >> 20 or own >> 22:
        raise ValueError("too many partitions, chunks or sets for 63 bits")
    return part << 42 | made << 22 | own


class Asked:
    """A chunk's n-grams by bucket and shortened hash, each once, with the number of its sets."""

    def __init__(self, grams: np.ndarray, buckets: int, bits: int):
        bucket = (grams % np.uint64(buckets)).astype(np.int64)
        name = mix(grams) >> np.uint64(64 - bits)
        self.order = np.lexsort((name, bucket))
        bucket, name = bucket[self.order], name[self.order]
        new = np.concatenate(([True], (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])))[: len(name)]
        self.group = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.name, self.count = name[heads], np.diff(np.concatenate((heads, [len(name)])))
        self.buckets, self.cuts = hashing.runs(bucket[heads])

    def classes(self, answers: dict[int, bytes]) -> np.ndarray:
        told = np.zeros(len(self.name), np.uint8)
        for bucket, a, b in zip(self.buckets.tolist(), self.cuts, self.cuts[1:]):
            told[a:b] = np.frombuffer(zstandard.decompress(answers[bucket]), np.uint8)
        out = np.zeros(len(self.order), np.uint8)
        out[self.order] = told[self.group]
        return out


def _frequency(table: pa.Table) -> pa.Table:
    """Of one bucket: for each chunk, the bit lengths of its n-grams' counts over all chunks."""
    names = [unpack_numbers(x) for x in table.column("names").to_pylist()]
    counts = [np.frombuffer(zstandard.decompress(x), "<u4") for x in table.column("counts").to_pylist()]
    _, group = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(group, np.concatenate(counts))
    told = (np.floor(np.log2(total)) + 1).astype(np.uint8)[group]
    cuts = np.cumsum([len(x) for x in names])[:-1]
    found = [zstandard.compress(x.tobytes(), 1) for x in np.split(told, cuts)]
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "classes": pa.array(found, pa.binary())})


def _need(size, percent: int):
    """Least intersection of a set of ``size`` with any set it links to."""
    return -(-percent * size // 100)


def linked(both, a, b, percent: int):
    """Whether sets of sizes ``a`` and ``b`` with ``both`` common n-grams link."""
    return 100 * both >= percent * (a + b - both)


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def _sets(chunks: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows of every document (``kind`` 0) and of every set that may have a partner (1)."""
    total = chunks.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(partitions(chunks.sparkSession), total // BUCKET_BYTES)
    bits = min(56, max(24, (total // 5).bit_length() + 10))

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *packed in zip(*(batch.column(k).to_pylist() for k in range(4))):
                asked = Asked(Sets(Chunk(*packed), n).grams, buckets, bits)
                own = list(zip(asked.buckets.tolist(), asked.cuts, asked.cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([name] * len(own), pa.int64()),
                        pa.array([b for b, _, _ in own], pa.int64()),
                        pa.array([pack_numbers(asked.name[x:y]) for _, x, y in own], pa.binary()),
                        pa.array([zstandard.compress(asked.count[x:y].astype("<u4").tobytes(), 1) for _, x, y in own], pa.binary()),
                    ],
                    names=["chunk", "bucket", "names", "counts"],
                )
        release()

    asked = chunks.select("chunk", "doc_ids", "ends", "texts").mapInArrow(ask, "chunk long, bucket long, names binary, counts binary")
    classes = asked.groupBy("bucket").applyInArrow(tidy(_frequency), "chunk long, bucket long, classes binary")
    kinds = {
        "kind": pa.int32(), "chunk": pa.int64(), "row": pa.int32(), "doc_id": pa.int64(), "size": pa.int64(), "digest": pa.string(), "node": pa.int64(), "grams": pa.binary(), "first": pa.binary(), "mins": pa.list_(pa.int64()),
    }

    def look(texts: pa.Table, told: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if texts.num_rows:
            chunk = Chunk.of(texts)
            sets = Sets(chunk, n)
            answers = dict(zip(told.column("bucket").to_pylist(), told.column("classes").to_pylist()))
            rank = Asked(sets.grams, buckets, bits).classes(answers)
            name = texts.column("chunk")[0].as_py()
            for row, (doc, size, own) in enumerate(zip(chunk.doc_ids.tolist(), sets.sizes.tolist(), sets.of.tolist())):
                known = (sets.digests[own], _node(name, own)) if own >= 0 else (None, None)
                rows.append((0, name, row, doc, size, *known, None, None, None))
            shared = np.bincount(sets.set, rank > 1, len(sets.lengths))
            starts = np.cumsum(sets.lengths) - sets.lengths
            for own in np.flatnonzero(shared >= _need(sets.lengths, percent)).tolist():
                a, size = starts[own], int(sets.lengths[own])
                grams, order = sets.grams[a : a + size], rank[a : a + size]
                keep = order > 1
                # first n-grams: all those of the set's own come before, and cannot be common
                left = size - _need(size, percent) + 1 - int(np.count_nonzero(~keep))
                grams, order = grams[keep], order[keep]
                first = grams[np.lexsort((grams, order))[: max(left, 0)]]
                mins = [int((mix(grams + np.uint64(k * 0x51ED2701)).min() if len(grams) else np.uint64(0)).astype(np.int64)) for k in range(STARS)]
                rows.append((1, name, -1, None, size, sets.digests[own], _node(name, own), grams.tobytes(), first.tobytes(), mins))
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(kinds.items(), columns)})

    shape = "kind int, chunk long, row int, doc_id long, size long, digest string, node long, grams binary, first binary, mins array<long>"
    return checkpointed(chunks.groupBy("chunk").cogroup(classes.groupBy("chunk")).applyInArrow(tidy_pair(look), shape))


def _likeness(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b, both, size_a, size_b`` of pairs of nodes."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("size").alias(f"size_{x}"), F.col("grams").alias(f"grams_{x}")) for x in "ab")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [
                int(np.isin(_numbers(x), _numbers(y), assume_unique=True).sum())
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(both, pa.int64())], names=["a", "b", "size_a", "size_b", "both"])
        release()

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "size_a", "size_b", "grams_a", "grams_b")
    return joined.mapInArrow(count, "a long, b long, size_a long, size_b long, both long")


def _incidence(grams: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    """Documents by n-grams of ``names`` (rising), as 0 and 1."""
    out = np.zeros((len(grams), len(names)), np.float32)
    for row, own in enumerate(grams):
        out[row, np.searchsorted(names, own[np.isin(own, names, assume_unique=True)])] = 1
    return out


def _open(left: pa.Table, right: pa.Table, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks (or inside one), but for documents of one component.

    The query side's overlap with the union of the other's n-grams is the bound; only documents
    whose bound holds, on either side, are compared. Links found join components as they come, so
    at most one is reported for two components.
    """
    sides = []
    for table in (left, right):
        sides.append(
            (
                table.column("node").to_numpy(), table.column("component").to_numpy(), table.column("size").to_numpy(),
                [_numbers(x) for x in table.column("grams").to_pylist()],
            )
        )
    for k in (0, 1, 0):
        node, component, size, grams = sides[k]
        other = sides[1 - k][3]
        if not other or not grams:
            return []
        union = np.unique(np.concatenate(other))
        bound = np.array([np.isin(own, union, assume_unique=True).sum() for own in grams])
        on = np.flatnonzero(bound >= _need(size, percent))
        sides[k] = node[on], component[on], size[on], [grams[i] for i in on]
    (node, component, size, grams), (node_b, component_b, size_b, grams_b) = sides
    if not grams or not grams_b:
        return []
    names = np.intersect1d(np.concatenate(grams), np.concatenate(grams_b))
    found: list[tuple[int, int]] = []
    joined: dict[int, int] = {}

    def root(x: int) -> int:
        while joined.get(x, x) != x:
            x = joined[x]
        return x

    # n-grams in strips, so that the two matrices stay small
    both = np.zeros((len(grams), len(grams_b)), np.float32)
    for at in range(0, len(names), 1 << 15):
        strip = names[at : at + (1 << 15)]
        both += _incidence(grams, strip) @ _incidence(grams_b, strip).T
    hit = linked(both, size[:, None], size_b[None, :], percent) & (component[:, None] != component_b[None, :])
    for i, j in zip(*np.nonzero(hit)):
        x, y = root(int(component[i])), root(int(component_b[j]))
        if x != y:
            joined[max(x, y)] = min(x, y)
            found.append((int(node[i]), int(node_b[j])))
    return found


def _across(nodes: DataFrame, known: DataFrame, loose: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes of different components, by the token-group matrix."""
    at = lambda labels, name: labels.select(F.col("node").alias("node"), F.col("component").alias(name))
    placed = (
        nodes.join(at(known, "component"), "node", "left").join(at(loose, "looser"), "node", "left")
        .select("*", F.coalesce("component", "node").alias("c"), F.coalesce("looser", "node").alias("g"))
        .drop("component", "looser", "mins")
    )
    placed = checkpointed(placed.select("node", "size", "grams", "first", F.col("c").alias("component"), F.col("g").alias("looser")))
    large = placed.groupBy("component").count().filter(F.col("count") > LARGE).select("component", F.col("count").alias("n"))
    own = placed.join(large, "component", "left").withColumn("group", F.when(F.col("n").isNull(), F.concat(F.lit("g"), "looser")).otherwise(F.concat(F.lit("c"), "component")))
    own = checkpointed(own.drop("n", "looser"))
    sizes = own.groupBy("group").agg(F.count("*").alias("members"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    sizes = checkpointed(sizes.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int")))
    member = own.join(sizes.select("group", "blocks"), "group").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    member = checkpointed(member.select("group", "block", "node", "component", "size", "grams", "first"))

    def tokens(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [_numbers(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            row = pa.array(np.repeat(np.arange(len(first)), [len(x) for x in first]))
            flat = np.concatenate([np.zeros(0, np.uint64), *first]).astype(np.int64)
            columns = [column.take(row) for column in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(flat)], names=[*batch.schema.names[:-1], "token"])

    matrix = member.select("group", "first").mapInArrow(tokens, "group string, token long").distinct()
    # a row of the matrix at a time: the groups that hold an n-gram, where there are several
    held = matrix.groupBy("token").agg(F.array_sort(F.collect_list("group")).alias("groups")).filter(F.size("groups") > 1)
    left = held.select("groups", F.explode("groups").alias("ga"))
    pairs = left.select("ga", F.explode(F.filter("groups", lambda g: g > F.col("ga"))).alias("gb")).distinct()
    counts = [sizes.select(F.col("group").alias(f"g{x}"), F.col("blocks").alias(f"n{x}")) for x in "ab"]
    across = (
        pairs.join(counts[0], "ga").join(counts[1], "gb")
        .withColumn("ba", F.explode(F.sequence(F.lit(0), F.col("na") - 1)))
        .withColumn("bb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("ga", "ba", "gb", "bb")
    )
    # inside a group of several components: the same matrix with a column for each of its blocks
    mixed = member.join(sizes.filter("lo < hi").select("group"), "group", "left_semi").select("group", "block", "first")
    inner = mixed.mapInArrow(tokens, "group string, block int, token long").distinct()
    shared = inner.groupBy("group", "token").agg(F.array_sort(F.collect_list("block")).alias("blocks"))
    left = shared.select("group", "blocks", F.explode("blocks").alias("ba"))
    inside = left.select("group", "ba", F.explode(F.filter("blocks", lambda b: b >= F.col("ba"))).alias("bb")).distinct()
    inside = inside.select(F.col("group").alias("ga"), "ba", F.col("group").alias("gb"), "bb")
    opened = across.union(inside).select("*", F.concat_ws(":", "ga", "ba", "gb", "bb").alias("pair"))
    opened = checkpointed(opened)

    def side(x: str) -> DataFrame:
        """Documents of every pair's block, in columns of its own."""
        names = opened.select(F.col(f"g{x}").alias("group"), F.col(f"b{x}").alias("block"), F.col("pair").alias("pair"))
        rows = member.select(*(F.col(c).alias(c) for c in ("group", "block", "node", "component", "size", "grams")))
        return names.join(rows, ["group", "block"]).select("pair", "node", "component", "size", "grams")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        found = _open(a, b, percent)
        return pa.table({k: pa.array([pair[i] for pair in found], pa.int64()) for i, k in enumerate("ab")})

    return side("a").groupBy("pair").cogroup(side("b").groupBy("pair")).applyInArrow(tidy_pair(compare), "a long, b long")


def _joined(chunks: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """``chunk, row, doc_id, size, digest`` of every document, and ``digest, component, least_id`` of every set.

    A component is named by a node; ``least_id`` is the least id of the set's documents, null where none has one.
    """
    rows = _sets(chunks, n, percent)
    nodes = rows.filter("kind = 1").groupBy("digest").agg(
        F.min("node").alias("node"), *[F.first(c).alias(c) for c in ("size", "grams", "first", "mins")]
    )
    nodes = checkpointed(nodes)
    keyed = nodes.select("node", F.posexplode("mins").alias("k", "key"))
    stars = keyed.groupBy("k", "key").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    # a least hash that many nodes have is dealt to several tasks
    stars = stars.select("k", "key", "a", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    pairs = keyed.join(stars, ["k", "key", "salt"]).select("a", F.col("node").alias("b")).filter("a < b").distinct()
    alike = checkpointed(_likeness(pairs, nodes))
    sure = alike.filter(linked(F.col("both"), F.col("size_a"), F.col("size_b"), percent)).select("a", "b")
    known = components(sure)
    # the looser group: the least like node of one star, and that node's own
    near = alike.filter(linked(F.col("both"), F.col("size_a"), F.col("size_b"), LOOSE))
    near = checkpointed(near.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")))
    onward = near.select(F.col("node").alias("component"), F.col("component").alias("root"))
    loose = near.join(onward, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    more = checkpointed(_across(nodes, known, loose, percent))
    final = known if more.isEmpty() else components(sure.union(more))
    # documents come to their set's node, and with it to its component
    sets = rows.filter("kind = 0 and digest is not null").groupBy("digest").agg(
        F.min("node").alias("node"), F.min(F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))).alias("least_id")
    )
    named = sets.join(final, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "least_id")
    return rows.filter("kind = 0").select("chunk", "row", "doc_id", "size", "digest"), checkpointed(named)


def jaccard_components(
    docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    A component's id is the least document id that links reach, rows without an id aside; where
    no row has one it is null. A null text, or one without words, has no n-grams and is alone.
    Ids that are null or repeated join nothing by themselves. Repeated rows and equal sets are of
    one component. An empty table gives no rows. Other columns are not read.
    """
    with temporary_chunks(docs.sparkSession):  # what follows is read from checkpoints
        rows, sets = _joined(chunked(docs, id_col, text_col), n, percent)
    names = checkpointed(sets.groupBy("component").agg(F.min("least_id").alias("component_id")))
    # a large component's sets are dealt to several tasks
    names = names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = sets.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int"))
    told = checkpointed(salted.join(names, ["component", "salt"]).select("digest", "component_id"))
    own = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    return rows.join(told, "digest", "left").select(
        own.alias("doc_id"),
        F.col("size").alias("n_shingles"),
        F.when(F.col("digest").isNull(), own).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of least id in their component, one each, as they were.

    Of a component's rows with one id the first in its chunk stays, and a row without an id comes
    before all others; rows of different components stay whatever their ids. Documents without
    words all stay.
    """
    chunks = chunked(docs, id_col, text_col, whole=True)
    rows, sets = _joined(chunks, n, percent)
    rows = rows.join(sets.select("digest", "component"), "digest", "left")
    alone = rows.filter("digest is null").select("chunk", "row")
    first = rows.filter("digest is not null").groupBy("component").agg(F.min(F.struct("doc_id", "chunk", "row")).alias("f")).select("f.chunk", "f.row")
    arrow = to_arrow_schema(docs.schema)

    def keep(texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return arrow.empty_table()
        chunk, rows = Chunk.of(texts), np.sort(told.column("row").to_numpy())
        return whole_rows(texts, arrow, text_col, rows, [chunk.text(k).decode("utf-8", "surrogatepass") for k in rows.tolist()])

    return chunks.groupBy("chunk").cogroup(first.union(alone).groupBy("chunk")).applyInArrow(tidy_pair(keep), docs.schema)
