"""Canonical exact digests of texts, with byte comparison inside equal digests.

A text's canonical form is Unicode-normalised (NFKC), case-folded, and its white space folded to
single spaces. Its fingerprint is the 128-bit xxh3 digest of that form's UTF-8 bytes in hex.
Within equal digests the canonical bytes are compared; should two forms share a digest, each of
its fingerprints is extended by the form's own SHA-256, so equal fingerprints mean equal forms.
The digests that are shared so are a table, joined where it has any rows.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.llm.common import checkpointed, partitions, text_batches
from lumenary.llm.ranges import range_bounds, range_of

#: Parts that rows of one digest are dealt to where documents are marked.
SALTS = 16


def canonical(text: str) -> bytes:
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


#: From a canonical form to its name.
Digest = Callable[[bytes], str]


def digest(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def collisions(forms: DataFrame) -> DataFrame:
    """``digest`` of digests that stand for several canonical forms, from rows ``digest, form``.

    Rows of one digest lie next to each other in a sorted partition and each form is compared
    with the one before, so a digest of any number of rows takes the memory of two forms. Rows
    that repeat are no collision; no rows give none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            found = set()
            for name, form in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if last is not None and last[0] == name and last[1] != form:
                    found.add(name)
                last = (name, form)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["digest"])

    rows = forms.repartition(partitions(forms.sparkSession), "digest").sortWithinPartitions("digest")
    return rows.mapInArrow(run, "digest string").distinct()


def _told_apart(rows: DataFrame, shared: DataFrame, names: list[str]) -> DataFrame:
    """``rows`` with the digests ``names`` extended by ``<name>_sha`` where they are in ``shared``."""
    if shared.isEmpty():
        return rows
    for name in names:
        mine = shared.select(F.col("digest").alias(name), F.lit(True).alias("__shared"))
        longer = F.when(F.col("__shared"), F.concat_ws("-", name, f"{name}_sha")).otherwise(F.col(name))
        rows = rows.join(mine, name, "left").withColumn(name, longer).drop("__shared")
    return rows


def _digests(docs: DataFrame, digest: Digest) -> DataFrame:
    """``doc_id, digest`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            names = [digest(canonical(text)) for text in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names)], names=["doc_id", "digest"])

    return docs.mapInArrow(run, "doc_id long, digest string")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = digest) -> DataFrame:
    """``doc_id, fingerprint`` of every row.

    A null text counts as empty, and all empty or blank texts have one fingerprint; a null id
    stays null; repeated rows have equal fingerprints; an empty table gives no rows. Other columns
    are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def forms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=1)
        for _, texts in text_batches(batches, "text"):
            own = sorted({(digest(form), form) for form in map(canonical, texts)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in own]), pa.array([packer.compress(f) for _, f in own], pa.binary())], names=["digest", "form"]
            )

    shared = checkpointed(collisions(rows.mapInArrow(forms, "digest string, form binary")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_batches(batches, "text"):
            own = list(map(canonical, texts))
            names = [digest(form) for form in own], [hashlib.sha256(form).hexdigest() for form in own]
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, names)], names=["doc_id", "own", "own_sha"])

    named = _told_apart(rows.mapInArrow(run, "doc_id long, own string, own_sha string"), shared, ["own"])
    return named.select("doc_id", F.col("own").alias("fingerprint"))


def neighbours(
    docs: DataFrame,
    rows_of: Callable[[int | None, str, str], tuple],
    schema: str,
    marks: DataFrame | None = None,
    known: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``rows_of(id, text, next text, marked)`` for every row; next: in falling order of ids.

    The row of the least id is followed by that of the greatest. Rows go to ranges of their id;
    the first row of a range is also sent to the range before it, so one exchange of the texts
    is all. ``marks``: ids (``doc_id``) for which ``marked`` is true; ``known``: a table that has
    the rows' ids (``doc_id``) at hand. Repeated ids follow each other by text; nulls come last;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ids_only = (known if known is not None else rows).select("doc_id")
    bounds = range_bounds(ids_only, "doc_id", partitions(spark))
    # parts rise as ids fall
    part_of = lambda ids: len(bounds) - range_of(ids, bounds).astype(np.int64)

    def ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = part_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(where), batch.column(0)], names=["part", "doc_id"])

    # as many rows as ranges: what comes first in each
    tops = ids_only.mapInArrow(ranges, "part long, doc_id long").groupBy("part").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted((row["part"], row["top"]) for row in tops)
    ahead: dict[int | None, list[int]] = {}
    for k, (_, top) in enumerate(tops):
        ahead.setdefault(top, []).append(tops[k - 1][0])

    def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for part, texts in text_batches(batches, "text"):
            ids = part.column(0).to_pylist()
            where = part_of(part.column(0)).tolist()
            packed = [packer.compress(text.encode("utf-8", "surrogatepass")) for text in texts]
            out = [(w, 1, i, p) for w, i, p in zip(where, ids, packed)]
            out += [(w, 2, i, p) for i, p in zip(ids, packed) if i in ahead for w in ahead[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["part", "kind", "doc_id", "text"]
            )

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = part_of(batch.column(0))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(where), pa.array([0] * n, pa.int32()), batch.column(0), pa.nulls(n, pa.binary())], names=["part", "kind", "doc_id", "text"]
            )

    shape = "part long, kind int, doc_id long, text binary"
    sent = rows.mapInArrow(send, shape)
    if marks is not None:
        sent = sent.unionByName(marks.select("doc_id").mapInArrow(mark, shape))

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        out: list[tuple] = []
        now, marked, waiting = None, None, None
        size = 0
        for batch in batches:
            for part, kind, doc, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if part != now:
                    now, waiting, marked = part, None, None
                if kind == 0:
                    marked = (doc,)
                    continue
                text = unpacker.decompress(data).decode("utf-8", "surrogatepass")
                if waiting is not None:
                    out.append(rows_of(waiting[0], waiting[1], text, waiting[2]))
                    size += len(text)
                waiting = (doc, text, marked == (doc,)) if kind == 1 else None
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    # in a range: rows of its own, then (as ids fall) the next range's first; the last range's next is the first's
    order = [F.col("part"), (F.col("kind") == 2), F.col("doc_id").desc_nulls_last(), F.col("kind"), F.col("text")]
    return sent.repartitionById(partitions(spark), F.col("part").cast("int")).sortWithinPartitions(*order).mapInArrow(follow, schema)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as much of the beginning of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Digest = digest) -> DataFrame:
    """Each row's fingerprint beside that of its edited text and of the next row.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``; the likeness of two fingerprints is 1 where they are equal and else 0. Nulls,
    empty texts, repeated rows, ties and empty tables as in ``fingerprints`` and ``neighbours``.

    Texts are read twice and exchanged once. The canonical forms of documents whose digest is not
    their own alone come out of that exchange too, and are compared before the fingerprints are
    final; an edited text's form is compared with the others by its SHA-256.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = checkpointed(_digests(rows, digest))
    # a digest that many documents have is dealt to several tasks
    many = named.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    many = many.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = named.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    marks = salted.join(many, ["digest", "salt"], "left_semi").select("doc_id").distinct()
    whole = "doc_id long, n_chars long, edited_sha256 string, own string, edited string, next string, own_sha string, edited_sha string, next_sha string, form binary"

    def rows_of(doc, text: str, following: str, marked: bool) -> tuple:
        made = edited(text, following)
        forms = [canonical(x) for x in (text, made, following)]
        shas = [hashlib.sha256(form).hexdigest() for form in forms]
        own = zstandard.compress(forms[0], 3) if marked else None
        sha = hashlib.sha256(made.encode("utf-8", "surrogatepass")).hexdigest()
        return (doc, len(text), sha, *map(digest, forms), *shas, own)

    held = checkpointed(neighbours(rows, rows_of, whole, marks, named))
    by_bytes = collisions(held.filter("form is not null").select(F.col("own").alias("digest"), "form").distinct())
    pairs = [held.select(F.col(x).alias("digest"), F.col(f"{x}_sha").alias("sha")) for x in ("own", "edited")]
    by_sha = pairs[0].union(pairs[1]).groupBy("digest").agg(F.min("sha").alias("a"), F.max("sha").alias("b")).filter("a <> b")
    shared = checkpointed(by_bytes.union(by_sha.select("digest")).distinct())
    final = _told_apart(held.drop("form"), shared, ["own", "edited", "next"])
    own, made, following = (F.col(x) for x in ("own", "edited", "next"))
    return final.select(
        "doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), made.alias("edited_fingerprint"),
        (own == made).cast("double").alias("near_edited"), (own == following).cast("double").alias("near_next"),
    )
