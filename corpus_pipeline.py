"""A corpus pipeline over ``documents``: screen, deduplicate, redact and pack.

Every stage works on all that the one before kept; between stages the rows are written as Parquet
to the folder that driver and executors share, and read again.

A table without rows gives none after every stage. Null ids, null and empty texts and repeated rows
pass all stages but the one that is named for them; columns of other names, whatever they are, stay
as they are until the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.llm.chunks import temporary_chunks
from lumenary.llm.common import remove, scratch, vocabulary
from lumenary.llm.ngram_join import one_of_each
from lumenary.llm.packing import pack
from lumenary.llm.queries import toxicity_chain
from lumenary.llm.secrets import redact
from lumenary.llm.suffix_dedup import without_repeats
from lumenary.llm.toxicity import screen
from lumenary.session import ship

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Bytes of a passage that is removed where an earlier document has it: below 51 short words.
PASSAGE_BYTES = 150


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_chars``, where there is one, counted anew."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half, by a chain fitted on the labelled ones.

    A null or empty text is judged as one without words; repeated rows go or stay together; labels
    that are null, or whose document is missing, are not used.
    """
    ship(spark)
    return screen(docs, toxicity_chain(spark, docs, sf_dir), "toxic")


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, likeness of 0.8 or more.

    The least id stays, a null one before all others; of rows that tie, the first in its chunk.
    Texts without words, null and empty ones among them, all stay.
    """
    ship(spark)
    return one_of_each(docs, n=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one, of smaller id, has.

    Rows of one id do not take from each other; a row without an id comes before all others. A
    document of which nothing visible is left goes; null and empty texts stay.
    """
    ship(spark)
    return _measured(without_repeats(docs, length=PASSAGE_BYTES))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a mark in place of every secret; all rows stay, null and empty texts as they are."""
    ship(spark)
    return _measured(redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows of the documents; a null or empty text is its end token alone.

    A null id stays null, repeated rows are documents of their own, and other columns end here.
    """
    ship(spark)
    return pack(docs, vocabulary("word_bpe_49k.json"), spaced=True, end_id=2)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("ngram_join", ngram_join),
    ("suffix_dedup", suffix_dedup),
    ("secrets", secrets),
    ("packing", packing),
]

#: No SQL expresses the fitted chain, the parse or the packing rule; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last one's rows, read from their files.

    What a stage wrote is removed when the next one is written, and so are its chunk tables.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES:
        with temporary_chunks(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
