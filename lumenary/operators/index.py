"""Stored search indexes with a manifest, and the guards that refuse stale ones.

A folder holds ``postings``, ``terms``, ``manifest`` and, for dense representations, ``vectors``.
The manifest names the corpus by fingerprint and number of documents and the index by its
settings, so an unchanged corpus is not indexed again and a changed one is never searched.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.functions import text, vectors
from lumenary.operators import clean, search

MANIFEST = "kind string, fingerprint string, documents long, settings string"


class StaleIndex(ValueError):
    """The index is of another corpus, or its tables do not fit together."""


def corpus_state(articles: DataFrame) -> tuple[str, int]:
    """Fingerprint and number of documents."""
    row = clean.block_fingerprint(articles.select("doc_id", "content_hash"), "doc_id").crossJoin(articles.agg(F.count("*").alias("n"))).first()
    return row["fingerprint"], row["n"]


def manifest(spark: SparkSession, folder: str) -> dict[str, dict]:
    """Entries by kind; none where there is no index."""
    try:
        rows = spark.read.schema(MANIFEST).json(f"{folder}/manifest").collect()
    except AnalysisException:
        return {}
    return {row["kind"]: row.asDict() for row in rows}


def _register(spark: SparkSession, folder: str, kind: str, state: tuple[str, int], settings: str) -> None:
    held = manifest(spark, folder) | {kind: {"kind": kind, "fingerprint": state[0], "documents": state[1], "settings": settings}}
    rows = [tuple(e[k] for k in ("kind", "fingerprint", "documents", "settings")) for e in held.values()]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def _current(entry: dict | None, state: tuple[str, int], settings: str) -> bool:
    return entry is not None and (entry["fingerprint"], entry["documents"], entry["settings"]) == (*state, settings)


def build_lexical(spark: SparkSession, articles: DataFrame, folder: str) -> bool:
    """Write postings and vocabulary; False where the stored ones are current."""
    if articles.limit(3).count() < 3 or articles.filter(F.size(text.terms("content")) > 0).limit(3).count() < 3:
        raise ValueError("an index needs three documents with words")
    state, settings = corpus_state(articles), f"min_df={search.MIN_DF} size={search.VOCABULARY}"
    if _current(manifest(spark, folder).get("lexical"), state, settings):
        return False
    tf = search.counts(articles, text.terms("content"))
    search.vocabulary(tf).write.mode("overwrite").parquet(f"{folder}/terms")
    terms = spark.read.parquet(f"{folder}/terms")
    weights = search.postings(articles, text.terms("content"), terms, state[1])
    # by term, so that a query's terms are found in few row groups; one in many documents goes to several ranges
    rows = weights.select("doc_id", "term", "weight", F.col("tf").cast("double").alias("count")).repartitionByRange("term", "doc_id").sortWithinPartitions("term")
    rows.write.mode("overwrite").parquet(f"{folder}/postings")
    _register(spark, folder, "lexical", state, settings)
    return True


def build_dense(spark: SparkSession, articles: DataFrame, embedded: DataFrame, folder: str, name: str) -> bool:
    """Write unit vectors (``doc_id, embedding``) of a representation."""
    state = corpus_state(articles)
    if _current(manifest(spark, folder).get(name), state, "unit"):
        return False
    check_vectors(articles, embedded)
    unit = embedded.select("doc_id", vectors.unit(vectors.doubles(F.col("embedding")), 1e-9).alias("embedding"))
    unit.write.mode("overwrite").parquet(f"{folder}/vectors-{name}")
    _register(spark, folder, name, state, "unit")
    return True


def check_vectors(articles: DataFrame, embedded: DataFrame) -> None:
    """Refuse vectors that are not one for each document, of one length and finite."""
    both = articles.select("doc_id", F.lit(1).alias("a")).join(embedded.select("doc_id", "embedding", F.lit(1).alias("e")), "doc_id", "full")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    row = both.agg(
        F.count_if(F.col("a").isNull() | F.col("e").isNull()).alias("apart"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"),
        F.count_distinct(F.size("embedding")).alias("sizes"), F.count_if(~F.coalesce(finite, F.lit(True))).alias("odd"),
    ).first()
    if row["apart"] or row["n"] != row["ids"]:
        raise StaleIndex("the vectors are not those of the documents")
    if row["sizes"] > 1 or row["odd"]:
        raise StaleIndex("the vectors are not finite or not of one length")


def open_index(spark: SparkSession, articles: DataFrame, folder: str, kind: str = "lexical") -> DataFrame:
    """Postings or vectors of a current index."""
    entry = manifest(spark, folder).get(kind)
    if entry is None:
        raise FileNotFoundError(f"there is no {kind} index; build it first")
    fingerprint, n = corpus_state(articles)
    if entry["documents"] != n:
        raise StaleIndex(f"the index has {entry['documents']} documents, the corpus {n}")
    if entry["fingerprint"] != fingerprint:
        raise StaleIndex("the index is of another corpus")
    return spark.read.parquet(f"{folder}/postings" if kind == "lexical" else f"{folder}/vectors-{kind}")


def search_index(spark: SparkSession, articles: DataFrame, folder: str, query: str, scheme: str = "tfidf", metric: str = "cosine", k: int = 10) -> DataFrame:
    """Ranked documents from a stored lexical index, with the documents' columns."""
    postings = open_index(spark, articles, folder)
    n = manifest(spark, folder)["lexical"]["documents"]
    weight = F.col("count") if scheme == "bow" else F.col("weight")
    asked = search.query_weights(spark, query, spark.read.parquet(f"{folder}/terms"), n, scheme)
    held = postings.select("doc_id", "term", weight.alias("weight"))
    if metric == "cosine":  # of unit vectors or with lengths from all terms; only shared terms add up
        lengths = postings.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("count") * F.col("count"))).alias("l")) if scheme == "bow" else None
        dots = held.join(F.broadcast(asked), "term").groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("q")).alias("score"))
        if lengths is not None:
            size = asked.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("lq"))
            dots = dots.join(lengths, "doc_id").join(F.broadcast(size)).select("doc_id", (F.col("score") / (F.col("l") * F.col("lq"))).alias("score"))
        scores = dots
    else:
        scores = search.lexical_scores(held, asked, metric)
    best = search.top(scores, k)
    return articles.join(F.broadcast(best), "doc_id").select(
        "position", "score", F.lit(scheme).alias("method"), F.lit(metric).alias("metric"), F.lit(query).alias("query"),
        "doc_id", *[c for c in ("title", "published_at", "category", "url", "content_hash") if c in articles.columns],
    )
