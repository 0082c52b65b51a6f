"""Term postings and ranked retrieval: lexical, dense and hybrid."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary.functions import text, vectors
from lumenary.operators import row_scores
from lumenary.session import ship, written

MIN_DF, VOCABULARY = 2, 15_000
METHODS = ("bow", "tfidf", "word2vec", "bert")


def counts(docs: DataFrame, tokens: Column, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, term, tf`` of every row.

    A row's sorted tokens stand in runs of one term, so they are counted where they are and
    nothing is exchanged.
    """
    held = docs.select(F.col(id_col).alias("doc_id"), F.sort_array(tokens).alias("__t"))
    first = F.transform("__t", lambda term, at: F.when((at == 0) | (F.get("__t", at - 1) != term), at))
    held = held.withColumn("__f", F.filter(first, lambda at: at.isNotNull()))
    end = lambda k: F.coalesce(F.get("__f", k + 1), F.size("__t"))
    return held.select("doc_id", F.inline(F.transform("__f", lambda at, k: F.struct(F.get("__t", at).alias("term"), (end(k) - at).cast("long").alias("tf")))))


def vocabulary(tf: DataFrame, min_df: int = MIN_DF, size: int = VOCABULARY) -> DataFrame:
    """``term, df, cf`` of the most frequent terms that enough documents have; ties by term."""
    return _frequent(tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), min_df, size)


def vocabulary_of(docs: DataFrame, tokens: Column, min_df: int = MIN_DF, size: int = VOCABULARY) -> DataFrame:
    """``vocabulary`` of rows' tokens: a term comes once from every run of rows, not from every row."""
    ship(docs.sparkSession)
    found = docs.select("doc_id", tokens.alias("tokens")).mapInArrow(row_scores.counted, "term string, df long, cf long")
    return _frequent(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")), min_df, size)


def _frequent(stats: DataFrame, min_df: int, size: int) -> DataFrame:
    return stats.filter(F.col("df") >= min_df).orderBy(F.desc("cf"), "term").limit(size)


def bow(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """Raw counts of vocabulary terms. ``terms`` has VOCABULARY rows at most, so it is broadcast."""
    return tf.join(F.broadcast(terms.select("term")), "term").select("doc_id", "term", F.col("tf").cast("double").alias("weight"))


def tfidf(tf: DataFrame, terms: DataFrame, n_docs: int | Column) -> DataFrame:
    """Smoothed idf, weights not yet normalised: ``doc_id, term, idf, raw``."""
    idf = F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1
    weighted = terms.select("term", idf.alias("idf"))
    return tf.join(F.broadcast(weighted), "term").select("doc_id", "term", "idf", (F.col("tf") * F.col("idf")).alias("raw"))


def normalised(weights: DataFrame) -> DataFrame:
    """``doc_id, term, weight`` at length 1 for each document."""
    norms = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("doc_id")))
    return weights.select("doc_id", "term", (F.col("raw") / norms).alias("weight"))


def postings(docs: DataFrame, tokens: Column, terms: DataFrame, n_docs: int) -> DataFrame:
    """``doc_id, term, tf, idf, raw, weight``: TF-IDF at length 1, from each document's own row.

    ``terms`` (``term, df``) has VOCABULARY rows at most and goes to every task, so neither the
    terms' idf nor a document's length takes an exchange.
    """
    rows = terms.select("term", "df").collect()
    idf = np.log((1 + n_docs) / (1 + np.array([r["df"] for r in rows], float))) + 1
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(([r["term"] for r in rows], idf))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", tokens.alias("tokens")).mapInArrow(row_scores.postings(held), f"doc_id {kind}, term string, tf long, idf double, raw double, weight double")


def query_weights(spark: SparkSession, query: str, terms: DataFrame, n_docs: int, scheme: str) -> DataFrame:
    """``term, q``: the query in the same space; unknown terms are dropped."""
    if not query.strip():
        raise ValueError("the query is empty")
    asked = spark.range(1).select(F.explode(text.terms(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    known = terms.join(F.broadcast(asked), "term")
    if scheme == "bow":
        return known.select("term", F.col("tf").cast("double").alias("q"))
    raw = known.select("term", (F.col("tf") * (F.log((F.lit(1) + n_docs) / (F.lit(1) + F.col("df"))) + 1)).alias("raw"))
    return raw.select("term", (F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy()))).alias("q"))


def lexical_scores(postings: DataFrame, query: DataFrame, metric: str) -> DataFrame:
    """``doc_id, score`` from postings alone, of documents that have any vocabulary term.

    Distances need, beside the shared terms, only each document's and the query's own length:
    |q-d|^2 = |q|^2 + |d|^2 - 2qd, and sum|q-d| = sum|q| + sum|d| + what shared terms save.
    """
    q = F.broadcast(query)  # the query's terms
    length = query.agg(F.coalesce(F.sum(F.col("q") * F.col("q")), F.lit(0.0)).alias("qq"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("qs"))
    w, x = F.col("weight"), F.coalesce("q", F.lit(0.0))
    saved = F.when(F.col("q").isNotNull(), F.abs(x - w) - x - w).otherwise(0.0)
    sums = postings.join(q, "term", "left").groupBy("doc_id").agg(
        F.sum(w * x).alias("dot"), F.sum(w * w).alias("dd"), F.sum(w).alias("ds"), F.sum(saved).alias("saved")
    ).join(F.broadcast(length))
    score = {
        "cosine": F.coalesce(F.try_divide(F.col("dot"), F.sqrt("dd") * F.sqrt("qq")), F.lit(0.0)),
        "euclid": 1 / (1 + F.sqrt(F.greatest(F.col("qq") + F.col("dd") - 2 * F.col("dot"), F.lit(0.0)))),
        "manhattan": 1 / (1 + F.col("qs") + F.col("ds") + F.col("saved")),
    }
    return sums.select("doc_id", score[metric].alias("score"))


def top(scores: DataFrame, k: int, positive: bool = False, digits: int = 6) -> DataFrame:
    """``position, doc_id, score`` of the k best, ties by id; the k rows are numbered, no more."""
    if k < 1:
        raise ValueError("k must be at least 1")
    kept = scores.filter("score > 0") if positive else scores
    best = kept.withColumn("score", F.round("score", digits)).orderBy(F.desc("score"), "doc_id").limit(k)
    return best.select(F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("int").alias("position"), "doc_id", "score")


def pooled(docs: DataFrame, tokens: str, vectors_of: DataFrame, size: int) -> DataFrame:
    """Mean of the known tokens' vectors (``term, v``); a document without any has zeros.

    The model's vectors go to every task, so that a document's mean is worked out in its own row.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(row_scores.matrix(vectors_of, size))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", tokens).mapInArrow(row_scores.pooled(model, size), f"doc_id {kind}, embedding array<double>")


class Space:
    """A corpus (``doc_id, content``) in the representations that searches rank it by.

    ``term_vectors``: ``term, v`` of a word model, ``size`` numbers each, for "word2vec", or a
    function that gives them when they are first needed;
    ``embeddings``: ``doc_id, embedding`` and ``encode``, from a query to its vector, for "bert".
    """

    def __init__(
        self, docs: DataFrame, *, term_vectors: DataFrame | Callable[[], DataFrame] | None = None, size: int = 0,
        embeddings: DataFrame | None = None, encode: Callable[[str], list[float]] | None = None,
    ):
        self.docs, self.spark = docs, docs.sparkSession
        self.term_vectors, self.size, self.embeddings, self.encode = term_vectors, size, embeddings, encode

    @cached_property
    def tf(self) -> DataFrame:
        return counts(self.docs, text.terms("content"))

    @cached_property
    def terms(self) -> DataFrame:
        """The vocabulary, counted once; it has VOCABULARY rows at most."""
        found = vocabulary_of(self.docs, text.terms("content"))
        return self.spark.createDataFrame(found.collect(), found.schema)

    @cached_property
    def n(self) -> int:
        return self.docs.count()

    @cached_property
    def model(self) -> DataFrame:
        if self.term_vectors is None:
            raise FileNotFoundError("there are no word vectors; train them first")
        return self.term_vectors() if callable(self.term_vectors) else self.term_vectors

    @cached_property
    def _matrix(self) -> row_scores.Matrix:
        return row_scores.matrix(self.model, self.size)

    def _among(self, only: DataFrame | None) -> DataFrame:
        return self.docs if only is None else self.docs.join(only.select("doc_id"), "doc_id", "left_semi")

    def scored(self, asked: list[tuple[str, str, str]], only: DataFrame | None = None) -> DataFrame:
        """``doc_id, s0, s1 ...``: scores by each (query, method, metric), all from one reading of the corpus.

        A score is null where the method does not list the document.
        """
        for query, method, metric in asked:
            if not query.strip():
                raise ValueError("the query is empty")
            if method not in METHODS or metric not in vectors.METRICS:
                raise ValueError(f"methods are {', '.join(METHODS)}; metrics are {', '.join(vectors.METRICS)}")
        among = self._among(only)
        inside = {k: x for k, x in enumerate(asked) if x[1] != "bert"}
        outside = {k: x for k, x in enumerate(asked) if x[1] == "bert"}
        out = None
        if inside:
            words, place, idf, known = [], {}, np.zeros(0), None
            if any(method in ("bow", "tfidf") for _, method, _ in inside.values()):
                rows = self.terms.collect()
                words = [r["term"] for r in rows]
                place = {t: k for k, t in enumerate(words)}
                idf = np.log((1 + self.n) / (1 + np.array([r["df"] for r in rows], float))) + 1
            if any(method == "word2vec" for _, method, _ in inside.values()):
                known = self._matrix
            queries = []
            for query, method, metric in inside.values():
                if method == "word2vec":
                    tokens = pa.array(self.spark.range(1).select(text.terms(F.lit(query)).alias("t")).first()["t"], pa.string())
                    at = row_scores.places(tokens, pa.array(known.terms, pa.string()))
                    asked_for = row_scores.means(np.zeros(len(at), int), at, 1, known.vectors)[0].tolist()
                else:
                    asked_for = {place[r["term"]]: r["q"] for r in query_weights(self.spark, query, self.terms, self.n, method).collect()}
                queries.append((method, metric, asked_for))
            ship(self.spark)
            model = self.spark.sparkContext.broadcast((words, idf, known))
            names = [f"s{k}" for k in range(len(queries))]
            shape = ", ".join([f"doc_id {dict(among.dtypes)['doc_id']}", *(f"{n} double" for n in names)])
            out = among.select("doc_id", text.terms("content").alias("tokens")).mapInArrow(row_scores.scored(model, queries), shape)
            out = out.select("doc_id", *[F.col(n).alias(f"s{k}") for n, k in zip(names, inside)])
        if outside:
            if self.embeddings is None or self.encode is None:
                raise FileNotFoundError("there are no embeddings; encode the documents first")
            items = among.select("doc_id").join(self.embeddings, "doc_id")
            vector = {query: F.array(*map(F.lit, map(float, self.encode(query)))) for query in {x[0] for x in outside.values()}}
            v = vectors.doubles(F.col("embedding"))
            dense = items.select("doc_id", *[vectors.relevance(v, vector[query], metric).alias(f"s{k}") for k, (query, _, metric) in outside.items()])
            out = dense if out is None else out.join(dense, "doc_id", "full")
        return out.select("doc_id", *[f"s{k}" for k in range(len(asked))])

    def scores(self, query: str, method: str = "tfidf", metric: str = "cosine", only: DataFrame | None = None) -> DataFrame:
        """``doc_id, score`` of all documents, or of those in ``only``; statistics are the corpus'."""
        return self.scored([(query, method, metric)], only).select("doc_id", F.col("s0").alias("score")).filter("score is not null")

    def rankings(self, asked: list[tuple[str, str, str]], k: int, positive: bool = False, digits: int = 6) -> list[DataFrame]:
        """``position, doc_id, score`` of the k best by each (query, method, metric).

        Scores by tokens, and scores by stored vectors, are each worked out once and written.
        """
        out = {}
        for stored in (False, True):
            part = [x for x in asked if (x[1] == "bert") == stored]
            if part:
                held = written(self.scored(part)) if len(part) > 1 else self.scored(part)
                for at, x in enumerate(part):
                    out[x] = top(held.select("doc_id", F.col(f"s{at}").alias("score")).filter("score is not null"), k, positive, digits)
        return [out[x] for x in asked]

    def search(self, query: str, method: str = "tfidf", metric: str = "cosine", k: int = 10, positive: bool = False) -> DataFrame:
        """``position, doc_id, score`` of the k best; scores of zero count unless ``positive``."""
        if k < 1:
            raise ValueError("k must be at least 1")
        return top(self.scores(query, method, metric), k, positive)

    def hybrid(self, query: str, k: int = 10, depth: int = 100) -> DataFrame:
        """Fused ranks of TF-IDF and word vectors, both by cosine, where they are above zero."""
        ranks = self.rankings([(query, method, "cosine") for method in ("tfidf", "word2vec")], depth, positive=True, digits=9)
        return top(fuse(ranks, depth), k, digits=9)

    def compared(self, query: str, k: int = 5, methods: tuple[str, ...] = METHODS) -> DataFrame:
        """The k best by every method side by side, a row for each position and metric."""
        if k < 1:
            raise ValueError("k must be at least 1")
        pairs = [(query, method, metric) for metric in vectors.METRICS for method in methods]
        found, out = dict(zip(pairs, self.rankings(pairs, k))), None
        for metric in vectors.METRICS:
            row = None
            for method in methods:
                best = found[query, method, metric].select("position", F.col("doc_id").alias(method), F.col("score").alias(f"{method}_score"))
                row = best if row is None else row.join(best, "position", "full")
            row = row.withColumn("metric", F.lit(metric))
            out = row if out is None else out.unionByName(row)
        return out


def search(spark: SparkSession, docs: DataFrame, query: str, method: str = "tfidf", metric: str = "cosine", k: int = 10, positive: bool = True, **space) -> DataFrame:
    """Ranked documents for a query; ``space``: what ``Space`` needs for dense methods."""
    return Space(docs, **space).search(query, method, metric, k, positive)


def summaries(lists: DataFrame, docs: DataFrame, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """For each ``query`` and k of rankings (``query, position, doc_id, score``): mean score, dominant
    category with its share, categories by number and titles by position.

    ``docs``: ``doc_id, category, title``. Ties go to the lower category.
    """
    rows = lists.join(docs.select("doc_id", "category", "title"), "doc_id").withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("position <= k")
    counted = rows.groupBy("query", "k", "category").agg(F.count("*").alias("n"))
    whole = rows.groupBy("query", "k").agg(
        F.round(F.avg("score"), 6).alias("mean_score"), F.count("*").alias("size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "title"))), lambda x: x["title"]), " | ").alias("titles"),
    )
    listed = F.concat_ws(": ", "category", F.col("n").cast("string"))
    named = counted.groupBy("query", "k").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("category").alias("c"))))[0].alias("first"),
        F.array_join(F.array_sort(F.collect_list(listed)), "; ").alias("categories"),
    )
    return whole.join(named, ["query", "k"]).select(
        "query", "k", "mean_score", F.col("first.c").alias("dominant"), F.round(-F.col("first.n") / F.col("size"), 6).alias("share"), "categories", "titles"
    )


def dense_scores(items: DataFrame, query: DataFrame, metric: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, score`` of vectors (``embedding``) for one query vector (``query``: one row, ``q``)."""
    return items.join(F.broadcast(query)).select(
        F.col(id_col).alias("doc_id"), vectors.relevance(vectors.doubles(F.col("embedding")), F.col("q"), metric).alias("score")
    )


def dense_search(items: DataFrame, query: DataFrame, metric: str, k: int = 10, id_col: str = "vec_id") -> DataFrame:
    """Vectors nearest to one query vector."""
    return top(dense_scores(items, query, metric, id_col), k)


def fuse(rankings: list[DataFrame], depth: int = 100, constant: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ``position, doc_id`` lists: ``doc_id, score``."""
    parts = [r.filter(F.col("position") <= depth).select("doc_id", (1.0 / (constant + F.col("position"))).alias("part")) for r in rankings]
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    return all_parts.groupBy("doc_id").agg(F.sum("part").alias("score"))
