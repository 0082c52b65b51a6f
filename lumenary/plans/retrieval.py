"""Queries of postings, searches, fusions, digests and alerts."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary.functions import text, vectors
from lumenary.operators import digest, index, report, search
from lumenary.plans.corpus import ARTICLES, TERMS
from lumenary.session import scratch, table
from lumenary.sources.articles import from_documents

QUERY, QUERY_2, QUERY_3 = "the loser and the clown of leaux", "worthless idea of thing", "stupid trash in the eau"
#: What a title or category must hold in the digest, and the length of vectors.
NAMED, DIMENSIONS = ["src1", "th"], 64


def vocabulary_stats(spark: SparkSession, sf: str) -> DataFrame:
    return search.vocabulary_of(from_documents(spark, sf), text.terms("content"))


def _space(spark: SparkSession, sf: str) -> search.Space:
    """The corpus with its dense representations.

    The fixtures have no word model, so the k-th term of the vocabulary has the k-th vector of the
    embeddings table, over and over; documents have the vector of their own number, as far as the
    table goes, and a query's encoder gives the first vector.
    """
    docs, items = from_documents(spark, sf), table(spark, sf, "embeddings")
    v = vectors.doubles(F.col("embedding"))
    space = search.Space(docs)
    place = F.row_number().over(Window.orderBy(F.desc("cf"), "term")) - 1  # of VOCABULARY rows at most
    n = items.agg(F.count("*").alias("__n"))
    numbered = lambda: space.terms.select("term", place.alias("k")).join(n).select("term", (F.col("k") % F.col("__n")).alias("vec_id"))
    # the numbered terms go to every task, so that the stored vectors stay where they are
    space.term_vectors, space.size = lambda: F.broadcast(numbered()).join(items.select("vec_id", v.alias("v")), "vec_id").select("term", "v"), DIMENSIONS
    space.embeddings = items.select(F.col("vec_id").alias("doc_id"), v.alias("embedding"))
    space.encode = lambda query: items.orderBy("vec_id").first()["embedding"]
    return space


def _postings(spark: SparkSession, sf: str, scheme: str) -> DataFrame:
    docs = from_documents(spark, sf)
    terms = search.vocabulary_of(docs, text.terms("content"))
    if scheme == "bow":
        return search.bow(search.counts(docs, text.terms("content")), terms)
    return search.postings(docs, text.terms("content"), terms, docs.count()).select("doc_id", "term", "weight")


def bow_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _postings(spark, sf, "bow")


def tfidf_postings(spark: SparkSession, sf: str) -> DataFrame:
    return _postings(spark, sf, "tfidf").withColumn("weight", F.round("weight", 6))


def _search(method: str, metric: str, positive: bool = True):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _space(spark, sf).search(QUERY, method, metric, 10, positive)

    return run


def _dense(metric: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        items = table(spark, sf, "embeddings")
        query = items.orderBy("vec_id").limit(1).select(vectors.doubles(F.col("embedding")).alias("q"))
        return search.dense_search(items, query, metric)

    return run


def hybrid_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return _space(spark, sf).hybrid(QUERY)


def digest_select(spark: SparkSession, sf: str) -> DataFrame:
    """A week's unseen documents of named events, by fused ranks of words and word vectors."""
    space = _space(spark, sf)
    seen = space.docs.filter("doc_id % 11 = 0").select("url")
    window = digest.in_window(space.docs, datetime.date(2024, 1, 25), "weekly", seen).select("doc_id", "title", "category", "published_at")
    scores = [space.scores(QUERY_2, method, only=window).withColumn("score", F.round("score", 9)) for method in ("tfidf", "word2vec")]
    return digest.select(window, *scores, named=NAMED)


def comparison_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Best five by each of four methods and three metrics, side by side by position."""
    return _space(spark, sf).compared(QUERY)


def topk_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of the best 3 and 5 of three queries by two methods, from one ranking of five each."""
    space, lists = _space(spark, sf), None
    named = {(query, method, "cosine"): f"{name} {method}" for name, query in zip(("one", "two", "three"), (QUERY, QUERY_2, QUERY_3)) for method in ("tfidf", "word2vec")}
    for name, best in zip(named.values(), space.rankings(list(named), 5, positive=True)):
        best = best.withColumn("query", F.lit(name))
        lists = best if lists is None else lists.unionByName(best)
    return search.summaries(lists, space.docs)


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """A lexical index written to the shared folder, opened with its guards and searched."""
    docs, folder = from_documents(spark, sf), f"{scratch(spark)}/index-{uuid.uuid4().hex}"
    index.build_lexical(spark, docs, folder)
    return index.search_index(spark, docs, folder, QUERY, k=10).select("position", "doc_id", "score", "method", "metric", "category")


def catalog_check(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog without a category, and with other addresses in one language, against the articles."""
    docs = from_documents(spark, sf)
    url = F.when(F.col("lang") == "en", F.concat("url", F.lit("old/"))).otherwise(F.col("url"))
    return report.differing(docs.filter("category <> 'src3'").withColumn("url", url), docs)


def recent_list(spark: SparkSession, sf: str) -> DataFrame:
    return digest.recent(from_documents(spark, sf), "src5", page=0).select("doc_id", "published_at", "category")


def keyword_alerts_new(spark: SparkSession, sf: str) -> DataFrame:
    docs = from_documents(spark, sf)
    rules = spark.createDataFrame([("the",), ("SRC1",), ("eau",), ("nothing-like-it",)], "term string")
    seen = docs.filter("doc_id % 5 = 0").select(F.lit("the").alias("term"), "url")
    return digest.alerts(docs, rules, seen)


def search_index_export(spark: SparkSession, sf: str) -> DataFrame:
    """Published postings: private categories left out, idf and weights rounded, one row for each term."""
    docs = from_documents(spark, sf).filter(~F.coalesce("category", F.lit("")).isin("src3", "src7"))
    weights = search.postings(docs, text.terms("content"), search.vocabulary_of(docs, text.terms("content")), docs.count())
    return weights.groupBy("term").agg(
        F.round(F.max("idf"), 6).alias("idf"), F.count("*").alias("documents"),
        F.sum(F.round(F.col("weight") * 1_000_000).cast("long")).alias("millionths"), F.min("doc_id").alias("first_doc"),
    )


def snippet_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Snippets of every URL that the first category has."""
    docs = from_documents(spark, sf)
    return digest.snippets(docs, docs.filter("category = 'src1'").select("url"))


QUERIES = {
    f.__name__: f
    for f in (
        index_search, catalog_check, vocabulary_stats, bow_postings, tfidf_postings, hybrid_rrf, digest_select, comparison_matrix, topk_evaluation,
        recent_list, keyword_alerts_new, search_index_export, snippet_lookup,
    )
} | {
    "tfidf_search": _search("tfidf", "cosine"), "tfidf_search_euclid": _search("tfidf", "euclid"), "tfidf_search_manhattan": _search("tfidf", "manhattan"),
    "bow_search": _search("bow", "cosine"), "bow_search_euclid": _search("bow", "euclid"), "bow_search_manhattan": _search("bow", "manhattan"),
    "dense_search_cosine": _dense("cosine"), "dense_search_euclid": _dense("euclid"), "dense_search_manhattan": _dense("manhattan"),
} | {f"{m}_search_{metric}": _search(m, metric, positive=False) for m in ("word2vec", "bert") for metric in vectors.METRICS}

VOCABULARY = TERMS + """, stats AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY term),
vocab AS (SELECT * FROM stats WHERE df >= 2 ORDER BY cf DESC, term LIMIT 15000),
size AS (SELECT count(*) AS n FROM articles)"""
TFIDF = VOCABULARY + """, raw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS r FROM tf JOIN vocab USING (term), size),
lengths AS (SELECT doc_id, sqrt(sum(r * r)) AS l FROM raw GROUP BY doc_id),
tfidf AS (SELECT doc_id, term, r / l AS w FROM raw JOIN lengths USING (doc_id)),
bow AS (SELECT doc_id, term, CAST(tf AS DOUBLE) AS w FROM tf JOIN vocab USING (term)),
emb AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
wv AS (SELECT term, v FROM (SELECT term, (row_number() OVER (ORDER BY cf DESC, term) - 1) % (SELECT count(*) FROM emb) AS vec_id FROM vocab) JOIN emb USING (vec_id))"""
_MEAN = "[" + ", ".join(f"sum(n * v[{k + 1}]) / sum(n)" for k in range(DIMENSIONS)) + "]"
_ZERO = "[" + ", ".join(["CAST(0 AS DOUBLE)"] * DIMENSIONS) + "]"


def _query_sql(query: str, name: str) -> str:
    return f"""{name}_t AS (SELECT term, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower('{query}'), '\\p{{L}}+')) AS term) GROUP BY term),
{name}_r AS (SELECT term, c, c * (ln((1 + n) / (1 + df)) + 1) AS r FROM {name}_t JOIN vocab USING (term), size),
{name}_tfidf AS (SELECT term, r / (SELECT sqrt(sum(r * r)) FROM {name}_r) AS q FROM {name}_r),
{name}_bow AS (SELECT term, CAST(c AS DOUBLE) AS q FROM {name}_r),
{name}_v AS (SELECT {_MEAN.replace("n *", "c *").replace("sum(n)", "sum(c)")} AS q FROM {name}_t JOIN wv USING (term)),
{name}_word2vec AS (SELECT doc_id, coalesce(m, {_ZERO}) AS v, q FROM articles LEFT JOIN (SELECT doc_id, {_MEAN.replace("n *", "tf *").replace("sum(n)", "sum(tf)")} AS m FROM tf JOIN wv USING (term) GROUP BY doc_id) USING (doc_id), {name}_v),
{name}_bert AS (SELECT doc_id, v, (SELECT v FROM emb ORDER BY vec_id LIMIT 1) AS q FROM articles JOIN emb ON vec_id = doc_id)"""


_DENSE = {
    "cosine": "coalesce(list_dot_product(v, q) / nullif(sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(q, q)), 0), 0)",
    "euclid": "1 / (1 + list_distance(v, q))",
    "manhattan": "1 / (1 + list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - q[i]))))",
}


def _score_sql(scheme: str, metric: str, name: str = "q") -> str:
    """Scores by brute force over the document's and the query's terms, or their vectors."""
    q = f"{name}_{scheme}"
    if scheme in ("word2vec", "bert"):
        return f"SELECT doc_id, {_DENSE[metric]} AS score FROM {q}"
    each = {
        "cosine": f"sum(w * coalesce(q, 0)) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(q * q)) FROM {q}))",
        "euclid": f"1 / (1 + sqrt(greatest(0, sum((w - coalesce(q, 0)) ** 2) + (SELECT sum(q * q) FROM {q}) - coalesce(sum(q * q), 0))))",
        "manhattan": f"1 / (1 + sum(abs(w - coalesce(q, 0))) + (SELECT sum(q) FROM {q}) - coalesce(sum(q), 0))",
    }
    return f"SELECT doc_id, {each[metric]} AS score FROM {scheme} LEFT JOIN {q} USING (term) GROUP BY doc_id"


def _top_sql(scores: str, k: int, positive: bool = True, digits: int = 6) -> str:
    return f"""SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS position, doc_id, score FROM
(SELECT doc_id, round(score, {digits}) AS score FROM ({scores}) {"WHERE score > 0" if positive else ""}) ORDER BY score DESC, doc_id LIMIT {k}"""


def _search_sql(scheme: str, metric: str, positive: bool = True) -> str:
    return ARTICLES + f", {TFIDF}, {_query_sql(QUERY, 'q')} {_top_sql(_score_sql(scheme, metric), 10, positive)}"


def _dense_sql(metric: str) -> str:
    scores = f"""SELECT vec_id AS doc_id, {_DENSE[metric]} AS score FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"""
    return _top_sql(scores, 10, positive=False)


def _matrix_sql() -> str:
    parts = []
    for metric in vectors.METRICS:
        tops = {m: _top_sql(_score_sql(m, metric), 5, positive=False) for m in search.METHODS}
        named = ", ".join(f"{m}.doc_id AS {m}, {m}.score AS {m}_score" for m in tops)
        joined = " FULL JOIN ".join(f"({sql}) {m}" + (" USING (position)" if k else "") for k, (m, sql) in enumerate(tops.items()))
        parts.append(f"SELECT position, {named}, '{metric}' AS metric FROM {joined}")
    return ARTICLES + f", {TFIDF}, {_query_sql(QUERY, 'q')} " + " UNION ALL ".join(parts)


def _lists_sql() -> str:
    parts = []
    for name, q in (("one", "q"), ("two", "p"), ("three", "o")):
        parts += [f"SELECT '{name} {m}' AS query, * FROM ({_top_sql(_score_sql(m, 'cosine', q), 5)})" for m in ("tfidf", "word2vec")]
    return " UNION ALL ".join(parts)


ORACLE_SQL = {
    "index_search": ARTICLES + f""", {TFIDF}, {_query_sql(QUERY, 'q')} SELECT position, doc_id, score, 'tfidf' AS method, 'cosine' AS metric, category
FROM ({_top_sql(_score_sql("tfidf", "cosine"), 10)}) JOIN articles USING (doc_id)""",
    "catalog_check": """SELECT CAST(0 AS BIGINT) AS only_catalog, count(*) FILTER (source = 'src3') AS only_source, count(*) FILTER (source <> 'src3' AND lang = 'en') AS other_url,
CAST(0 AS BIGINT) AS other_content_hash FROM documents""",
    "vocabulary_stats": ARTICLES + f", {VOCABULARY} SELECT * FROM vocab",
    "bow_postings": ARTICLES + f", {TFIDF} SELECT doc_id, term, w AS weight FROM bow",
    "tfidf_postings": ARTICLES + f", {TFIDF} SELECT doc_id, term, round(w, 6) AS weight FROM tfidf",
    "tfidf_search": _search_sql("tfidf", "cosine"),
    "tfidf_search_euclid": _search_sql("tfidf", "euclid"),
    "tfidf_search_manhattan": _search_sql("tfidf", "manhattan"),
    "bow_search": _search_sql("bow", "cosine"),
    "bow_search_euclid": _search_sql("bow", "euclid"),
    "bow_search_manhattan": _search_sql("bow", "manhattan"),
    "dense_search_cosine": _dense_sql("cosine"),
    "dense_search_euclid": _dense_sql("euclid"),
    "dense_search_manhattan": _dense_sql("manhattan"),
    "hybrid_rrf": ARTICLES + f""", {TFIDF}, {_query_sql(QUERY, 'q')},
one AS ({_top_sql(_score_sql("tfidf", "cosine"), 100, digits=9)}),
two AS ({_top_sql(_score_sql("word2vec", "cosine"), 100, digits=9)}),
f AS (SELECT doc_id, sum(1.0 / (60 + position)) AS score FROM (SELECT position, doc_id FROM one UNION ALL SELECT position, doc_id FROM two) GROUP BY doc_id)
{_top_sql("SELECT * FROM f", 10, positive=False, digits=9)}""",
    "digest_select": ARTICLES + f""", {TFIDF}, {_query_sql(QUERY_2, 'q')},
l AS (SELECT doc_id, round(score, 9) AS l FROM ({_score_sql("tfidf", "cosine")})),
s AS (SELECT doc_id, round(score, 9) AS s FROM ({_score_sql("word2vec", "cosine")})),
c AS (SELECT doc_id, published_at, coalesce(l, 0) AS l, coalesce(s, 0) AS s FROM articles LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)
  WHERE published_at BETWEEN '2024-01-19' AND '2024-01-25' AND doc_id % 11 <> 0 AND (coalesce(l, 0) >= 0.04 OR coalesce(s, 0) >= 0.42)
  AND (contains(lower(title || ' ' || category), '{NAMED[0]}') OR contains(lower(title || ' ' || category), '{NAMED[1]}'))),
a AS (SELECT doc_id, row_number() OVER (ORDER BY l DESC, doc_id) AS p FROM c WHERE l > 0),
b AS (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id) AS p FROM c WHERE s > 0),
f AS (SELECT doc_id, round(sum(1.0 / (60 + p)), 9) AS score FROM (SELECT * FROM a WHERE p <= 100 UNION ALL SELECT * FROM b WHERE p <= 100) GROUP BY doc_id)
SELECT CAST(row_number() OVER (ORDER BY score DESC, published_at DESC, doc_id) AS INTEGER) AS position, doc_id, score FROM f JOIN c USING (doc_id)
ORDER BY score DESC, published_at DESC, doc_id LIMIT 8""",
    "comparison_matrix": _matrix_sql(),
    "topk_evaluation": ARTICLES + f""", {TFIDF}, {_query_sql(QUERY, 'q')}, {_query_sql(QUERY_2, 'p')}, {_query_sql(QUERY_3, 'o')},
b AS ({_lists_sql()}),
r AS (SELECT query, k, score, category, title, position FROM b JOIN articles USING (doc_id), (SELECT unnest([3, 5]) AS k) WHERE position <= k),
c AS (SELECT query, k, category, count(*) AS n FROM r GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY query, k ORDER BY n DESC, category) AS p FROM c),
h AS (SELECT query, k, string_agg(category || ': ' || n, '; ' ORDER BY category || ': ' || n) AS categories FROM c GROUP BY ALL),
w AS (SELECT query, k, round(avg(score), 6) AS mean_score, count(*) AS size, string_agg(title, ' | ' ORDER BY position) AS titles FROM r GROUP BY ALL)
SELECT w.query, w.k, mean_score, m.category AS dominant, round(n / size, 6) AS share, categories, titles
FROM w JOIN m ON w.query = m.query AND w.k = m.k AND m.p = 1 JOIN h ON w.query = h.query AND w.k = h.k""",
    "recent_list": ARTICLES + "SELECT doc_id, published_at, category FROM articles WHERE category = 'src5' ORDER BY published_at DESC, doc_id DESC LIMIT 20",
    "keyword_alerts_new": ARTICLES + """, m AS (SELECT term, doc_id, published_at FROM articles, (SELECT unnest(['the', 'SRC1', 'eau', 'nothing-like-it']) AS term)
  WHERE contains(lower(title || ' ' || category), lower(term)) AND NOT (term = 'the' AND doc_id % 5 = 0)),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY published_at DESC, doc_id DESC) AS k FROM m)
SELECT term, count(*) AS new, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY k) FILTER (k <= 3) AS latest FROM r GROUP BY term""",
    "search_index_export": ARTICLES.replace("FROM documents)", "FROM documents WHERE source NOT IN ('src3', 'src7'))") + f""", {TFIDF},
i AS (SELECT term, round(ln((1 + n) / (1 + df)) + 1, 6) AS idf FROM vocab, size)
SELECT term, any_value(idf) AS idf, count(*) AS documents, CAST(sum(CAST(round(w * 1000000) AS BIGINT)) AS BIGINT) AS millionths, min(doc_id) AS first_doc FROM tfidf JOIN i USING (term) GROUP BY term""",
    "snippet_lookup": ARTICLES + r"""SELECT url, coalesce(nullif(substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 1800), ''), title) AS snippet FROM articles WHERE category = 'src1'""",
} | {f"{m}_search_{metric}": _search_sql(m, metric, positive=False) for m in ("word2vec", "bert") for metric in vectors.METRICS}
