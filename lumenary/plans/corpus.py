"""Queries on article tables: profiles, deduplication, upserts, dates, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.functions import dates, text, urls
from lumenary.operators import clean, search, sentiment
from lumenary.session import table
from lumenary.sources.articles import from_documents

#: DuckDB's form of the article adapter; later queries begin with it.
FOLD = "trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
ARTICLES = rf"""
WITH articles AS (
  SELECT doc_id, substr(text, 1, 80) AS title, text AS content, source AS category, lang,
         strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d') AS published_at,
         'https://news.example/' || doc_id || '/' AS url,
         sha256({FOLD.format(x="substr(text, 1, 80) || ' ' || text")}) AS content_hash,
         CAST(CASE WHEN trim(regexp_replace(text, '\s+', ' ', 'g')) = '' THEN 0
              ELSE len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) END AS INTEGER) AS word_count
  FROM documents)
"""


def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return clean.profile(from_documents(spark, sf))


def category_counts(spark: SparkSession, sf: str) -> DataFrame:
    a = from_documents(spark, sf)
    return clean.counts_by(a, text.primary_category(F.concat_ws(", ", "category", "lang")), "category")


def missing_field_counts(spark: SparkSession, sf: str) -> DataFrame:
    joined = from_documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    names = ("title", "category", "quality", "toxic")
    return joined.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(f"missing_{c}") for c in names])


def dedup_keep_first(spark: SparkSession, sf: str) -> DataFrame:
    return clean.keep_first(from_documents(spark, sf), "doc_id").select("doc_id", "content_hash", "word_count")


def removal_causes(spark: SparkSession, sf: str) -> DataFrame:
    return clean.removal_causes(from_documents(spark, sf))


def public_articles(spark: SparkSession, sf: str) -> DataFrame:
    return clean.public_count(from_documents(spark, sf), ["src3", "src7"])


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two versions of the whole corpus by keys that several documents, and in part both versions, share."""
    a = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    keyed = lambda n: a.select("doc_id", F.concat("source", F.lit("-"), F.col("doc_id") % n).alias("key"), "lang", "n_chars")
    return keyed(97), keyed(101)


def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return clean.upsert(*_versions(spark, sf), "key", "doc_id")


def new_and_updated_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.new_and_updated(*_versions(spark, sf), "key")


def dataset_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return clean.fingerprint(from_documents(spark, sf).select("doc_id", "content_hash"), "doc_id")


def dataset_block_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return clean.block_fingerprint(from_documents(spark, sf).select("doc_id", "content_hash"), "doc_id")


def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return from_documents(spark, sf).select("doc_id", "content_hash", "word_count")


def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    tf = search.counts(from_documents(spark, sf), text.terms("content"))
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def top_terms_per_category(spark: SparkSession, sf: str) -> DataFrame:
    rows = from_documents(spark, sf).select("doc_id", "category", F.posexplode(text.terms("content")).alias("pos", "term"))
    # the first place of a term: documents by id, then the place in the document
    return sentiment.top_listing(rows.select("category", "term", F.struct("doc_id", "pos").alias("at")), "category", "term", 10, "terms")


def temporal_split(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    marked = clean.periods(events, F.col("ts").cast("timestamp"))
    return marked.groupBy("period").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


def period_summary(spark: SparkSession, sf: str) -> DataFrame:
    a = clean.periods(from_documents(spark, sf), F.col("published_at").cast("timestamp"))
    whole = a.groupBy("period").agg(
        F.min("published_at").alias("first_day"), F.max("published_at").alias("last_day"), F.count("*").alias("n"), F.round(F.avg("word_count"), 2).alias("mean_words")
    )
    top = sentiment.top_listing(a.select("period", "category", F.col("doc_id").alias("at")), "period", "category", 5, "categories")
    rows = a.select("period", "doc_id", F.posexplode(text.terms("content")).alias("pos", "term"))
    terms = sentiment.top_listing(rows.select("period", "term", F.struct("doc_id", "pos").alias("at")), "period", "term", 10, "terms")
    return whole.join(top, "period").join(terms, "period")


def date_functions(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("published_at")
    return from_documents(spark, sf).select(
        "doc_id", dates.local_day(day).alias("day"), dates.display(dates.local_day(day)).alias("shown"), dates.window_start(dates.local_day(day), 7).alias("week_start")
    )


def interval_count(spark: SparkSession, sf: str) -> DataFrame:
    later = dates.local_day(F.col("published_at")) > F.lit("2024-01-20").cast("date")
    return from_documents(spark, sf).agg(F.count_if(later).alias("later"), F.min("published_at").alias("first_day"), F.max("published_at").alias("last_day"))


def url_predicate(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    url = F.col("url")
    own = pages.orderBy("page_id").limit(1).select(urls.host(url).alias("own"))  # the site that is collected
    return pages.join(F.broadcast(own)).select("page_id", "url", urls.is_article(url, F.col("own"), ["about", "contact"]).alias("article"))


def url_canonical(spark: SparkSession, sf: str) -> DataFrame:
    url = F.concat("url", F.lit("//#part"))
    return table(spark, sf, "pages").select("page_id", urls.canonical(url).alias("canonical"), urls.host(url).alias("host"))


def crawl_plan(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as listing pages of 50, latest day of each falling with the page."""
    docs = table(spark, sf, "documents")
    pages = docs.groupBy(F.floor(F.col("doc_id") / 50).alias("page")).agg(F.max("n_chars").alias("chars"), F.max("doc_id").alias("signature"))
    dated = pages.withColumn("last_day", F.date_sub(F.lit("2024-03-01").cast("date"), (F.col("page") * 7 + F.col("chars") % 5).cast("int")))
    return clean.crawl_plan(dated, F.lit("2024-01-10").cast("date")).select(F.col("page").cast("long").alias("page"), "old", "complete")


QUERIES = {
    f.__name__: f
    for f in (
        corpus_profile, category_counts, missing_field_counts, dedup_keep_first, removal_causes, public_articles, upsert_by_key,
        new_and_updated_counts, dataset_fingerprint, dataset_block_fingerprint, content_hash, token_counts, top_terms_per_category,
        temporal_split, period_summary, date_functions, interval_count, url_predicate, url_canonical, crawl_plan,
    )
}

VERSIONS = """WITH v AS (
  SELECT 0 AS side, doc_id, source || '-' || (doc_id % 97) AS key, lang, n_chars FROM documents
  UNION ALL SELECT 1, doc_id, source || '-' || (doc_id % 101), lang, n_chars FROM documents)"""
TERMS = r"""t AS (SELECT doc_id, category, unnest(regexp_extract_all(lower(content), '\p{L}+')) AS term FROM articles),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)"""

ORACLE_SQL = {
    "corpus_profile": ARTICLES + """SELECT count(*) AS total, count(DISTINCT url) AS distinct_urls, count(*) - count(DISTINCT url) AS duplicate_urls,
  count(*) - count(DISTINCT content_hash) AS duplicate_hashes, count(*) FILTER (word_count < 20) AS short,
  count(*) FILTER (coalesce(title, '') = '') AS missing_title, count(*) FILTER (coalesce(published_at, '') = '') AS missing_published_at,
  count(*) FILTER (coalesce(category, '') = '') AS missing_category, count(*) FILTER (coalesce(content, '') = '') AS missing_content,
  count(*) FILTER (coalesce(url, '') = '') AS missing_url, min(published_at) AS first_day, max(published_at) AS last_day,
  min(word_count) AS min_words, max(word_count) AS max_words, round(avg(word_count), 2) AS mean_words, median(word_count) AS median_words FROM articles""",
    "category_counts": "SELECT coalesce(nullif(trim(string_split(source || ', ' || lang, ',')[1]), ''), 'Sem categoria') AS category, count(*) AS n FROM documents GROUP BY 1",
    "missing_field_counts": """SELECT count(*) AS total, count(*) FILTER (coalesce(substr(text, 1, 80), '') = '') AS missing_title,
  count(*) FILTER (coalesce(source, '') = '') AS missing_category, count(*) FILTER (quality IS NULL) AS missing_quality,
  count(*) FILTER (toxic IS NULL) AS missing_toxic FROM documents LEFT JOIN labels USING (doc_id)""",
    "dedup_keep_first": ARTICLES + "SELECT min(doc_id) AS doc_id, content_hash, arg_min(word_count, doc_id) AS word_count FROM articles WHERE word_count >= 20 GROUP BY content_hash",
    "removal_causes": ARTICLES + """SELECT count(*) AS total, count(*) FILTER (word_count < 20) AS short,
  count(*) FILTER (word_count >= 20) - count(DISTINCT content_hash) FILTER (word_count >= 20) AS duplicate,
  count(DISTINCT content_hash) FILTER (word_count >= 20) AS kept FROM articles""",
    "public_articles": ARTICLES + """SELECT count(*) AS public FROM (SELECT arg_min(category, doc_id) AS c FROM articles WHERE word_count >= 20 GROUP BY content_hash)
  WHERE c NOT IN ('src3', 'src7')""",
    "upsert_by_key": VERSIONS + """, last AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY side DESC, doc_id DESC) AS k FROM v),
first AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY side, doc_id) AS k FROM v)
SELECT l.key, l.lang, l.n_chars, f.side AS first_side, f.doc_id AS first_at FROM last l JOIN first f USING (key) WHERE l.k = 1 AND f.k = 1""",
    "new_and_updated_counts": VERSIONS + """, k AS (SELECT key, bool_or(side = 0) AS old, bool_or(side = 1) AS new FROM v GROUP BY key)
SELECT count(*) FILTER (new AND NOT old) AS new, count(*) FILTER (new AND old) AS updated FROM k""",
    "dataset_fingerprint": ARTICLES + "SELECT sha256(string_agg(content_hash, chr(10) ORDER BY doc_id)) AS fingerprint FROM articles",
    "dataset_block_fingerprint": ARTICLES + """, a AS (SELECT doc_id // 1000 AS o, sha256(string_agg(content_hash, chr(10) ORDER BY doc_id)) AS v FROM articles GROUP BY 1),
b AS (SELECT o // 1000 AS o, sha256(string_agg(v, chr(10) ORDER BY o)) AS v FROM a GROUP BY 1),
c AS (SELECT o // 1000 AS o, sha256(string_agg(v, chr(10) ORDER BY o)) AS v FROM b GROUP BY 1)
SELECT sha256(string_agg(v, chr(10) ORDER BY o)) AS fingerprint FROM c""",
    "content_hash": ARTICLES + "SELECT doc_id, content_hash, word_count FROM articles",
    "token_counts": ARTICLES + f", {TERMS} SELECT term, CAST(sum(tf) AS BIGINT) AS cf, count(*) AS df FROM tf GROUP BY term",
    "top_terms_per_category": ARTICLES + r""", w AS (SELECT doc_id, category, regexp_extract_all(lower(content), '\p{L}+') AS l FROM articles),
t AS (SELECT category, (doc_id, pos) AS place, l[pos + 1] AS term FROM (SELECT *, unnest(range(len(l))) AS pos FROM w)),
c AS (SELECT category, term, count(*) AS n, min(place) AS first FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n DESC, first, term) AS k FROM c)
SELECT category, string_agg(term || ': ' || n, '; ' ORDER BY k) AS terms FROM r WHERE k <= 10 GROUP BY category""",
    "temporal_split": """WITH m AS (SELECT CAST(max(ts) AS DATE) - 6 AS cut FROM events)
SELECT CASE WHEN CAST(ts AS DATE) >= cut THEN 'recent' ELSE 'previous' END AS period, count(*) AS n, round(avg(value), 6) AS mean_value FROM events, m GROUP BY 1""",
    "period_summary": ARTICLES + """, m AS (SELECT CAST(max(published_at) AS DATE) - 6 AS cut FROM articles),
a AS (SELECT *, CASE WHEN CAST(published_at AS DATE) >= cut THEN 'recent' ELSE 'previous' END AS period FROM articles, m),
c AS (SELECT period, category, count(*) AS n, min(doc_id) AS first FROM a GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, first, category) AS k FROM c),
g AS (SELECT period, string_agg(category || ': ' || n, '; ' ORDER BY k) AS categories FROM r WHERE k <= 5 GROUP BY period),
tw AS (SELECT period, doc_id, regexp_extract_all(lower(content), '\\p{L}+') AS l FROM a),
tt AS (SELECT period, (doc_id, pos) AS place, l[pos + 1] AS term FROM (SELECT *, unnest(range(len(l))) AS pos FROM tw)),
tc AS (SELECT period, term, count(*) AS n, min(place) AS first FROM tt GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY n DESC, first, term) AS k FROM tc),
tg AS (SELECT period, string_agg(term || ': ' || n, '; ' ORDER BY k) AS terms FROM tr WHERE k <= 10 GROUP BY period)
SELECT period, min(published_at) AS first_day, max(published_at) AS last_day, count(*) AS n, round(avg(word_count), 2) AS mean_words, any_value(categories) AS categories, any_value(terms) AS terms
FROM a JOIN g USING (period) JOIN tg USING (period) GROUP BY period""",
    "date_functions": ARTICLES + """SELECT doc_id, CAST(published_at AS DATE) AS day, strftime(CAST(published_at AS DATE), '%d/%m/%Y') AS shown,
  CAST(CAST(published_at AS DATE) - 6 AS DATE) AS week_start FROM articles""",
    "interval_count": ARTICLES + "SELECT count(*) FILTER (published_at > '2024-01-20') AS later, min(published_at) AS first_day, max(published_at) AS last_day FROM articles",
    "url_predicate": r"""WITH h AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages),
o AS (SELECT host AS own FROM h ORDER BY page_id LIMIT 1), p AS (SELECT page_id, url, host = own AS same, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '^/+|/+$', '', 'g') AS p FROM pages JOIN h USING (page_id), o)
SELECT page_id, url, same AND p NOT IN ('about', 'contact') AND p <> '' AND NOT contains(p, '/') AND NOT regexp_matches(p, '^(category|tag|author|page|wp-)')
  AND NOT regexp_matches(lower(p), '\.(jpg|jpeg|png|gif|webp|svg|pdf|mp4|mp3|zip)$') AS article FROM p""",
    "url_canonical": r"""SELECT page_id, rtrim(string_split(url || '//#part', '#')[1], '/') || '/' AS canonical,
  regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages""",
    "crawl_plan": """WITH p AS (SELECT doc_id // 50 AS page, max(n_chars) AS chars, max(doc_id) AS signature FROM documents GROUP BY 1),
d AS (SELECT page, signature, (DATE '2024-03-01' - CAST(page * 7 + chars % 5 AS INTEGER)) <= DATE '2024-01-10' AS old FROM p),
r AS (SELECT *, old AND coalesce(lag(old) OVER (ORDER BY page), false) AS ends FROM d)
SELECT page, old, ends AS complete FROM r WHERE page <= coalesce((SELECT min(page) FROM r WHERE ends), (SELECT max(page) FROM r))""",
}
