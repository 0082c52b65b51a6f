"""Queries of clusterings, sentiment, classification, extraction and learned models."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.functions import text, vectors
from lumenary.operators import classify, cluster, extract, parse_rows, represent, search, sentiment
from lumenary.plans.corpus import ARTICLES
from lumenary.plans import retrieval
from lumenary.plans.retrieval import TFIDF
from lumenary.session import table, written
from lumenary.sources import html
from lumenary.sources.articles import from_documents
from lumenary.streaming.upsert import daily_counts

DIMENSIONS = 64


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with their label as cluster and a derived category."""
    return table(spark, sf, "embeddings").withColumn("category", F.concat(F.lit("c"), (F.col("vec_id") * 7 + F.col("label")) % 5))


def cluster_category_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.crosstab(_labelled(spark, sf), "category", "label", list(range(10)))


def cluster_majority(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.majority(_labelled(spark, sf), "label", "category")


def cluster_purity(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.purity(cluster_majority(spark, sf))


def cluster_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.confusion(_labelled(spark, sf), cluster_majority(spark, sf), "label", "category")


def cluster_cohesion(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.cohesion(_labelled(spark, sf), "label", "embedding", DIMENSIONS)


def centroid_distances(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.centroid_distances(_labelled(spark, sf), "label", "embedding", DIMENSIONS)


def centroid_distance_summary(spark: SparkSession, sf: str) -> DataFrame:
    return centroid_distances(spark, sf).agg(F.round(F.avg("distance"), 5).alias("mean_distance"), F.min("distance").alias("min_distance"))


def silhouette_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.silhouette(_labelled(spark, sf), "label", "embedding", DIMENSIONS)


def cluster_top_terms(spark: SparkSession, sf: str) -> DataFrame:
    docs = from_documents(spark, sf)
    weights = search.postings(docs, text.terms("content"), search.vocabulary_of(docs, text.terms("content")), docs.count())
    sizes = docs.groupBy("category").agg(F.count("*").alias("n"))
    return cluster.top_terms(weights, docs.select("doc_id", "category"), "category", sizes)


def block_mean_pooling(spark: SparkSession, sf: str) -> DataFrame:
    pooled = represent.block_means(_labelled(spark, sf), "label", "embedding", DIMENSIONS)
    return pooled.select("label", "blocks", F.posexplode("mean").alias("dimension", "mean"))


def similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cluster.similar_pairs(table(spark, sf, "embeddings"), "embedding", "vec_id", 0.35)
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


LEXICON = sentiment.Lexicon(
    words={
        "idiot": -1.2, "trash": -1.0, "stupid": -1.1, "worthless": -0.9, "pathetic": -0.8, "clown": -0.5, "moron": -1.2,
        "loser": -0.9, "scum": -1.3, "disgusting": -1.2, "was": -0.1, "with": 0.4, "are": 0.3, "for": 0.5, "avec": 0.6, "eau": 0.2, "mit": 0.3,
    },
    phrases={"of the": 0.2, "is the": -0.3, "de la": 0.1},
    negations=("is", "not", "un"), intensifiers=("of", "que"), diminishers=("in", "les"),
)


def sentiment_scores(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.scores(from_documents(spark, sf), LEXICON)


def sentiment_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.rollup(sentiment.scores(from_documents(spark, sf), LEXICON, ("category",)), "category")


def sentiment_overall(spark: SparkSession, sf: str) -> DataFrame:
    return sentiment.rollup(sentiment.scores(from_documents(spark, sf), LEXICON))


def classification_report(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    called = F.when(F.col("n_chars") > 2000, 1).when(F.col("n_chars") > 300, F.lit(0)).otherwise(2)
    return classify.report(docs.join(labels, "doc_id").withColumn("called", called), "quality", "called")


def training_set_filter(spark: SparkSession, sf: str) -> DataFrame:
    held = classify.training_set(from_documents(spark, sf), "content", "category", "doc_id")
    return held.select("doc_id", "category")


def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return classify.stratified(table(spark, sf, "labels"), "toxic", "doc_id").select("doc_id", "toxic", "part")


def train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Language by words: report of the held-out fifth."""
    rows = classify.training_set(from_documents(spark, sf).select("doc_id", "content", "lang"), "content", "lang", "doc_id")
    parts = classify.stratified(rows, "lang", "doc_id")
    return classify.fit_and_report(parts, classify.lexical_model("content", "lang", parts.filter("part = 'train'").count()), "lang")


def train_dense_classifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = classify.as_vector(table(spark, sf, "embeddings"), "embedding").withColumn("label_name", F.col("label").cast("string"))
    parts = classify.stratified(rows.drop("label"), "label_name", "vec_id")
    return classify.fit_and_report(parts, classify.dense_model("label_name", parts.count()), "label_name")


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    _, rows = cluster.best_kmeans(table(spark, sf, "embeddings"), "embedding", 12)
    return rows.select("vec_id", "cluster")


def pca_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.principal(table(spark, sf, "embeddings"), "embedding", "vec_id")[0]


def word2vec_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = from_documents(spark, sf).select("doc_id", text.terms("content").alias("tokens"))
    known = represent.term_vectors(represent.word2vec(docs, "tokens", size=32, least=5))
    items = represent.pooled(docs, "tokens", known, 32)
    asked = spark.createDataFrame([(0, ["the", "loser", "and", "the", "clown"])], "doc_id long, tokens array<string>")
    query = represent.pooled(asked, "tokens", known, 32).select(F.col("embedding").alias("q"))
    return search.dense_search(items, query, "cosine", id_col="doc_id")


def enriched_articles(spark: SparkSession, sf: str) -> DataFrame:
    lemmas = spark.createDataFrame([("are", "be"), ("was", "be"), ("is", "be")], "term string, lemma string")
    rows = represent.enriched(from_documents(spark, sf), ["the", "and", "of"], lemmas, represent.light_stem)
    return rows.select("doc_id", *[F.size(c).alias(c) for c in ("tokens", "tokens_normalizados", "tokens_sem_stopwords", "lemas")], F.array_join("stems", " ").alias("stems"))


def html_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html.extract(table(spark, sf, "pages"))


def link_extract(spark: SparkSession, sf: str) -> DataFrame:
    return html.links(table(spark, sf, "pages"))


def event_daily_counts(spark: SparkSession, sf: str) -> DataFrame:
    return daily_counts(table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")


def _words(spark: SparkSession, sf: str) -> DataFrame:
    return from_documents(spark, sf).select("doc_id", text.terms("content").alias("w"))


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents' words (``doc_id, w``) as parsed tokens, by rules that stand in for a parser.

    Sentences are six words: determiner, subject, verb, preposition, complement and what belongs to
    it. In every second sentence the verb is joined to the one before and has no subject of its
    own. Subjects of eight letters or more are entities.
    """
    deps, tags = pa.array("det nsubj ROOT case obj nmod advmod conj obl".split()), pa.array("DET NOUN VERB ADP NOUN PROPN".split())
    for rows in parse_rows.parts(batches):
        words = rows.column(1).flatten()
        n = rows.column(1).value_lengths().to_numpy(zero_copy_only=False)
        end = np.cumsum(n)
        i, length = np.arange(len(words)) - np.repeat(end - n, n), pc.utf8_length(words).to_numpy(zero_copy_only=False)
        r, second = i % 6, i // 6 % 2 == 1
        head = i + np.array([1, 1, 0, 1, -2, -1])[r] - 6 * (second & (r == 2))
        head = np.where(head < np.repeat(n, n), head, i)
        dep = np.select([(r == 1) & second, (r == 2) & second, (r == 4) & (length % 2 == 1)], [6, 7, 8], r)
        small = lambda x: pa.array(x, pa.int32())
        tokens = pa.StructArray.from_arrays(
            [small(i // 6), small(i), small(head), deps.take(small(dep)), tags.take(small(r)), words, words], ["sent", "i", "head", "dep", "pos", "lemma", "text"]
        )
        named = (r == 1) & (length >= 8)
        at = np.flatnonzero(named)
        label = pa.array(["PER", "LOC"]).take(small(length[at] % 2))
        entities = pa.StructArray.from_arrays([small(i[at]), small(i[at] + 1), label, words.take(small(at))], ["start", "stop", "label", "entity"])
        lists = lambda ends, values: pa.ListArray.from_arrays(small(np.append(0, ends)), values)
        held = np.append(0, np.cumsum(named))[end]
        yield pa.RecordBatch.from_arrays([rows.column(0), lists(end, tokens), lists(held, entities)], names=["doc_id", "tokens", "entities"])


def sentence_map(spark: SparkSession, sf: str) -> DataFrame:
    return extract.sentences_of(_words(spark, sf), _parsed)


def relation_triples(spark: SparkSession, sf: str) -> DataFrame:
    return extract.triples_of(_words(spark, sf), _parsed)


def relation_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract.triples_of(_words(spark, sf), _parsed)
    return extract.rollup(rows, "relation", F.concat_ws(" - ", "subject", "object"), 10, ["doc_id", "sent"])


def entity_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return extract.rollup(extract.mentions_of(_words(spark, sf), _parsed), "label", F.col("entity"), 15, ["doc_id", "start"])


def _spaces(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Documents that have stored vectors, in two dense representations: ``doc_id, lang, v``."""
    space = retrieval._space(spark, sf)
    docs = space.docs.join(space.embeddings, "doc_id").select("doc_id", "lang", "content", F.col("embedding").alias("v"))
    means = search.pooled(docs.select("doc_id", text.terms("content").alias("tokens")), "tokens", space.model, DIMENSIONS)
    return {"bert": docs, "word2vec": docs.drop("v").join(means.withColumnRenamed("embedding", "v"), "doc_id")}


def cluster_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Silhouette and purity of k-means over two representations and three k."""
    spaces = {name: (rows.select("doc_id", "lang", "v").persist(), "v", DIMENSIONS) for name, rows in _spaces(spark, sf).items()}
    compared = cluster.compare_representations(spaces, "lang", seeds=3)
    found = spark.createDataFrame(compared.collect(), compared.schema)  # a row for each representation and k
    for rows, _, _ in spaces.values():
        rows.unpersist()
    return found


def cluster_drawing(spark: SparkSession, sf: str) -> DataFrame:
    """Points of the word-vector clustering with twelve clusters, each with its cluster's legend."""
    docs = from_documents(spark, sf)
    weights = search.postings(docs, text.terms("content"), search.vocabulary_of(docs, text.terms("content")), docs.count())
    rows = written(_spaces(spark, sf)["word2vec"].select("doc_id", "lang", "v"))  # read by every step of the drawing
    drawn = cluster.drawing(rows, "v", "lang", 12, weights=weights)
    return drawn.points.join(drawn.legend.drop("size", "correct"), "cluster")


def classifier_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Language by each of four representations; none is stored for the last."""
    spaces = _spaces(spark, sf)
    text_rows = spaces["bert"].select("doc_id", "lang", F.col("content").alias("value"))
    dense = {name: (rows.select("doc_id", "lang", F.col("v").alias("value")), "dense") for name, rows in spaces.items()}
    return classify.compare_representations({"tfidf": (text_rows, "lexical"), **dense, "absent": (None, "dense")}, "lang")


def embedding_gather(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors of labelled documents, by document id."""
    held = retrieval._space(spark, sf).embeddings
    joined = table(spark, sf, "labels").join(held, "doc_id")
    return joined.select("doc_id", "quality", F.round(vectors.norm(F.col("embedding")), 6).alias("length"))


def cluster_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of any k-means: every row is in one of twelve clusters, none is empty."""
    found = kmeans_clusters(spark, sf)
    return found.agg(F.count("*").alias("rows"), F.count_distinct("cluster").alias("clusters"), F.count_distinct("vec_id").alias("ids"))


def principal_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What holds of principal coordinates: their means are 0, and no two go together."""
    at = pca_coordinates(spark, sf)
    zero = lambda c: (F.abs(c) < 1e-9).cast("int")
    pairs = ("xy", "xz", "yz")
    return at.agg(F.count("*").alias("rows"), *[zero(F.avg(c)).alias(f"{c}_centred") for c in "xyz"], *[zero(F.covar_pop(*p)).alias(f"{p}_apart") for p in pairs])


QUERIES = {
    f.__name__: f
    for f in (
        cluster_category_crosstab, cluster_majority, cluster_purity, cluster_confusion, cluster_cohesion, centroid_distances,
        centroid_distance_summary, silhouette_cosine, cluster_top_terms, block_mean_pooling, similarity_pairs, cluster_comparison, sentiment_scores,
        sentiment_rollup, sentiment_overall, classification_report, training_set_filter, stratified_split, train_classifier,
        train_dense_classifier, kmeans_clusters, pca_coordinates, word2vec_search, enriched_articles, html_extract, link_extract,
        event_daily_counts, sentence_map, relation_triples, relation_rollup, entity_rollup, cluster_drawing, classifier_comparison, embedding_gather,
        cluster_invariants, principal_invariants,
    )
}

LABELLED = "WITH e AS (SELECT vec_id, label, 'c' || ((vec_id * 7 + label) % 5) AS category, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
MAJORITY = LABELLED + """, p AS (SELECT label, category, count(*) AS n FROM e GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, category) AS k, sum(n) OVER (PARTITION BY label) AS size FROM p),
m AS (SELECT label, CAST(size AS BIGINT) AS size, category AS majority, n AS correct, round(n / size, 6) AS purity FROM r WHERE k = 1)"""
UNIT = LABELLED + """, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM e)"""
CENTROIDS = LABELLED + f""", c AS (SELECT label, [{", ".join(f"avg(v[{k + 1}])" for k in range(DIMENSIONS))}] AS c FROM e GROUP BY label),
d AS (SELECT a.label AS a, b.label AS b, round(greatest(0, least(2, 1 - list_cosine_similarity(a.c, b.c))), 6) AS distance FROM c a JOIN c b ON a.label < b.label)"""


def _sentiment_sql() -> str:
    lexicon = ", ".join(f"('{w}', {x}::DOUBLE)" for w, x in LEXICON.words.items())
    listed = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
    before = lambda n, words: "(" + " OR ".join(f"coalesce(lag(term, {k}) OVER w IN {listed(words)}, false)" for k in range(1, n + 1)) + ")"
    count = lambda p: f"(len(string_split(joined, ' {p} ')) - 1)"
    part = lambda sign: " + ".join(["0.0", *(f"{count(p)} * {x}" for p, x in LEXICON.phrases.items() if x * sign > 0)])
    return ARTICLES + f""", l AS (SELECT * FROM (VALUES {lexicon}) AS t(term, weight)),
g AS (SELECT doc_id, category, list_filter(string_split(regexp_replace(lower(regexp_replace(strip_accents(array_to_string(regexp_extract_all(lower(title || ' ' || content), '\\p{{L}}+'), ' ')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z ]+', '', 'g'), ' '), lambda x: x <> '') AS t FROM articles),
o AS (SELECT doc_id, pos, t[pos + 1] AS term FROM (SELECT doc_id, t, unnest(range(len(t))) AS pos FROM g)),
x AS (SELECT doc_id, term, CASE WHEN {before(3, LEXICON.negations)} THEN -0.8 ELSE 1.0 END * CASE WHEN {before(2, LEXICON.intensifiers)} THEN 1.4 ELSE 1.0 END
  * CASE WHEN {before(2, LEXICON.diminishers)} THEN 0.7 ELSE 1.0 END AS factor FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
h AS (SELECT doc_id, sum(weight * factor) FILTER (weight * factor > 0) AS p, -sum(weight * factor) FILTER (weight * factor <= 0) AS n, count(*) AS c FROM x JOIN l USING (term) GROUP BY doc_id),
j AS (SELECT doc_id, category, ' ' || array_to_string(t, ' ') || ' ' AS joined FROM g),
s AS (SELECT doc_id, category, round(coalesce(p, 0) + {part(1)}, 6) AS positive_score, round(coalesce(n, 0) - ({part(-1)}), 6) AS negative_score,
  CAST(coalesce(c, 0) + {" + ".join(count(p) for p in LEXICON.phrases)} AS INTEGER) AS sentiment_terms FROM j LEFT JOIN h USING (doc_id)),
z AS (SELECT *, round(CASE WHEN positive_score + negative_score = 0 THEN 0 ELSE (positive_score - negative_score) / (positive_score + negative_score) END, 6) AS sentiment_score FROM s),
scored AS (SELECT *, CASE WHEN sentiment_score >= 0.15 THEN 'positive' WHEN sentiment_score <= -0.15 THEN 'negative' ELSE 'neutral' END AS sentiment_label FROM z)"""


ROLLUP = """count(*) AS n, round(sum(CAST(round(sentiment_score * 1000000) AS BIGINT)) / (count(*) * 1000000.0::DOUBLE), 6) AS mean_score, CAST(sum(sentiment_terms) AS BIGINT) AS terms, count(*) FILTER (sentiment_label = 'positive') AS positive,
count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative FROM scored"""
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extract.PREPOSITIONS.items())
PARSED = ARTICLES.replace("WITH articles", "WITH RECURSIVE articles") + r""", w AS (SELECT doc_id, regexp_extract_all(lower(content), '\p{L}+') AS w FROM articles),
p AS (SELECT doc_id, len(w) AS n, unnest(range(len(w))) AS i, unnest(w) AS text FROM w),
q AS (SELECT *, i % 6 AS r, (i // 6) % 2 = 1 AS second FROM p),
h AS (SELECT *, CASE WHEN r <= 1 OR r = 3 THEN i + 1 WHEN r = 2 AND second THEN i - 6 WHEN r = 2 THEN i WHEN r = 4 THEN i - 2 ELSE i - 1 END AS g FROM q),
t AS (SELECT doc_id, CAST(i // 6 AS INTEGER) AS sent, CAST(i AS INTEGER) AS i, CAST(CASE WHEN g < n THEN g ELSE i END AS INTEGER) AS head,
  CASE r WHEN 0 THEN 'det' WHEN 1 THEN CASE WHEN second THEN 'advmod' ELSE 'nsubj' END WHEN 2 THEN CASE WHEN second THEN 'conj' ELSE 'ROOT' END WHEN 3 THEN 'case'
    WHEN 4 THEN CASE WHEN len(text) % 2 = 0 THEN 'obj' ELSE 'obl' END ELSE 'nmod' END AS dep,
  ['DET', 'NOUN', 'VERB', 'ADP', 'NOUN', 'PROPN'][r + 1] AS pos, text AS lemma, text FROM h),
e AS (SELECT doc_id, i AS start, i + 1 AS stop, CASE WHEN len(text) % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label, text AS entity FROM t WHERE i % 6 = 1 AND len(text) >= 8),
"""+f"""below AS (SELECT doc_id, i AS root, i FROM t UNION ALL SELECT b.doc_id, b.root, t.i FROM below b JOIN t ON t.doc_id = b.doc_id AND t.head = b.i AND t.i <> t.head),
x AS (SELECT b.doc_id, b.root, t.i, t.text, t.dep, t.pos <> 'PUNCT' AS fine FROM below b JOIN t USING (doc_id, i)),
f AS (SELECT doc_id, root, min(i) FILTER (fine AND dep NOT IN ('case', 'det')) AS first FROM x GROUP BY ALL),
ph AS (SELECT x.doc_id, x.root, string_agg(text, ' ' ORDER BY i) FILTER (fine AND i >= first) AS clean FROM x JOIN f USING (doc_id, root) GROUP BY ALL),
en AS (SELECT t.doc_id, t.i, arg_min(entity, start) AS entity, arg_min(label, start) AS label FROM t JOIN e ON e.doc_id = t.doc_id AND start <= t.i AND t.i < stop GROUP BY ALL),
a AS (SELECT ph.doc_id, ph.root AS i, coalesce(entity, clean) AS argument, coalesce(label, '') AS label FROM ph LEFT JOIN en ON en.doc_id = ph.doc_id AND en.i = ph.root),
v AS (SELECT * FROM t WHERE pos IN ('VERB', 'AUX')), sb AS (SELECT doc_id, head AS v, i AS s FROM t WHERE dep IN ('nsubj', 'nsubj:pass')),
own AS (SELECT v.doc_id, v.sent, v.i AS v, v.lemma AS verb, s FROM v JOIN sb ON sb.doc_id = v.doc_id AND sb.v = v.i
  UNION ALL SELECT v.doc_id, v.sent, v.i, v.lemma, s FROM v JOIN v h ON h.doc_id = v.doc_id AND h.i = v.head JOIN sb ON sb.doc_id = v.doc_id AND sb.v = v.head
  WHERE v.dep = 'conj' AND NOT EXISTS (SELECT 1 FROM sb z WHERE z.doc_id = v.doc_id AND z.v = v.i)),
pr AS (SELECT doc_id, head AS o, arg_min(CASE text {_CASES} ELSE lemma END, i) AS prep FROM t WHERE dep = 'case' GROUP BY ALL),
tr AS (SELECT own.doc_id, own.sent, sa.argument AS subject, sa.label AS subject_label, CASE WHEN c.dep = 'obl' AND prep IS NOT NULL THEN verb || '_' || prep ELSE verb END AS relation,
  oa.argument AS object, oa.label AS object_label, verb, c.dep AS dependency FROM own JOIN t c ON c.doc_id = own.doc_id AND c.head = own.v AND c.dep IN ('obj', 'iobj', 'obl')
  LEFT JOIN pr ON pr.doc_id = c.doc_id AND pr.o = c.i JOIN a sa ON sa.doc_id = own.doc_id AND sa.i = own.s JOIN a oa ON oa.doc_id = c.doc_id AND oa.i = c.i
  WHERE lower(sa.argument) NOT IN ('que', 'qual', 'quais', 'quem', 'onde', 'quando', 'como') AND lower(oa.argument) NOT IN ('que', 'qual', 'quais', 'quem', 'onde', 'quando', 'como'))"""


def _rollup_sql(source: str, group: str, item: str, order: str, k: int) -> str:
    return f""", c AS (SELECT {group}, {item} AS item, count(*) AS n, min({order}) AS seen FROM {source} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY n DESC, seen, item) AS k FROM c)
SELECT {group}, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS distinct_items, string_agg(item || ': ' || n, '; ' ORDER BY k) FILTER (k <= {k}) AS top FROM r GROUP BY {group}"""


def _enriched_sql() -> str:
    ends = sorted(represent.ENDINGS, key=len, reverse=True)
    stem = " ".join(f"WHEN x LIKE '%{e}' AND len(x) - {len(e)} >= 3 THEN left(x, len(x) - {len(e)})" for e in ends)
    return ARTICLES + rf""", a AS (SELECT doc_id, regexp_extract_all(title || ' ' || content, '[\p{{L}}\p{{N}}]+(?:-[\p{{L}}\p{{N}}]+)*|[^\s\p{{L}}\p{{N}}]') AS tokens FROM articles),
b AS (SELECT *, list_filter(list_transform(tokens, lambda x: lower(x)), lambda x: regexp_full_match(x, '\p{{L}}+')) AS norm FROM a),
c AS (SELECT *, list_filter(norm, lambda x: x NOT IN ('the', 'and', 'of')) AS kept FROM b)
SELECT doc_id, CAST(len(tokens) AS INTEGER) AS tokens, CAST(len(norm) AS INTEGER) AS tokens_normalizados, CAST(len(kept) AS INTEGER) AS tokens_sem_stopwords,
CAST(len(kept) AS INTEGER) AS lemas, array_to_string(list_transform(kept, lambda x: CASE {stem} ELSE x END), ' ') AS stems FROM c"""


ORACLE_SQL = {
    "cluster_category_crosstab": LABELLED + " SELECT category, " + ", ".join(f"count(*) FILTER (label = {k}) AS label_{k}" for k in range(10)) + " FROM e GROUP BY category",
    "cluster_majority": MAJORITY + " SELECT * FROM m",
    "cluster_purity": MAJORITY + " SELECT round(sum(correct) / sum(size), 6) AS purity, array_to_string(list_sort(list(DISTINCT majority)), ',') AS categories, CAST(sum(size) AS BIGINT) AS rows FROM m",
    "cluster_confusion": MAJORITY + " SELECT category AS actual, majority AS predicted, count(*) AS n FROM e JOIN m USING (label) GROUP BY ALL",
    "cluster_cohesion": UNIT + """, q AS (SELECT a.label, avg(list_dot_product(a.u, b.u)) AS c FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1)
SELECT label, count(*) AS size, round(coalesce(any_value(c), 1.0), 6) AS cohesion FROM u LEFT JOIN q USING (label) GROUP BY label""",
    "centroid_distances": CENTROIDS + " SELECT * FROM d",
    "centroid_distance_summary": CENTROIDS + " SELECT round(avg(distance), 5) AS mean_distance, min(distance) AS min_distance FROM d",
    "silhouette_cosine": UNIT + """, p AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(1 - list_dot_product(a.u, b.u)) FILTER (a.vec_id <> b.vec_id) AS s, count(*) AS n FROM u a, u b GROUP BY ALL),
r AS (SELECT vec_id, max(CASE WHEN own = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM p GROUP BY vec_id)
SELECT round(avg(coalesce((b - a) / nullif(greatest(a, b), 0), 0)), 6) AS silhouette FROM r""",
    "cluster_top_terms": ARTICLES + f""", {TFIDF}, z AS (SELECT category, count(*) AS n FROM articles GROUP BY category),
s AS (SELECT category, term, sum(w) AS w FROM tfidf JOIN articles USING (doc_id) GROUP BY ALL),
r AS (SELECT category, term, row_number() OVER (PARTITION BY category ORDER BY round(w / n, 6) DESC, term) AS k FROM s JOIN z USING (category))
SELECT category, string_agg(term, '; ' ORDER BY k) FILTER (k <= 8) AS terms, string_agg(term, ' / ' ORDER BY k) FILTER (k <= 3) AS name FROM r GROUP BY category""",
    "block_mean_pooling": LABELLED + f""", m AS (SELECT label, count(*) AS blocks, [{", ".join(f"round(avg(v[{k + 1}]), 6)" for k in range(DIMENSIONS))}] AS mean FROM e GROUP BY label)
SELECT label, blocks, CAST(d AS INTEGER) AS dimension, mean[d + 1] AS mean FROM m, (SELECT unnest(range({DIMENSIONS})) AS d)""",
    "similarity_pairs": UNIT + """ SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.u, b.u), 6) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id
WHERE list_dot_product(a.u, b.u) >= 0.35""",
    "sentiment_scores": _sentiment_sql() + " SELECT doc_id, positive_score, negative_score, sentiment_terms, sentiment_score, sentiment_label FROM scored",
    "sentiment_rollup": _sentiment_sql() + f" SELECT category, {ROLLUP} GROUP BY category",
    "sentiment_overall": _sentiment_sql() + f" SELECT {ROLLUP}",
    "classification_report": """WITH x AS (SELECT CAST(quality AS VARCHAR) AS a, CASE WHEN n_chars > 2000 THEN '1' WHEN n_chars > 300 THEN '0' ELSE '2' END AS p FROM documents JOIN labels USING (doc_id)),
l AS (SELECT a AS label FROM x UNION SELECT p FROM x), c AS (SELECT label, (SELECT count(*) FROM x WHERE a = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS called,
  (SELECT count(*) FROM x WHERE a = label AND p = label) AS hit FROM l),
e AS (SELECT label, coalesce(hit / nullif(called, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall, support, hit FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM e),
r AS (SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'accuracy', sum(hit) / sum(support), sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM f
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM f)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM r""",
    "training_set_filter": """WITH o AS (SELECT min(doc_id) AS doc_id, source AS category FROM documents WHERE trim(text) <> '' GROUP BY text, source)
SELECT doc_id, category FROM o WHERE category IN (SELECT category FROM o GROUP BY category HAVING count(*) >= 30)""",
    "stratified_split": """SELECT doc_id, toxic, CASE WHEN row_number() OVER (PARTITION BY toxic ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) <= round(count(*) OVER (PARTITION BY toxic) * 0.2)
THEN 'test' ELSE 'train' END AS part FROM labels""",
    "event_daily_counts": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sentence_map": PARSED + " SELECT doc_id, sent, min(i) AS start, max(i) + 1 AS stop, string_agg(text, ' ' ORDER BY i) AS sentence FROM t GROUP BY doc_id, sent",
    "relation_triples": PARSED + " SELECT * FROM tr",
    "relation_rollup": PARSED + _rollup_sql("tr", "relation", "subject || ' - ' || object", "(doc_id, sent)", 10),
    "entity_rollup": PARSED + _rollup_sql("e", "label", "entity", "(doc_id, start)", 15),
    "embedding_gather": "SELECT doc_id, quality, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS length FROM labels JOIN embeddings ON vec_id = doc_id",
    "cluster_invariants": "SELECT count(*) AS rows, CAST(12 AS BIGINT) AS clusters, count(DISTINCT vec_id) AS ids FROM embeddings",
    "principal_invariants": "SELECT count(*) AS rows, " + ", ".join(f"CAST(1 AS INTEGER) AS {c}" for c in ("x_centred", "y_centred", "z_centred", "xy_apart", "xz_apart", "yz_apart")) + " FROM embeddings",
    "enriched_articles": _enriched_sql(),
}
