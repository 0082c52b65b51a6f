import datetime
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.functions import text
from lumenary.operators import classify, clean, cluster, digest, extract, represent, search, sentiment
from lumenary.sources import articles, html
from lumenary.streaming.upsert import state, stream_upsert


def test_upsert_keeps_first_place_and_last_value(spark):
    old = spark.createDataFrame([("a", "1", 0), ("b", "1", 1)], "url string, v string, at int")
    new = spark.createDataFrame([("b", "2", 0), ("c", "2", 1), ("c", "3", 2)], "url string, v string, at int")
    got = {r["url"]: (r["v"], r["first_side"], r["first_at"]) for r in clean.upsert(old, new, "url", "at").collect()}
    assert got == {"a": ("1", 0, 0), "b": ("2", 0, 1), "c": ("3", 1, 1)}


def test_short_repeats_count_as_short(spark):
    rows = [(0, "h", 30), (1, "h", 30), (2, "h", 5), (3, "k", 40)]
    df = spark.createDataFrame(rows, "doc_id long, content_hash string, word_count int")
    assert tuple(clean.removal_causes(df).first()) == (4, 1, 1, 2)
    assert sorted(r["doc_id"] for r in clean.keep_first(df, "doc_id").collect()) == [0, 3]


def test_public_count(spark):
    rows = [(0, "News", "a", 30), (1, "News", "a", 30), (2, "Jobs, News", "b", 30), (3, "Ads", "c", 30), (4, "News", "d", 5), (5, "Sport, Jobs", "e", 30)]
    df = spark.createDataFrame(rows, "doc_id long, category string, content_hash string, word_count int")
    assert clean.public_count(df, ["Jobs", "Ads"]).first()[0] == 2


def test_crawl_stops_after_two_old_pages_and_at_a_repeated_one(spark):
    day = lambda d: datetime.date(2026, 10, d)
    pages = [(1, day(25), 1), (2, day(22), 2), (3, day(20), 3), (4, day(19), 4), (5, day(1), 5)]
    df = spark.createDataFrame(pages, "page int, last_day date, signature long")
    since = F.lit("2026-10-21").cast("date")
    got = [tuple(r) for r in clean.crawl_plan(df, since).orderBy("page").collect()]
    assert [p for p, _, _ in got] == [1, 2, 3, 4] and got[-1] == (4, True, True)
    again = spark.createDataFrame([(1, day(25), 1), (2, day(25), 1), (3, day(25), 2)], "page int, last_day date, signature long")
    got = [tuple(r) for r in clean.crawl_plan(again, since).orderBy("page").collect()]
    assert got[-1] == (2, False, False)


def test_periods_with_mixed_zones_and_no_dates(spark):
    rows = [("2026-09-21T12:00:00+00:00",), ("2026-11-11T18:00:00",), ("never",)]
    df = spark.createDataFrame(rows, "p string")
    got = {r["p"]: r["period"] for r in clean.periods(df, F.try_to_timestamp("p")).collect()}
    assert list(got.values()) == ["previous", "recent", None]
    assert clean.periods(df.filter("p = 'never'"), F.try_to_timestamp("p")).first()["period"] is None


def test_lexical_scores_equal_dense_vectors(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "c d"), (3, "a a e"), (4, "z")], "doc_id long, content string")
    tf = search.counts(docs, text.terms("content"))
    terms = search.vocabulary(tf, min_df=1)
    names = sorted(r["term"] for r in terms.collect())
    bow = {d: np.array([s.split().count(t) for t in names], float) for d, s in [(1, "a b b c"), (2, "c d"), (3, "a a e"), (4, "z")]}
    q = np.array(["a c".split().count(t) for t in names], float)
    weights = search.query_weights(spark, "a c unknown", terms, 4, "bow")
    for metric, f in {
        "cosine": lambda x: x @ q / (np.linalg.norm(x) * np.linalg.norm(q)), "euclid": lambda x: 1 / (1 + np.linalg.norm(x - q)), "manhattan": lambda x: 1 / (1 + np.abs(x - q).sum()),
    }.items():
        for row in search.lexical_scores(search.bow(tf, terms), weights, metric).collect():
            assert math.isclose(row["score"], f(bow[row["doc_id"]]), rel_tol=1e-9, abs_tol=1e-12)


def test_fusion_identity(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "position int, doc_id long")
    b = spark.createDataFrame([(1, 20), (2, 30)], "position int, doc_id long")
    got = {r["doc_id"]: r["score"] for r in search.fuse([a, b]).collect()}
    assert abs(got[20] - (1 / 61 + 1 / 62)) < 1e-12 and abs(got[10] - 1 / 61) < 1e-12


def test_digest_window_seen_and_named_events(spark):
    rows = [(0, "chuva", "x", "2026-11-16", "u0"), (1, "festa", "oktober", "2026-11-16", "u1"), (2, "sol", "x", "2026-11-15", "u2")]
    docs = spark.createDataFrame(rows, "doc_id long, title string, category string, published_at string, url string")
    end = datetime.date(2026, 11, 16)
    seen = spark.createDataFrame([("u0",)], "url string")
    assert [r["doc_id"] for r in digest.in_window(docs, end, "daily").orderBy("doc_id").collect()] == [0, 1]
    assert [r["doc_id"] for r in digest.in_window(docs, end, "weekly", seen).orderBy("doc_id").collect()] == [1, 2]
    scores = spark.createDataFrame([(0, 0.5), (1, 0.4), (2, 0.03)], "doc_id long, score double")
    none = scores.filter("false")
    assert [r["doc_id"] for r in digest.select(docs, scores, none).orderBy("position").collect()] == [0, 1]
    assert [r["doc_id"] for r in digest.select(docs, scores, none, ["oktober"]).collect()] == [1]


def test_digest_rendering_and_state(spark):
    report = {
        "area": "<b>", "start": "1", "end": "2", "summary": "s", "closing": "c", "highlights": [{"title": "<i>", "text": "t", "sources": [1]}],
        "articles": [{"title": "x", "url": "javascript:alert(1)"}, {"title": "y", "url": "https://y.org/"}],
    }
    page = digest.as_html(report)
    assert "<h1>&lt;b&gt;" in page and "<i>" not in page and "javascript" not in page and 'href="https://y.org/"' in page
    assert "[1]" in digest.as_text(report)
    items = [{"title": "*a*", "text": "b_", "sources": [3, 1, 1, 9]}, {"title": "x", "text": "y", "sources": [0]}]
    assert digest.checked_highlights(items, 3) == [{"title": "a", "text": "b", "sources": [1, 3]}]
    row = spark.sql("SELECT array('a','b','c') AS s, array('c','d') AS n").select(digest.remembered(F.col("s"), F.col("n"), 3)).first()[0]
    assert row == ["b", "c", "d"]
    now = datetime.datetime(2026, 11, 16, 20, 30)
    assert digest.due(True, now, "20:30", 0, "daily", "2026-11-15", now.date())
    assert not digest.due(True, now, "20:30", 0, "daily", "2026-11-16", now.date())
    assert not digest.due(True, now, "20:31", 0, "daily", "", now.date())


def test_sentiment_context(spark):
    lexicon = sentiment.Lexicon({"good": 1.0, "bad": -1.0}, {"so so": 0.5}, ("not",), ("very",), ("bit",))

    def score(words):
        held = spark.createDataFrame([(1, "", words)], "doc_id long, title string, content string")
        row = sentiment.scores(held, lexicon).first()
        return row["positive_score"] - row["negative_score"], row["sentiment_label"]

    assert score("not good")[0] == -0.8 and score("not a b good")[0] == -0.8 and score("not a b c good")[0] == 1.0
    assert score("very a good")[0] == 1.4 and score("very a b good")[0] == 1.0
    assert score("not very good")[0] == -1.12 and score("bit good")[0] == 0.7
    assert score("so so so so")[0] == 0.5  # a shared delimiter is one occurrence
    assert score("nothing here") == (0, "neutral") and score("")[1] == "neutral"


def test_cluster_measures(spark):
    rng = np.random.default_rng(42)
    x = np.concatenate((rng.normal((5, 1, 1, 1), 0.12, (6, 4)), rng.normal((1, 5, 1, 1), 0.12, (6, 4))))
    rows = [(i, [float(v) for v in r], "AB"[i // 6]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, category string")
    _, found = cluster.best_kmeans(df, "embedding", 2, seeds=3)
    by = cluster.majority(found, "cluster", "category")
    assert cluster.purity(by).first()["purity"] == 1
    assert cluster.silhouette(found, "cluster", "embedding", 4).first()[0] > 0.9
    _, shares = cluster.principal(df, "embedding", "vec_id", 3)
    assert len(shares) == 3 and shares[0] > 0.9
    one = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0])], "c int, v array<double>")
    assert {r["c"]: r["cohesion"] for r in cluster.cohesion(one, "c", "v", 2).collect()} == {0: 1.0, 1: 0.0}


def test_report_with_a_class_that_is_never_called(spark):
    got = {r["label"]: r for r in classify.report(spark.createDataFrame([("a", "a"), ("b", "a")], "x string, y string"), "x", "y").collect()}
    assert got["b"]["precision"] == 0 and got["a"]["precision"] == 0.5 and got["accuracy"]["f1"] == 0.5


def test_training_set_drops_small_categories(spark):
    rows = [(i, f"t{i % 3}", "A") for i in range(6)] + [(9, "t", "B")]
    got = classify.training_set(spark.createDataFrame(rows, "id long, t string, c string"), "t", "c", "id", least=2).collect()
    assert sorted(r["id"] for r in got) == [0, 1, 2]


#: A parsed passage: two verbs joined, one with a contracted preposition, a pronoun, an entity of two tokens.
TOKENS = [
    (1, 0, 0, 1, "det", "DET", "o", "O"), (1, 0, 1, 2, "nsubj", "NOUN", "prefeito", "prefeito"), (1, 0, 2, 2, "ROOT", "VERB", "visitar", "visitou"),
    (1, 0, 3, 4, "det", "DET", "a", "a"), (1, 0, 4, 2, "obj", "NOUN", "escola", "escola"), (1, 0, 5, 6, "cc", "CCONJ", "e", "e"),
    (1, 0, 6, 2, "conj", "VERB", "falar", "falou"), (1, 0, 7, 8, "case", "ADP", "em", "na"), (1, 0, 8, 6, "obl", "PROPN", "Vila", "Vila"),
    (1, 0, 9, 8, "flat:name", "PROPN", "Nova", "Nova"), (1, 0, 10, 2, "punct", "PUNCT", ".", "."),
    (1, 1, 11, 12, "nsubj", "PRON", "quem", "Quem"), (1, 1, 12, 12, "ROOT", "VERB", "ver", "viu"), (1, 1, 13, 12, "obj", "NOUN", "chuva", "chuva"),
    (2, 0, 0, 2, "nsubj", "PROPN", "Ana", "Ana"), (2, 0, 1, 2, "nsubj", "PROPN", "Rui", "Rui"), (2, 0, 2, 2, "ROOT", "VERB", "comprar", "compram"),
    (2, 0, 3, 2, "obj", "NOUN", "casa", "casas"), (2, 0, 4, 5, "case", "ADP", "por", "pelo"), (2, 0, 5, 2, "obl", "NOUN", "rio", "rio"),
]
ENTITIES = [(1, 8, 10, "LOC", "Vila Nova"), (2, 0, 1, "PER", "Ana"), (2, 1, 2, "PER", "Rui"), (1, 4, 5, "ORG", "escola"), (3, 0, 1, "PER", "Ana")]


def test_triples(spark):
    tables = spark.createDataFrame(TOKENS, extract.TOKENS), spark.createDataFrame(ENTITIES, extract.ENTITIES)
    got = {(r["subject"], r["relation"], r["object"]) for r in extract.triples(*tables).collect()}
    assert ("prefeito", "visitar", "escola") in got and ("prefeito", "falar_em", "Vila Nova") in got
    assert {("Ana", "comprar", "casas"), ("Rui", "comprar", "casas")} <= got
    assert not any(s == "Quem" for s, _, _ in got)


def test_pooling_ignores_unknown_tokens(spark):
    known = spark.createDataFrame([("a", [2.0, 4.0])], "term string, v array<double>")
    docs = spark.createDataFrame([(1, ["a", "x"]), (2, ["x"])], "doc_id long, tokens array<string>")
    assert {r["doc_id"]: r["embedding"] for r in represent.pooled(docs, "tokens", known, 2).collect()} == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_html(spark):
    page = """<html><head><title>Site</title><script type="application/ld+json">{bad</script>
    <script type="application/ld+json">{"a": {"datePublished": "2026-01-02"}, "articleSection": ["Sport", "x"]}</script></head>
    <body><nav><p>menu</p></nav><h1> A  title </h1><p>One &amp; two</p><form><p>no</p></form><p></p><p>Three</p>
    <a href="/story/#x">s</a><a href="https://o.org/t//">t</a><a href="/story/">again</a></body></html>"""
    rows = spark.createDataFrame([(1, "https://x.org/p/", page), (2, "https://x.org/q/", "<div>bare</div>"), (3, "u", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.extract(rows).collect()}
    assert (got[1]["title"], got[1]["content"], got[1]["published_at"], got[1]["category"]) == ("A title", "One & two\nThree", "2026-01-02", "Sport")
    assert got[2]["error"] == "no title" and got[2]["content"] == "bare"
    assert sorted((r["link"], r["at"]) for r in html.links(rows).collect()) == [("https://o.org/t/", 1), ("https://x.org/story/", 0)]
    assert [r["link"] for r in html.links(rows, "x.org").collect()] == ["https://x.org/story/"]


def test_posts(spark):
    post = '{"title":{"rendered":"A &amp; B"},"content":{"rendered":"<p>One</p><p>Two</p>"},"date":"2026-11-01T10:00:00","link":"https://x.org/a","categories":[2,1]}'
    posts = spark.createDataFrame([(post,)], "post string")
    labels = spark.createDataFrame([(1, "News"), (2, "Sport")], "id int, name string")
    row = articles.from_posts(posts, labels).first()
    assert (row["title"], row["content"], row["category"], row["url"]) == ("A & B", "One\nTwo", "Sport, News", "https://x.org/a/")
    assert len(row["content_hash"]) == 64 and row["word_count"] == 2


def test_missing_articles_are_an_empty_table(spark, tmp_path):
    assert articles.read_articles(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_stream_upsert_is_idempotent(spark, tmp_path):
    schema = "url string, v int, at long"
    source, target = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], schema).write.parquet(source)
    stream_upsert(spark, source, schema, target, str(tmp_path / "c1"), "url", "at")
    spark.createDataFrame([("b", 2, 3), ("c", 1, 4)], schema).write.mode("append").parquet(source)
    stream_upsert(spark, source, schema, target, str(tmp_path / "c1"), "url", "at")
    assert sorted((r["url"], r["v"]) for r in state(spark, target).collect()) == [("a", 1), ("b", 2), ("c", 1)]
    stream_upsert(spark, source, schema, target, str(tmp_path / "c2"), "url", "at")  # everything once more
    assert sorted((r["url"], r["v"]) for r in state(spark, target).collect()) == [("a", 1), ("b", 2), ("c", 1)]


def test_stream_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    schema = "url string, v int, at long"
    source, target = str(tmp_path / "in"), str(tmp_path / "state")
    rows = [(f"u{k}", 0, k) for k in range(200)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    stream_upsert(spark, source, schema, target, str(tmp_path / "c"), "url", "at", buckets=8)
    spark.createDataFrame([("u5", 1, 999)], schema).coalesce(1).write.mode("append").parquet(source)
    stream_upsert(spark, source, schema, target, str(tmp_path / "c"), "url", "at", buckets=8)
    got = {r["url"]: r["v"] for r in state(spark, target).collect()}
    assert len(got) == 200 and got["u5"] == 1 and sum(got.values()) == 1
    assert sorted(os.listdir(f"{target}/state-000000002"))[-1].startswith("__bucket=") and len([x for x in os.listdir(f"{target}/state-000000002") if x.startswith("__bucket")]) == 1
    with pytest.raises(FileNotFoundError):
        state(spark, str(tmp_path / "none"))


def test_enrichment(spark):
    docs = spark.createDataFrame([(1, "The Dogs", "running x2 guarda-chuva")], "doc_id long, title string, content string")
    lemmas = spark.createDataFrame([("dogs", "dog")], "term string, lemma string")
    row = represent.enriched(docs, ["the"], lemmas, represent.light_stem).first()
    assert row["tokens_sem_stopwords"] == ["dogs", "running"] and row["lemas"] == ["dog", "running"] and row["stems"] == ["dog", "runn"]


def test_alerts(spark):
    rows = [(i, "Chuva forte" if i % 2 else "sol", "x", f"2026-01-0{i}", f"u{i}") for i in range(1, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, title string, category string, published_at string, url string")
    rules = spark.createDataFrame([("CHUVA",)], "term string")
    seen = spark.createDataFrame([("CHUVA", "u7")], "term string, url string")
    assert tuple(digest.alerts(docs, rules, seen, 2).first()) == ("CHUVA", 3, "5,3")


def test_searches_refuse_what_they_cannot_do(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "a c b")], "doc_id long, content string")
    space = search.Space(docs)
    for query, options, error in ((" ", {}, ValueError), ("a", {"k": 0}, ValueError), ("a", {"method": "x"}, ValueError), ("a", {"metric": "x"}, ValueError),
                                  ("a", {"method": "word2vec"}, FileNotFoundError), ("a", {"method": "bert"}, FileNotFoundError)):
        with pytest.raises(error):
            space.search(query, **options)
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "doc_id long, embedding array<double>")
    dense = search.Space(docs, embeddings=items, encode=lambda query: [0.0, 2.0])
    assert [(r["doc_id"], r["score"]) for r in dense.search("b", "bert").orderBy("position").collect()] == [(2, 1.0), (1, 0.0)]
    only = spark.createDataFrame([(1,)], "doc_id long")
    assert [r["doc_id"] for r in space.scores("a", only=only).collect()] == [1]


def test_stratified_is_exact_in_every_category(spark):
    rows = [(k, "ab"[k % 7 == 0]) for k in range(3000)] + [(5000 + k, None) for k in range(10)]
    got = classify.stratified(spark.createDataFrame(rows, "id long, c string"), "c", "id", 0.2).groupBy("c", "part").count().collect()
    assert {(r["c"], r["part"]): r["count"] for r in got} == {("a", "test"): 514, ("a", "train"): 2057, ("b", "test"): 86, ("b", "train"): 343, (None, "test"): 2, (None, "train"): 8}


def test_classifiers_of_several_representations(spark):
    rows = [(k, "xy"[k % 2], " ".join([f"{'uv'[k % 2]}{j}" for j in range(5)]), [float(k % 2), 1.0, float(k % 3)]) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, c string, t string, v array<double>")
    spaces = {"words": (df.select("doc_id", "c", F.col("t").alias("value")), "lexical"), "vectors": (df.select("doc_id", "c", F.col("v").alias("value")), "dense"), "none": (None, "dense")}
    got = {r["representation"]: r for r in classify.compare_representations(spaces, "c").collect()}
    assert got["words"]["accuracy"] == got["vectors"]["weighted_f1"] == 1.0 and got["words"]["test_rows"] == 16
    assert got["none"]["accuracy"] is None and got["none"]["note"]


def test_drawings_are_checked(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 0.1, (8, 4)) for c in ((4, 0, 0, 1), (0, 4, 0, 1), (0, 0, 4, 1))])
    df = spark.createDataFrame([(i, [float(v) for v in r], "abc"[i // 8]) for i, r in enumerate(x)], "doc_id long, v array<double>, c string")
    drawn = cluster.drawing(df, "v", "c", 3, seeds=3)
    assert drawn.points.count() == 24 and drawn.legend.filter("purity = 1").count() == 3
    compared = cluster.compare_representations({"one": (df, "v", 4)}, "c", (3,), 3)
    cluster.check_drawing(drawn, compared, "one")
    with pytest.raises(ValueError):
        cluster.check_drawing(drawn, compared.withColumn("purity", F.lit(0.5)), "one")
    for bad in (df.withColumn("v", F.slice("v", 1, 2)), df.limit(2), df.withColumn("v", F.when(F.col("doc_id") == 1, F.array(F.lit(float("nan")))).otherwise(F.col("v")))):
        with pytest.raises(ValueError):
            cluster.check_matrix(bad, "v", 3)


def test_models_are_stored(spark, tmp_path):
    from lumenary.operators import report

    rows = spark.createDataFrame([(k, "xy"[k % 2], f"{'uv'[k % 2]}word some {k % 5}thing") for k in range(40)], "doc_id long, c string, t string")
    model = classify.lexical_model("t", "c", 40).fit(rows)
    report.save_model(model, str(tmp_path / "m"))
    again = report.load_model(str(tmp_path / "m")).transform(rows)
    assert [r["prediction"] for r in again.orderBy("doc_id").collect()] == [r["prediction"] for r in model.transform(rows).orderBy("doc_id").collect()]


def test_masked_means_and_blocks(spark):
    df = spark.sql("SELECT array(array(1d, 2d), array(3d, 4d), array(9d, 9d)) AS t, array(1, 1, 0) AS m")
    assert df.select(represent.masked_mean(F.col("t"), F.col("m"), 2)).first()[0] == [2.0, 3.0]
    assert df.select(represent.masked_mean(F.col("t"), F.array(*[F.lit(0)] * 3), 2)).first()[0] == [0.0, 0.0]
    docs = spark.createDataFrame([(1, ["a"] * 5), (2, [])], "doc_id long, tokens array<string>")
    make = lambda: lambda texts: [[float(len(t.split())), 1.0] for t in texts]
    assert {r["doc_id"]: r["embedding"] for r in represent.encoded_blocks(docs, make, "tokens", 2, block=4).collect()} == {1: [2.5, 1.0], 2: [0.0, 1.0]}


def test_sentiment_takes_no_list_functions_over_tokens(spark):
    lexicon = sentiment.Lexicon({"good": 1.0, "bad": -1.0, "acao": 0.25}, {"so so": 0.5, "a b": -0.5}, ("not",), ("very",), ("bit",))
    rows = [(1, None, None), (2, "AÇÃO", "not\nvery bit GOOD, ① g2od so so so so"), (3, "bad", "Öß a b good"), (4, "x", "bit not very bad")]
    scored = sentiment.scores(spark.createDataFrame(rows, "doc_id long, title string, content string"), lexicon)
    explained = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in explained and "arrays_overlap" not in explained
    got = {r["doc_id"]: (r["positive_score"], r["negative_score"], r["sentiment_terms"]) for r in scored.collect()}
    # not, very and bit before good: -0.8 * 1.4 * 0.7, each within its reach; 4 so are two phrases that share a delimiter
    assert got == {1: (0.0, 0.0, 0), 2: (0.75, 0.784, 3), 3: (1.0, 1.5, 3), 4: (1.12, 0.0, 1)}
