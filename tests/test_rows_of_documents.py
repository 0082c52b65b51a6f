"""What stays inside a document is worked out in its row, without an exchange."""

import os

import pyarrow as pa
import pytest

from lumenary.functions import text, vectors
from lumenary.operators import classify, cluster, extract, search
from lumenary.plans import catalogue
from lumenary.sources import html
from tests.test_operators import ENTITIES, TOKENS

DATA = os.environ.get("FIXTURES", "/root/testdata/sf0.001")
FIXTURES = pytest.mark.skipif(not os.path.isdir(DATA), reason="the fixture tables are not here")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@FIXTURES
@pytest.mark.parametrize("name", ["relation_triples", "sentence_map"])
def test_extraction_exchanges_nothing(spark, name):
    found = plan(catalogue.QUERIES[name](spark, DATA))
    assert "Aggregate" not in found and "Join" not in found and "Generate" not in found


def test_documents_and_flat_tables_give_the_same(spark):
    tokens, entities = spark.createDataFrame(TOKENS, extract.TOKENS), spark.createDataFrame(ENTITIES, extract.ENTITIES)
    rows = extract.gathered(tokens, entities)
    assert sorted(extract.sentences_of(rows).collect()) == sorted(extract.sentences(tokens).collect())
    assert sorted(extract.mentions_of(rows).collect()) == sorted(extract.mentions(tokens, entities).collect())
    circle = [(1, 0, i, (i + 1) % 3, "x", "NOUN", "a", "t") for i in range(3)]
    with pytest.raises(Exception, match="circle"):
        extract.triples(spark.createDataFrame(circle, extract.TOKENS), entities).collect()


@FIXTURES
@pytest.mark.parametrize("name", ["word2vec_search_cosine", "word2vec_search_euclid", "word2vec_search_manhattan"])
def test_word_vectors_exchange_no_tokens(spark, name):
    found = plan(catalogue.QUERIES[name](spark, DATA))
    assert "Generate" not in found and "explode" not in found


def test_scores_of_one_reading_equal_those_of_postings(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a"), (3, "zzz"), (4, None), (5, "b c c d d")], "doc_id long, content string")
    space = search.Space(docs)
    space.terms = search.vocabulary(space.tf, min_df=1)
    asked = [("b d unknown d", method, metric) for method in ("bow", "tfidf") for metric in vectors.METRICS]
    got = {r["doc_id"]: r for r in space.scored(asked).collect()}
    for k, (query, method, metric) in enumerate(asked):
        postings = search.bow(space.tf, space.terms) if method == "bow" else search.normalised(search.tfidf(space.tf, space.terms, 5))
        known = search.query_weights(spark, query, space.terms, 5, method)
        want = {r["doc_id"]: r["score"] for r in search.lexical_scores(postings, known, metric).collect()}
        assert {d: r[f"s{k}"] for d, r in got.items() if r[f"s{k}"] is not None} == pytest.approx(want)


def test_pages_are_cut_by_their_bytes():
    pages = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(["x" * 1_500_000, None, "y" * 900_000, "z" * 5_000_000, ""])], names=["page_id", "html"])
    cut = list(html._bounded([pages], 1))
    assert [c.column(0).to_pylist() for c in cut] == [[0, 1], [2], [3], [4]]


@FIXTURES
def test_lemmas_exchange_no_tokens(spark):
    assert "Generate" not in plan(catalogue.QUERIES["enriched_articles"](spark, DATA))


def test_texts_are_not_dealt_by_category(spark):
    rows = spark.createDataFrame([(k, f"t{k}", "A") for k in range(40)], "id long, t string, c string")
    held = classify.stratified(classify.training_set(rows, "t", "c", "id", least=2), "c", "id")
    assert plan(held).count("strategy=broadcast") >= 2
    assert sorted(r["part"] for r in held.collect()) == ["test"] * 8 + ["train"] * 32


@FIXTURES
@pytest.mark.parametrize("name", ["search_index_export", "cluster_top_terms"])
def test_lengths_exchange_no_postings(spark, name):
    found = plan(catalogue.QUERIES[name](spark, DATA))
    assert "Window [sqrt" not in found and "_w0" not in found.split("MapInArrow")[-1] and found.count("Generate") == 0


def test_postings_equal_those_by_exchange(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a"), (3, "zzz"), (4, None), (5, "b c c d d")], "doc_id long, content string")
    space = search.Space(docs)
    terms = search.vocabulary(space.tf, min_df=2)
    want = {(r["doc_id"], r["term"]): r["weight"] for r in search.normalised(search.tfidf(space.tf, terms, 5)).collect()}
    got = {(r["doc_id"], r["term"]): r["weight"] for r in search.postings(docs, text.terms("content"), terms, 5).collect()}
    assert got == pytest.approx(want) and len(got) == 6


def test_kmeans_rounds_have_the_tasks_that_their_vectors_need(spark, monkeypatch):
    seen, count = [], cluster.KMeans.fit
    monkeypatch.setattr(cluster.KMeans, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or count(self, rows))
    df = spark.createDataFrame([(k, [float(k % 3), 1.0, 0.0]) for k in range(60)], "vec_id long, v array<double>").repartition(37)
    cluster.best_kmeans(df, "v", 3, seeds=2)
    assert seen == [1, 1]


def test_rollup_counts_once_and_ranks_what_is_left(spark, monkeypatch):
    words = [(d, s, f"r{(d * 7 + s) % 3}", f"i{(d * s) % 29:02}") for d in range(60) for s in range(9)]
    rows = spark.createDataFrame(words, "doc_id long, sent int, relation string, item string").repartition(5)
    found = extract.rollup(rows, "relation", extract.F.col("item"), 4, ["doc_id", "sent"])
    explained = found._jdf.queryExecution().executedPlan().toString()
    final = explained.split("Final Plan")[0] if "Final Plan" in explained else explained
    assert final.count("hashpartitioning") == 2 and "Join" not in final  # items once, and groups once
    want = {}
    for d, s, r, i in words:
        n, at = want.setdefault(r, {}).get(i, (0, (d, s)))
        want[r][i] = (n + 1, min(at, (d, s)))
    for row in found.collect():
        items = want[row["relation"]]
        top = sorted(items, key=lambda i: (-items[i][0], items[i][1], i))[:4]
        assert (row["mentions"], row["distinct_items"]) == (sum(n for n, _ in items.values()), len(items))
        assert row["top"] == "; ".join(f"{i}: {items[i][0]}" for i in top)


def test_pairs_move_each_block_once(spark):
    x = [[float((k * 37 + d * 11) % 23 - 11) for d in range(4)] for k in range(90)]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = cluster.similar_pairs(df, "embedding", "vec_id", 0.6, block_rows=8)
    held = plan(found)
    assert "Generate" not in held and "CoGroup" not in held and "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    u = [[a / sum(b * b for b in v) ** 0.5 for a in v] for v in x]
    want = {(i, j) for i in range(90) for j in range(i + 1, 90) if sum(p * q for p, q in zip(u[i], u[j])) >= 0.6}
    got = [(r["a"], r["b"]) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert cluster.similar_pairs(df.limit(0), "embedding", "vec_id", 0.6).count() == 0


def test_vocabulary_counts_terms_by_runs_of_rows(spark):
    docs = spark.createDataFrame([(1, "a b b c"), (2, "a a"), (3, "zzz"), (4, None), (5, "b c c d d"), (6, "")], "doc_id long, content string").repartition(3)
    tokens = text.terms("content")
    found = search.vocabulary_of(docs, tokens, min_df=1)
    assert "Generate" not in plan(found) and "MapInArrow" in plan(found)
    assert found.collect() == search.vocabulary(search.counts(docs, tokens), min_df=1).collect()
    assert found.dtypes == search.vocabulary(search.counts(docs, tokens), min_df=1).dtypes
    assert search.vocabulary_of(docs.limit(0), tokens).collect() == []


@FIXTURES
def test_word_model_leaves_stored_vectors_where_they_are(spark):
    from lumenary.plans import retrieval

    found = retrieval._space(spark, DATA).model._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in found


def test_comparison_works_out_its_rows_once_and_fits_in_few_tasks(spark, monkeypatch):
    calls, tasks = [], []
    monkeypatch.setattr(classify, "written", lambda df: calls.append(df) or df)
    fit = classify.fit_and_report
    monkeypatch.setattr(classify, "fit_and_report", lambda rows, *a: tasks.append(rows.rdd.getNumPartitions()) or fit(rows, *a))
    df = spark.createDataFrame([(k, "ab"[k % 2], [float(k % 2), 1.0, k / 60]) for k in range(60)], "doc_id long, lang string, value array<double>").repartition(37)
    row = classify.compare_representations({"x": (df, "dense")}, "lang").first()
    assert len(calls) == 1 and tasks[0] <= 4 and row["accuracy"] == 1.0 and row["test_rows"] == 12
