import pytest
from pyspark.sql import functions as F

from lumenary.operators import index, search
from lumenary.sources.articles import completed


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, f"title {k}", f"word{k % 4} common thing{k % 3} common") for k in range(12)]
    return completed(spark.createDataFrame(rows, "doc_id long, title string, content string"))


def test_index_is_reused_searched_and_refused(spark, corpus, tmp_path):
    folder = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index.open_index(spark, corpus, folder)
    assert index.build_lexical(spark, corpus, folder) is True
    assert index.build_lexical(spark, corpus, folder) is False
    for scheme in ("bow", "tfidf"):
        for metric in ("cosine", "euclid", "manhattan"):
            stored = [(r["position"], r["doc_id"], r["score"]) for r in index.search_index(spark, corpus, folder, "word1 thing2", scheme, metric, 4).orderBy("position").collect()]
            direct = [tuple(r) for r in search.search(spark, corpus, "word1 thing2", scheme, metric, 4, positive=False).select("position", "doc_id", "score").collect()]
            assert stored == direct, (scheme, metric)
    with pytest.raises(index.StaleIndex, match="documents"):
        index.open_index(spark, corpus.filter("doc_id > 0"), folder)
    changed = corpus.withColumn("content_hash", F.when(F.col("doc_id") == 3, "x").otherwise(F.col("content_hash")))
    with pytest.raises(index.StaleIndex, match="another"):
        index.open_index(spark, changed, folder)
    with pytest.raises(ValueError):
        index.build_lexical(spark, corpus.limit(2), folder)


def test_vectors_must_be_those_of_the_documents(spark, corpus, tmp_path):
    folder = str(tmp_path / "index")
    good = corpus.select("doc_id", F.array(F.col("doc_id").cast("double"), F.lit(1.0)).alias("embedding"))
    assert index.build_dense(spark, corpus, good, folder, "word2vec") is True
    assert index.open_index(spark, corpus, folder, "word2vec").count() == 12
    for bad in (good.filter("doc_id < 5"), good.withColumn("doc_id", F.col("doc_id") + 1), good.withColumn("embedding", F.array(F.lit(float("nan"))))):
        with pytest.raises(index.StaleIndex):
            index.check_vectors(corpus, bad)
    with pytest.raises(ValueError):
        search.search(spark, corpus, "  ")
