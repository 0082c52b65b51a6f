"""Article tables: from JSON lines, from REST posts, and from the documents fixture."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenary.functions import text, urls
from lumenary.session import spread, table
from lumenary.sources.html import Page

ARTICLES = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "published_at", "category", "content", "url", "collected_at", "content_hash")]
    + [T.StructField("word_count", T.IntegerType())]
)
#: Labels that a site may have.
MOST_CATEGORIES = 10_000
REQUIRED = ("title", "published_at", "category", "content", "url")


def read_articles(spark: SparkSession, path: str, missing_ok: bool = True) -> DataFrame:
    """JSON lines with the articles' schema; a missing file is an empty table unless forbidden."""
    try:
        return spark.read.schema(ARTICLES).json(path)
    except AnalysisException:
        if not missing_ok:
            raise
        return spark.createDataFrame([], ARTICLES)


def write_articles(articles: DataFrame, path: str) -> None:
    articles.write.mode("overwrite").json(path)


def completed(raw: DataFrame) -> DataFrame:
    """Rows with hash and word count; columns that are missing are empty."""
    have = [F.col(c) if c in raw.columns else F.lit("").alias(c) for c in (*REQUIRED, "collected_at")]
    rest = [c for c in raw.columns if c not in ARTICLES.names]
    return raw.select(*rest, *have).withColumns(
        {"content_hash": text.content_hash("title", "content"), "word_count": text.words("content")}
    )


POST = "struct<title:struct<rendered:string>,content:struct<rendered:string>,date:string,link:string,categories:array<int>>"
_PARTS = "title string, published_at string, content string, link string, categories array<int>"


def from_posts(posts: DataFrame, categories: DataFrame, column: str = "post") -> DataFrame:
    """REST posts as articles; ``categories`` (``id, name``) is a table of labels.

    Text comes from the markup's paragraphs, one a line, or from all of it where it has none;
    scripts, styles, navigation, forms and frames are left out, and every entity is decoded. Labels
    are joined by a comma in the order of the post ("Uncategorized" where it has none).
    """
    post = F.from_json(F.col(column), POST) if dict(posts.dtypes)[column] == "string" else F.col(column)
    rows = posts.select(post.alias("p")).select("p.title.rendered", "p.date", "p.content.rendered", "p.link", "p.categories")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            titles = [" ".join("".join(Page(x or "").words).split()) for x in batch.column(0).to_pylist()]
            bodies = [Page(x or "").article()["content"] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(titles, pa.string()), batch.column(1), pa.array(bodies, pa.string()), *batch.columns[3:]],
                names=["title", "published_at", "content", "link", "categories"],
            )

    read = rows.toDF("a", "b", "c", "d", "e").mapInArrow(run, _PARTS)
    # labels by one small map: a site's categories are few, and are counted before they are held
    if categories.limit(MOST_CATEGORIES + 1).count() > MOST_CATEGORIES:
        raise ValueError(f"more than {MOST_CATEGORIES} categories")
    known = categories.agg(F.map_from_entries(F.collect_list(F.struct(F.col("id").cast("int"), "name"))).alias("__names"))
    names = F.filter(F.transform(F.coalesce("categories", F.array().cast("array<int>")), lambda k: F.col("__names")[k]), lambda x: x.isNotNull())
    raw = read.join(F.broadcast(known)).select(
        "title", "published_at", F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), F.lit("Uncategorized")).alias("category"),
        "content", urls.canonical(F.col("link")).alias("url"),
    )
    return completed(raw)


def from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents fixture as articles: ``doc_id``, a derived day and URL, and the source as category."""
    raw = spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.substring("text", 1, 80).alias("title"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")), "yyyy-MM-dd").alias("published_at"),
        F.col("source").alias("category"),
        F.col("text").alias("content"),
        F.concat(F.lit("https://news.example/"), F.col("doc_id"), F.lit("/")).alias("url"),
        "lang",
    )
    return completed(raw)
