"""Upserts, deduplication, profiles and fingerprints of article tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(previous: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last value, at the first position.

    ``order`` is each table's position column; incoming rows come after all previous ones. One
    aggregation, so a key with many versions is combined before the exchange.
    """
    value = F.struct(*[c for c in previous.columns if c not in (key, order)])
    rows = previous.select(key, F.struct(F.lit(0).alias("side"), F.col(order).alias("at")).alias("__at"), value.alias("__row")).unionByName(
        incoming.select(key, F.struct(F.lit(1).alias("side"), F.col(order).alias("at")).alias("__at"), value.alias("__row"))
    )
    merged = rows.groupBy(key).agg(F.max_by("__row", "__at").alias("row"), F.min("__at").alias("first"))
    return merged.select(key, "row.*", F.col("first.side").alias("first_side"), F.col("first.at").alias("first_at"))


def keep_first(articles: DataFrame, order: str, least_words: int = 20) -> DataFrame:
    """Articles of ``least_words`` or more, the first of each content hash."""
    rank = F.row_number().over(Window.partitionBy("content_hash").orderBy(order))
    return articles.filter(F.col("word_count") >= least_words).withColumn("__n", rank).filter("__n = 1").drop("__n")


def removal_causes(articles: DataFrame, least_words: int = 20) -> DataFrame:
    """How many rows are short, repeat an earlier long one, or are kept; short ones first."""
    long = F.col("word_count") >= least_words
    found = articles.agg(
        F.count("*").alias("total"), F.count_if(~long).alias("short"),
        F.count_if(long).alias("long"), F.count_distinct(F.when(long, F.col("content_hash"))).alias("kept"),
    )
    return found.select("total", "short", (F.col("long") - F.col("kept")).alias("duplicate"), "kept")


def profile(articles: DataFrame) -> DataFrame:
    """One row: sizes, duplicates, missing fields, dates and word statistics.

    Distinct values are counted apart from the rest, each over its own column only, and the median
    from the number of rows of each word count, so no row is expanded for every aggregate.
    """
    empty = lambda c: F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "")
    by_words = articles.groupBy("word_count").agg(F.count("*").alias("n"))
    word = F.col("word_count")
    words = by_words.agg(
        F.sum("n").alias("total"), F.coalesce(F.sum(F.when(word < 20, F.col("n"))), F.lit(0)).alias("short"),
        F.min(word).alias("min_words"), F.max(word).alias("max_words"),
        F.round(F.try_divide(F.sum(word * F.col("n")), F.sum(F.when(word.isNotNull(), F.col("n")))), 2).alias("mean_words"),
        F.percentile(word, 0.5, F.col("n")).alias("median_words"),
    )
    fields = articles.agg(
        *[empty(c).alias(f"missing_{c}") for c in ("title", "published_at", "category", "content", "url")],
        F.min("published_at").alias("first_day"), F.max("published_at").alias("last_day"),
    )
    distinct = lambda c: articles.select(c).distinct().agg(F.count(c).alias(f"distinct_{c}"))
    row = words.join(fields).join(distinct("url")).join(distinct("content_hash"))
    total = F.coalesce("total", F.lit(0))
    return row.select(
        total.alias("total"), F.col("distinct_url").alias("distinct_urls"), (total - F.col("distinct_url")).alias("duplicate_urls"),
        (total - F.col("distinct_content_hash")).alias("duplicate_hashes"), "short",
        *[f"missing_{c}" for c in ("title", "published_at", "category", "content", "url")],
        "first_day", "last_day", "min_words", "max_words", "mean_words", "median_words",
    )


def counts_by(df: DataFrame, key: Column | str, name: str, count: str = "n") -> DataFrame:
    """Rows for each value of ``key``."""
    return df.groupBy((F.col(key) if isinstance(key, str) else key).alias(name)).agg(F.count("*").alias(count))


def new_and_updated(previous: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """How many distinct incoming keys are new, and how many were there."""
    keys = incoming.select(key).distinct().join(previous.select(key).distinct().withColumn("old", F.lit(True)), key, "left")
    return keys.agg(F.count_if(F.col("old").isNull()).alias("new"), F.count_if("old").alias("updated"))


def public_count(articles: DataFrame, private: list[str], least_words: int = 20) -> DataFrame:
    """Articles left after the length filter, deduplication and private first categories."""
    kept = keep_first(articles, "doc_id", least_words)
    first = F.coalesce(F.trim(F.split_part("category", F.lit(","), F.lit(1))), F.lit(""))
    return kept.filter(~first.isin(private)).agg(F.count("*").alias("public"))


def fingerprint(rows: DataFrame, order: str, value: str = "content_hash") -> DataFrame:
    """SHA-256 of all values in row order, joined by newlines; null is empty.

    The digest is of one string by definition, so the values (65 bytes a row) meet in one task.
    ``block_fingerprint`` is the one for large tables.
    """
    held = F.array_sort(F.collect_list(F.struct(order, F.coalesce(value, F.lit("")).alias("v"))))
    return rows.agg(F.sha2(F.array_join(F.transform(held, lambda x: x["v"]), "\n"), 256).alias("fingerprint"))


def block_fingerprint(rows: DataFrame, order: str, value: str = "content_hash", size: int = 1000) -> DataFrame:
    """A tree of such digests: of ``size`` consecutive orders, of as many blocks, and of those."""
    level = rows.select(F.col(order).alias("o"), F.coalesce(value, F.lit("")).alias("v"))
    for _ in range(3):
        level = level.groupBy(F.floor(F.col("o") / size).alias("b")).agg(F.array_sort(F.collect_list(F.struct("o", "v"))).alias("h"))
        level = level.select(F.col("b").alias("o"), F.sha2(F.array_join(F.transform("h", lambda x: x["v"]), "\n"), 256).alias("v"))
    held = F.array_sort(F.collect_list(F.struct("o", "v")))
    return level.agg(F.sha2(F.array_join(F.transform(held, lambda x: x["v"]), "\n"), 256).alias("fingerprint"))


def periods(df: DataFrame, instant: Column, days: int = 7) -> DataFrame:
    """``period`` of every row: ``recent`` from ``days`` days up to the last, else ``previous``.

    Rows without an instant are in neither. The last day is one aggregate; no row, no period.
    """
    last = df.agg(F.max(instant).alias("__last"))
    cut = F.date_sub(F.to_date("__last"), days - 1)
    dated = df.withColumn("__at", instant).join(F.broadcast(last))
    return dated.withColumn(
        "period", F.when(F.to_date("__at") >= cut, "recent").when(F.col("__at").isNotNull(), "previous")
    ).drop("__at", "__last")


def crawl_plan(pages: DataFrame, since: Column, stop_after: int = 2) -> DataFrame:
    """Which listing pages a crawl since a day reads, in order of ``page``.

    ``pages``: ``page, last_day, signature``; pages are numbered without gaps. A page is old when
    its last day is not after ``since``. Reading ends with the second old page in a row (complete),
    or at a page without links or with an earlier page's signature (not complete). Each page meets
    the ``stop_after`` - 1 before it, and where reading ends is one least number.
    """
    old = F.coalesce(F.col("last_day") <= since, F.lit(True))
    first = pages.groupBy("signature").agg(F.min("page").alias("__first"))
    marked = pages.withColumn("old", old).join(first, "signature", "left")
    broken = F.col("signature").isNull() | (F.coalesce("__first", "page") < F.col("page"))
    marked = marked.select("page", "old", broken.alias("__broken"))
    near = marked.filter("old").select(F.explode(F.sequence(F.col("page"), F.col("page") + stop_after - 1)).alias("page"))
    run = near.groupBy("page").agg(F.count("*").alias("__run"))
    ends = marked.join(run, "page", "left").withColumn("__enough", F.coalesce(F.col("__run") >= stop_after, F.lit(False)))
    last = ends.filter(F.col("__enough") | F.col("__broken")).agg(F.min("page").alias("__last"))
    held = ends.join(F.broadcast(last)).filter(F.col("__last").isNull() | (F.col("page") <= F.col("__last")))
    return held.select("page", "old", (F.col("__enough") & ~F.col("__broken")).alias("complete"))
