"""A paged REST source of posts, as a Spark data source and as an ingest with a completeness check.

Pages are the partitions, so they are fetched side by side and a lost task fetches its page again.
A page that cannot be had is a row with an ``error`` instead of posts, and an ingest says whether
everything that the source has was read.
"""

from __future__ import annotations

import datetime
import json
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenary.functions import urls
from lumenary.operators import clean
from lumenary.sources.articles import from_posts

#: Posts of a page, and the most pages that one ingest reads.
PAGE, MOST_PAGES = 100, 200
SHAPE = "page int, post string, total long, error string"


def page_url(endpoint: str, page: int, per_page: int = PAGE, after: str | None = None, before: str | None = None) -> str:
    """Address of a page of posts, oldest instant exclusive; days are whole days."""
    asked = {"page": page, "per_page": per_page, "after": after and f"{after}T23:59:59", "before": before and f"{before}T00:00:00"}
    return f"{endpoint}?{urllib.parse.urlencode({k: v for k, v in asked.items() if v})}"


def fetch(url: str, timeout: float = 30) -> tuple[list[dict], int]:
    """Posts of a page, and how many there are on all pages."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return json.load(answer), int(answer.headers.get("X-WP-Total", 0))


@dataclass
class _Page(InputPartition):
    number: int

    def __post_init__(self) -> None:
        super().__init__(self.number)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoint, self.timeout = options["endpoint"], float(options.get("timeout", 30))
        self.per_page, self.pages = int(options.get("per_page", PAGE)), int(options.get("pages", 1))
        self.first = int(options.get("first", 1))
        self.after, self.before = options.get("after"), options.get("before")

    def partitions(self) -> list[_Page]:
        return [_Page(self.first + k) for k in range(self.pages)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        try:
            posts, total = fetch(page_url(self.endpoint, partition.number, self.per_page, self.after, self.before), self.timeout)
        except (OSError, ValueError) as error:
            yield partition.number, None, None, str(error) or type(error).__name__
            return
        for post in posts:
            yield partition.number, json.dumps(post), total, None


class PostsSource(DataSource):
    """``spark.read.format("posts").options(endpoint=..., after="2024-01-31", pages=3)``."""

    @classmethod
    def name(cls) -> str:
        return "posts"

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PostsSource)


@dataclass(frozen=True)
class Collected:
    """New articles of an ingest; ``complete``: all that the source has was read without a failure."""

    articles: DataFrame
    scanned: int
    total: int
    failed: int

    @property
    def complete(self) -> bool:
        return not self.failed and self.scanned == self.total


def collect(
    spark: SparkSession, endpoint: str, categories: DataFrame, known: DataFrame | None = None, *,
    after: str | None = None, before: str | None = None, per_page: int = PAGE, most_pages: int = MOST_PAGES,
) -> Collected:
    """Articles after a day, or before one, whose URL is not in ``known`` (``url``), each URL once.

    The first page says how many there are, which says how many pages are read, ``most_pages`` at
    most; beyond that the ingest is not complete. Posts are read once, into the checkpoint folder
    where there is one, else into the session's cache.
    """
    register(spark)
    try:
        _, total = fetch(page_url(endpoint, 1, per_page, after, before))
    except (OSError, ValueError):
        total = 0
    pages = min(max(1, -(-total // per_page)), most_pages)
    options = {"endpoint": endpoint, "per_page": per_page, "pages": pages, "after": after, "before": before}
    rows = spark.read.format("posts").options(**{k: v for k, v in options.items() if v is not None}).load()
    rows = rows.checkpoint() if spark.sparkContext.getCheckpointDir() else rows.persist()
    counts = rows.agg(F.count("post").alias("scanned"), F.max("total").alias("total"), F.count("error").alias("failed")).first()
    found = from_posts(rows.filter("post IS NOT NULL").select("post"), categories).dropDuplicates(["url"])
    if known is not None:
        found = found.join(known.select(urls.canonical(F.col("url")).alias("url")).distinct(), "url", "left_anti")
    return Collected(found, counts["scanned"], counts["total"] or 0, counts["failed"])


def collect_until(
    spark: SparkSession, endpoint: str, categories: DataFrame, stored: DataFrame, target: int, private: list[str] = (), *,
    per_page: int = PAGE, most_rounds: int = 20, pages_at_once: int = 10,
) -> DataFrame:
    """``stored`` with older articles until ``target`` public ones are there, or the source has no more.

    Each round reads what is before the day after the oldest that is known, a few pages at a time.
    """
    held = stored
    for _ in range(most_rounds):
        if _public(held, private) >= target:
            break
        oldest = held.agg(F.min(F.substring("published_at", 1, 10))).first()[0]
        day = datetime.date.fromisoformat(oldest) + datetime.timedelta(days=1) if oldest else None
        more = collect(spark, endpoint, categories, held, before=day and day.isoformat(), per_page=per_page, most_pages=pages_at_once)
        new = more.articles.select(*[c for c in held.columns if c in more.articles.columns])
        if new.isEmpty():
            break
        held = held.unionByName(new, allowMissingColumns=True)
        held = held.checkpoint() if spark.sparkContext.getCheckpointDir() else held
    return held


def _public(articles: DataFrame, private: list[str]) -> int:
    ordered = articles.withColumn("doc_id", F.xxhash64("url"))
    return clean.public_count(ordered, list(private)).first()[0]


def update(
    spark: SparkSession, mode: str, endpoint: str, categories: DataFrame, stored: DataFrame, *,
    since: str | None = None, target: int | None = None, private: list[str] = (), per_page: int = PAGE, pages: dict[str, int] | None = None,
) -> tuple[DataFrame, bool]:
    """Stored articles after an update, and whether it read all that it was to read.

    ``initial`` and ``incremental`` read the latest 50 and 10 pages; ``since`` all after a day, by
    default the day before the newest that is stored, so that late ones come, too; ``target`` older
    ones until so many are public. An article that is read again takes the place of the stored one.
    """
    most = {"initial": 50, "incremental": 10} | (pages or {})
    if mode == "target":
        if target is None:
            raise ValueError("a target is needed")
        held = collect_until(spark, endpoint, categories, stored, target, private, per_page=per_page)
        return held, _public(held, private) >= target
    if mode == "since":
        newest = stored.agg(F.max(F.substring("published_at", 1, 10))).first()[0]
        if since is None and newest is None:
            raise ValueError("nothing is stored, so a day is needed")
        day = since or (datetime.date.fromisoformat(newest) - datetime.timedelta(days=1)).isoformat()
        got = collect(spark, endpoint, categories, after=day, per_page=per_page)
    elif mode in most:
        got = collect(spark, endpoint, categories, per_page=per_page, most_pages=most[mode])
    else:
        raise ValueError("modes are initial, incremental, since and target")
    columns = [c for c in stored.columns if c in got.articles.columns]
    merged = clean.upsert(
        stored.select(*columns).withColumn("__at", F.col("published_at")), got.articles.select(*columns).withColumn("__at", F.col("published_at")), "url", "__at"
    )
    return merged.select(*columns), got.complete if mode == "since" else not got.failed
