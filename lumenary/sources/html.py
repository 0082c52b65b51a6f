"""Articles and links from raw HTML, with the standard library's parser."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenary.functions import urls

#: Elements without an end tag, and elements whose text is no content.
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_DROPPED = frozenset("script style nav form iframe".split())
_TITLES = (("h1", None), ("meta", "og:title"), ("title", None))


class Page(HTMLParser):
    """What an article needs of a page: titles, paragraphs, all text, JSON-LD, times and links."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.stack: list[str] = []
        self.titles: dict[tuple, str] = {}
        self.paragraphs: list[str] = []
        self.words: list[str] = []
        self.linked: list[str] = []
        self.scripts: list[str] = []
        self.times: list[str] = []
        self.categories: list[str] = []
        self._open: dict[str, list[str]] = {}
        self._json = False
        self.feed(source)
        self.close()
        for name in list(self._open):
            self._end(name)

    def handle_starttag(self, tag: str, attrs) -> None:
        own = {k: v or "" for k, v in attrs}
        if tag == "p" and "p" in self._open:
            self._end("p")
        if tag in ("h1", "title", "p"):
            self._open.setdefault(tag, [])
        if tag == "a" and own.get("href"):
            self.linked.append(own["href"])
            if "category" in own.get("rel", ""):
                self._open.setdefault("category", [])
        if tag == "time" and own.get("datetime"):
            self.times.append(own["datetime"])
        if tag == "meta":
            name = own.get("property") or own.get("name")
            if name == "og:title" and own.get("content", "").strip():
                self.titles.setdefault(("meta", name), " ".join(own["content"].split()))
            if name == "article:section" and own.get("content", "").strip():
                self.categories.append(own["content"].strip())
        if tag == "script":
            self._json = own.get("type") == "application/ld+json"
            self.scripts += [""] * self._json
        if tag not in _EMPTY:
            self.stack.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        self._end("category" if tag == "a" else tag)

    def _end(self, tag: str) -> None:
        if tag not in self._open:
            return
        text = " ".join("".join(self._open.pop(tag)).split())
        if text and tag == "p":
            self.paragraphs.append(text)
        elif text and tag == "category":
            self.categories.append(text)
        elif text:
            self.titles.setdefault((tag, None), text)

    def handle_data(self, data: str) -> None:
        if self.stack and self.stack[-1] == "script":
            if self._json:
                self.scripts[-1] += data
            return
        dropped = not _DROPPED.isdisjoint(self.stack)
        for name, parts in self._open.items():
            if not (name == "p" and dropped):
                parts.append(data)
        if not dropped and "title" not in self.stack:
            self.words.append(data)

    def json_value(self, keys: tuple[str, ...]) -> str | None:
        """First value of a key in the JSON-LD blocks, searched from the last nested part back."""
        for block in self.scripts:
            try:
                waiting = [json.loads(block)]
            except ValueError:
                continue
            while waiting:
                here = waiting.pop()
                if isinstance(here, dict):
                    for key in keys:
                        if value := here.get(key):
                            return str(value[0] if isinstance(value, list) else value)
                    waiting += here.values()
                elif isinstance(here, list):
                    waiting += here
        return None

    def article(self) -> dict[str, str | None]:
        return {
            "title": next((self.titles[key] for key in _TITLES if key in self.titles), None),
            "content": "\n".join(self.paragraphs) or " ".join("".join(self.words).split()),
            "published_at": self.json_value(("datePublished", "dateModified")) or next(iter(self.times), None),
            "category": self.json_value(("articleSection",)) or next(iter(self.categories), None),
        }


#: Bytes of markup that are held as Python strings at once, beyond one page.
MOST_BYTES = 2_000_000


def _bounded(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of pages of a bounded size; what is made of a run goes on before the next."""
    for rows in batches:
        at = size = 0
        for k, n in enumerate(pc.binary_length(rows.column(column)).to_pylist()):
            if k > at and size + (n or 0) > MOST_BYTES:
                yield rows.slice(at, k - at)
                at, size = k, 0
            size += n or 0
        if at < rows.num_rows or not rows.num_rows:
            yield rows.slice(at)


_FIELDS = ("title", "content", "published_at", "category")


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``keep``, title, content, published_at, category and ``error`` (``no title``) of raw pages.

    A page without a title is an error row. A null page has neither.
    """
    names = ", ".join(f"{pages.schema[c].name} {pages.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, len(keep)):
            found = [Page(source or "").article() for source in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([f[n] for f in found], pa.string()) for n in _FIELDS]
            error = pa.array([None if f["title"] else "no title" for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns, error], names=[*keep, *_FIELDS, "error"])

    shape = f"{names}, title string, content string, published_at string, category string, error string"
    return pages.select(*keep, html_col).mapInArrow(run, shape)


def links(pages: DataFrame, own_host: str | None = None) -> DataFrame:
    """``page_id, url, link, at``: links of each page, canonical, each once at its first place.

    With ``own_host`` only links to articles of that host.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, 2):
            out = []
            for page, url, source in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for at, href in enumerate(Page(source or "").linked):
                    try:
                        out.append((page, url, urldefrag(urljoin(url or "", href.strip()))[0], at))
                    except ValueError:
                        continue
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, kinds)], names=["page_id", "url", "link", "at"]
            )

    found = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, link string, at int")
    found = found.filter(F.col("link").rlike("^https?://")).withColumn("link", urls.canonical(F.col("link")))
    if own_host is not None:
        found = found.filter(urls.is_article(F.col("link"), own_host))
    return found.groupBy("page_id", "url", "link").agg(F.min("at").alias("at"))
