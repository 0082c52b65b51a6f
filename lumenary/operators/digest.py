"""Date-scoped topical digests, recent lists and keyword alerts."""

from __future__ import annotations

import datetime
import html
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.functions import text
from lumenary.operators import search

LEXICAL, SEMANTIC, DEPTH, LIMIT, HISTORY = 0.04, 0.42, 100, 8, 500


def in_window(articles: DataFrame, end: datetime.date, frequency: str, seen: DataFrame | None = None) -> DataFrame:
    """Articles of the last day or the last seven, but those whose URL was seen."""
    start = end - datetime.timedelta(days=0 if frequency == "daily" else 6)
    held = articles.filter(F.substring("published_at", 1, 10).between(start.isoformat(), end.isoformat()))
    return held if seen is None else held.join(seen.select("url"), "url", "left_anti")


def query_terms(query: str, stopwords: list[str], everywhere: list[str]) -> list[str]:
    """Terms to search: without stopwords, and without ``everywhere`` unless nothing else is there."""
    found = [t for t in re.findall(r"[^\W\d_]+", query.casefold()) if t not in stopwords]
    kept = [t for t in found if t not in everywhere] if len(found) > 1 else found
    if not (kept or found):
        raise ValueError("the query has no words to search for")
    return kept or found


def select(candidates: DataFrame, lexical: DataFrame, semantic: DataFrame, named: list[str] = (), limit: int = LIMIT) -> DataFrame:
    """Articles of a digest, best first: ``position, doc_id, score``.

    ``candidates``: ``doc_id, title, category, published_at``; the rankings (``doc_id, score``)
    are taken after filtering. With ``named`` terms only articles whose title or category has
    one stay. Fused ranks; ties go to the later day, then the lower id.
    """
    kept = candidates
    if named:
        where = F.lower(F.concat_ws(" ", "title", "category"))
        kept = kept.filter(F.exists(F.array(*map(F.lit, named)), lambda t: where.contains(t)))
    scored = kept.join(lexical.withColumnRenamed("score", "l"), "doc_id", "left").join(semantic.withColumnRenamed("score", "s"), "doc_id", "left").na.fill(0.0, ["l", "s"])
    fine = scored.filter((F.col("l") >= LEXICAL) | (F.col("s") >= SEMANTIC))
    ranks = [search.top(fine.select("doc_id", F.col(c).alias("score")), DEPTH, positive=True, digits=9) for c in "ls"]
    fused = search.fuse(ranks, DEPTH).join(kept.select("doc_id", "published_at"), "doc_id")
    best = fused.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), F.desc("published_at"), "doc_id").limit(limit)
    order = Window.orderBy(F.desc("score"), F.desc("published_at"), "doc_id")  # of ``limit`` rows
    return best.select(F.row_number().over(order).cast("int").alias("position"), "doc_id", "score")


def recent(articles: DataFrame, category: str | None = None, page: int = 0, size: int = 20) -> DataFrame:
    """One page of articles, latest first."""
    held = articles if category is None else articles.filter(F.col("category") == category)
    return held.orderBy(F.desc("published_at"), F.desc("doc_id")).offset(page * size).limit(size)


def alerts(articles: DataFrame, rules: DataFrame, seen: DataFrame, first: int = 3) -> DataFrame:
    """New matches of each rule: ``term, new, latest`` (ids of the latest few, joined by commas).

    ``rules``: ``term``, the users' distinct words, which meet in one row; ``seen``: ``term, url``.
    A term matches inside title and category, case aside.
    """
    where = F.lower(F.concat_ws(" ", "title", "category"))
    # one pass over the articles with all users' words at hand; an article makes a row for each that it has
    held = rules.agg(F.collect_set("term").alias("__terms"))
    hit = F.filter("__terms", lambda term: F.col("__where").contains(F.lower(term)))
    marked = articles.withColumn("__where", where).join(held)
    found = marked.withColumn("term", F.explode(hit)).drop("__terms", "__where").join(seen, ["term", "url"], "left_anti")
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("published_at"), F.desc("doc_id")))
    counts = found.groupBy("term").agg(F.count("*").alias("new"))
    top = found.withColumn("k", place).filter(F.col("k") <= first)
    held = F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string"))
    return counts.join(top.groupBy("term").agg(F.array_join(held, ",").alias("latest")), "term")


def remembered(seen: Column, new: Column, most: int = HISTORY) -> Column:
    """Delivered URLs after a delivery: the last ``most``, repeats dropped."""
    both = F.array_distinct(F.concat(seen, new))
    return F.when(F.size(both) > most, F.slice(both, -most, most)).otherwise(both)


def due(active: bool, now: datetime.datetime, hour: str, weekday: int, frequency: str, last_attempt: str, snapshot: datetime.date) -> bool:
    """Whether a digest is to be sent: active, its time is past, its weekday, not tried today, data of today."""
    on_time = now.strftime("%H:%M") >= hour and (frequency == "daily" or now.weekday() == weekday)
    return active and on_time and last_attempt[:10] != now.date().isoformat() and snapshot == now.date()


def checked_highlights(highlights: list[dict], n_sources: int, most: int = 4) -> list[dict]:
    """Highlights with valid sources (distinct, rising, 1 to n), fields cleaned; others are dropped."""
    out = []
    for item in highlights:
        sources = sorted({s for s in item.get("sources", []) if isinstance(s, int) and 1 <= s <= n_sources})
        if sources:
            clean = {k: " ".join(re.sub("[*_`]", "", str(item.get(k, ""))).split()) for k in ("title", "text")}
            out.append(clean | {"sources": sources})
    return out[:most]


def as_text(report: dict) -> str:
    lines = [f"{report['area']} ({report['start']} - {report['end']})", "", report["summary"], ""]
    for item in report["highlights"]:
        lines += [f"* {item['title']}: {item['text']} [{', '.join(map(str, item['sources']))}]"]
    lines += ["", report["closing"], ""]
    return "\n".join(lines + [f"{k}. {a['title']} {a['url']}" for k, a in enumerate(report["articles"], 1)])


def as_html(report: dict) -> str:
    """Markup in any field is escaped; only http and https addresses become links."""
    safe = html.escape
    items = "".join(f"<li><b>{safe(h['title'])}</b> {safe(h['text'])} {safe(str(h['sources']))}</li>" for h in report["highlights"])

    def link(article: dict) -> str:
        name, url = safe(article["title"]), str(article["url"])
        return f'<a href="{safe(url)}">{name}</a>' if re.match(r"https?://", url) else name

    sources = "".join(f"<li>{link(a)}</li>" for a in report["articles"])
    return (
        f"<h1>{safe(report['area'])}</h1><p>{safe(report['start'])} - {safe(report['end'])}</p><p>{safe(report['summary'])}</p>"
        f"<ul>{items}</ul><p>{safe(report['closing'])}</p><ol>{sources}</ol>"
    )


def snippets(articles: DataFrame, urls: DataFrame, size: int = 1800) -> DataFrame:
    """``url, snippet`` of selected URLs: the text's beginning, else the title."""
    body = F.substring(text.clean("content"), 1, size)
    return articles.join(urls, "url", "left_semi").select("url", F.coalesce(F.nullif(body, F.lit("")), F.col("title")).alias("snippet"))


def delivered(state: DataFrame, new: DataFrame, most: int = HISTORY) -> DataFrame:
    """Delivery state after a delivery: ``user, seen`` with the last ``most`` URLs of each user.

    ``state``: ``user, seen`` (array of URLs, oldest first); ``new``: ``user, url, position``.
    Users without a delivery keep their state, new users get one.
    """
    held = F.transform(F.array_sort(F.collect_list(F.struct("position", "url"))), lambda x: x["url"])
    added = new.groupBy("user").agg(held.alias("__new"))
    none = F.array().cast("array<string>")
    both = state.join(added, "user", "full")
    return both.select("user", remembered(F.coalesce("seen", none), F.coalesce("__new", none), most).alias("seen"))


def unseen(articles: DataFrame, state: DataFrame, user: str) -> DataFrame:
    """Articles whose URL is not in a user's delivery state."""
    return articles.join(state.filter(F.col("user") == user).select(F.explode("seen").alias("url")), "url", "left_anti")


_EMAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")


def check_email(address: str) -> str:
    """The address without blanks around it; an error where it cannot be one."""
    address = (address or "").strip()
    if not _EMAIL.fullmatch(address):
        raise ValueError("the e-mail address is not valid")
    return address


def check_form(form: dict, areas: list[str]) -> dict:
    """A subscription's fields: known area, daily or weekly, ``HH:MM``, a weekday from 0 to 6, an address."""
    area, frequency, hour = (str(form.get(k, "")).strip() for k in ("area", "frequency", "hour"))
    if area not in areas:
        raise ValueError(f"the area is none of {', '.join(areas)}")
    if frequency not in ("daily", "weekly"):
        raise ValueError("the frequency is daily or weekly")
    if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", hour):
        raise ValueError("the hour is HH:MM")
    weekday = int(form.get("weekday", 0))
    if not 0 <= weekday <= 6:
        raise ValueError("the weekday is 0 to 6")
    return {"area": area, "frequency": frequency, "hour": hour, "weekday": weekday, "email": check_email(form.get("email", ""))}
