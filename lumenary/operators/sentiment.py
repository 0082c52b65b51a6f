"""Lexicon sentiment with negation, intensity and phrases.

Lexicons are data: tables or dicts that the caller supplies. A token's weight is changed by the
three tokens before it (negation: times -0.8) and the two before it (intensifier: times 1.4,
diminisher: times 0.7); every change that applies does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenary.functions import text

POSITIVE, NEGATIVE = 0.15, -0.15


@dataclass(frozen=True)
class Lexicon:
    """Folded words and phrases with their weights, and the words that change a weight."""

    words: dict[str, float]
    phrases: dict[str, float] = field(default_factory=dict)
    negations: tuple[str, ...] = ()
    intensifiers: tuple[str, ...] = ()
    diminishers: tuple[str, ...] = ()


def letters(title: Column, content: Column, stored: Column | None = None) -> Column:
    """Stored tokens, else the letter runs of title and content, joined by spaces."""
    runs = F.regexp_extract_all(F.lower(F.concat_ws(" ", title, content)), F.lit(text.LETTERS), F.lit(0))
    held = runs if stored is None else F.when(F.size(stored) > 0, stored).otherwise(runs)
    return F.array_join(held, " ")


def found_in(joined: Column, lexicon: Lexicon) -> Column:
    """Of ``letters``: sums ``p`` and ``n`` of the words' weights above and below zero, adjusted by
    what stands before, the number ``h`` of words, and ``f``, how often each phrase occurs.

    Tokens are folded, then left without what is no letter. Texts are worked on in Arrow batches,
    as column functions on lists go through every token for each rule.
    """
    plain, words, slice_rows = text.folder(), {w.encode(): x for w, x in lexicon.words.items()}, text.SLICE
    near = [(frozenset(w.encode() for w in held), back, factor) for held, back, factor in ((lexicon.negations, 3, -0.8), (lexicon.intensifiers, 2, 1.4), (lexicon.diminishers, 2, 0.7)) if held]
    phrases = [f" {p} ".encode() for p in lexicon.phrases]
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    dropped = bytes(c for c in range(256) if not (c == 32 or 65 <= c <= 90 or 97 <= c <= 122))

    @F.arrow_udf("struct<p: double, n: double, h: int, f: array<int>>")
    def found(texts: pa.Array) -> pa.Array:
        above, below, number, times = [], [], [], []
        for start in range(0, len(texts), slice_rows):
            for value in texts.slice(start, slice_rows).to_pylist():
                held = plain(value or "").translate(lower, dropped).split()
                p = n = 0.0
                h = 0
                for at, token in enumerate(held):
                    if token in words:
                        weight = words[token]
                        for listed, back, factor in near:
                            if not listed.isdisjoint(held[max(at - back, 0) : at]):
                                weight = weight * factor
                        if weight > 0:
                            p += weight
                        else:
                            n += weight
                        h += 1
                above.append(p)
                below.append(n)
                number.append(h)
                joined = b" " + b" ".join(held) + b" "
                times.append([joined.count(phrase) for phrase in phrases])
        columns = [pa.array(above, pa.float64()), pa.array(below, pa.float64()), pa.array(number, pa.int32()), pa.array(times, pa.list_(pa.int32()))]
        return pa.StructArray.from_arrays(columns, ["p", "n", "h", "f"])

    return found(joined)


def scores(articles: DataFrame, lexicon: Lexicon, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``keep``, positive and negative sums, score, label and numbers of terms."""
    listed = articles.select("doc_id", *keep, found_in(letters(F.col("title"), F.col("content")), lexicon).alias("r"))
    phrases = [(F.col("r.f")[k], w) for k, w in enumerate(lexicon.phrases.values())]
    extra = lambda sign: sum((n * w for n, w in phrases if w * sign > 0), F.lit(0.0))
    found = sum((n for n, _ in phrases), F.lit(0))
    sums = listed.select(
        "doc_id", *keep,
        F.round(F.col("r.p") + extra(1), 6).alias("positive_score"),
        F.round(-(F.col("r.n") + extra(-1)), 6).alias("negative_score"),
        (F.col("r.h") + found).alias("sentiment_terms"),
    )
    p, n = F.col("positive_score"), F.col("negative_score")
    scored = sums.withColumn("sentiment_score", F.round(F.coalesce(F.try_divide(p - n, p + n), F.lit(0.0)), 6))
    return scored.withColumn("sentiment_label", label(F.col("sentiment_score")))


def label(score: Column) -> Column:
    return F.when(score >= POSITIVE, "positive").when(score <= NEGATIVE, "negative").otherwise("neutral")


def rollup(scored: DataFrame, key: str | None = None) -> DataFrame:
    """Numbers of rows, mean score and labels of each group (or of all)."""
    grouped = scored.groupBy(key) if key else scored.groupBy()
    kind = lambda name: F.count_if(F.col("sentiment_label") == name).alias(name)
    return grouped.agg(
        # scores have six digits: whole millionths add up to one sum in whatever order
        F.count("*").alias("n"), F.round(F.sum(F.round(F.col("sentiment_score") * 1e6).cast("long")) / (F.count("*") * 1e6), 6).alias("mean_score"), F.sum("sentiment_terms").alias("terms"),
        kind("positive"), kind("neutral"), kind("negative"),
    )


def top_listing(rows: DataFrame, group: str, item: str, k: int, name: str) -> DataFrame:
    """The k most frequent items of each group as ``item: n; ...``, first seen first on ties.

    ``rows``: ``group, item, at`` with ``at`` the order of appearance.
    """
    counted = rows.groupBy(group, item).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "first", item)
    best = counted.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= k)
    held = F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat_ws(": ", item, F.col("n").cast("string")).alias("s")))), lambda x: x["s"])
    return best.groupBy(group).agg(F.array_join(held, "; ").alias(name))
