"""Command line: ``python -m lumenary COMMAND --data FOLDER``; prints the result as a table."""

from __future__ import annotations

import argparse
import json

from lumenary.functions.vectors import METRICS
from lumenary.session import build_session


def _update(spark, given) -> bool:
    """New articles written beside the old ones; the old folder is replaced when they are there."""
    import os
    import shutil

    from lumenary.sources import articles, rest

    stored = articles.read_articles(spark, given.articles)
    labels = spark.createDataFrame([], "id int, name string")
    held, complete = rest.update(spark, given.mode, given.endpoint, labels, stored, since=given.since, target=given.target)
    articles.write_articles(held.na.fill("", ["collected_at"]), f"{given.articles}.new")
    if os.path.isdir(given.articles):
        shutil.rmtree(given.articles)
    os.rename(f"{given.articles}.new", given.articles)
    return complete


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lumenary", description=__doc__)
    parser.add_argument("--data", required=True, help="folder of parquet tables")
    parser.add_argument("--rows", type=int, default=20)
    commands = parser.add_subparsers(dest="command", required=True)
    find = commands.add_parser("search", help="ranked documents for a query, from a stored index")
    find.add_argument("query")
    find.add_argument("--index", required=True, help="folder of the index")
    find.add_argument("--scheme", choices=("bow", "tfidf"), default="tfidf")
    find.add_argument("--metric", choices=METRICS, default="cosine")
    find.add_argument("--top-k", type=int, default=5)
    build = commands.add_parser("index", help="build the lexical index, unless it is current")
    build.add_argument("--index", required=True)
    query = commands.add_parser("query", help="any query of the catalogue by name")
    query.add_argument("name")
    commands.add_parser("list", help="names of all queries")
    commands.add_parser("profile", help="sizes, duplicates, missing fields, dates and words of the articles")
    compare = commands.add_parser("compare", help="a query's best documents by bag of words and TF-IDF and every metric")
    compare.add_argument("query")
    compare.add_argument("--top-k", type=int, default=5)
    evaluate = commands.add_parser("evaluate", help="summaries of the best documents of some queries")
    evaluate.add_argument("queries", nargs="+")
    mood = commands.add_parser("sentiment", help="mean score and labels of each category, by a lexicon")
    mood.add_argument("--lexicon", required=True, help="JSON file: words, phrases, negations, intensifiers, diminishers")
    update = commands.add_parser("update", help="new articles of a REST source into a folder of JSON lines")
    update.add_argument("mode", choices=("initial", "incremental", "since", "target"))
    update.add_argument("--endpoint", required=True)
    update.add_argument("--articles", required=True, help="folder that is read, and is written anew beside itself")
    update.add_argument("--since")
    update.add_argument("--target", type=int)
    given = parser.parse_args(arguments)

    from pyspark.sql import functions as F

    from lumenary.operators import clean, index, search, sentiment
    from lumenary.plans import catalogue
    from lumenary.sources.articles import from_documents

    if given.command == "list":
        print("\n".join(catalogue.QUERIES))
        return
    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    if given.command == "query":
        catalogue.QUERIES[given.name](spark, given.data).show(given.rows, truncate=80)
        return
    if given.command == "update":
        print("complete" if _update(spark, given) else "not complete")
        return
    articles = from_documents(spark, given.data)
    if given.command == "index":
        print("built" if index.build_lexical(spark, articles, given.index) else "current")
    elif given.command == "profile":
        clean.profile(articles).show(vertical=True)
    elif given.command == "compare":
        search.Space(articles).compared(given.query, given.top_k, ("bow", "tfidf")).orderBy("metric", "position").show(given.rows)
    elif given.command == "evaluate":
        space, lists = search.Space(articles), None
        for query in given.queries:
            best = search.top(space.scores(query), 5, positive=True).withColumn("query", F.lit(query))
            lists = best if lists is None else lists.unionByName(best)
        search.summaries(lists, articles).orderBy("query", "k").show(given.rows, truncate=80)
    elif given.command == "sentiment":
        with open(given.lexicon, encoding="utf-8") as file:
            lexicon = sentiment.Lexicon(**json.load(file))
        sentiment.rollup(sentiment.scores(articles, lexicon, ("category",)), "category").orderBy("category").show(given.rows)
    else:
        index.search_index(spark, articles, given.index, given.query, given.scheme, given.metric, given.top_k).orderBy("position").show(truncate=80)


if __name__ == "__main__":
    main()
