"""Reports and published results: CSV files, a summary of sections, and exports that are checked first."""

from __future__ import annotations

import json
import os

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.operators import clean
from lumenary.operators.index import StaleIndex


def write_csv(rows: DataFrame, folder: str) -> None:
    """One CSV file with a header. For reports, whose rows a person reads; their order is kept."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(folder)


def merge_section(path: str, section: str, content: dict) -> dict:
    """A JSON summary with one section replaced and the others as they were; all of it is returned.

    The file is replaced at once, so a reader never sees half of it. What cannot be read as a
    summary is an error, not a new summary.
    """
    held = {}
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        if not isinstance(held, dict):
            raise ValueError(f"{path} is no summary")
    held[section] = content
    with open(f"{path}.new", "w", encoding="utf-8") as file:
        json.dump(held, file, ensure_ascii=False, indent=2, sort_keys=True)
    os.replace(f"{path}.new", path)
    return held


def save_model(model: MLWritable, folder: str) -> None:
    model.write().overwrite().save(folder)


def load_model(folder: str, kind=PipelineModel):
    """A stored model; ``kind`` is its class."""
    return kind.load(folder)


def differing(catalog: DataFrame, source: DataFrame, columns: tuple[str, ...] = ("url", "content_hash")) -> DataFrame:
    """One row: documents that only one of two tables has, and those whose columns are not the same."""
    a = catalog.select("doc_id", F.lit(True).alias("a"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = source.select("doc_id", F.lit(True).alias("b"), *[F.col(c).alias(f"b_{c}") for c in columns])
    both = a.join(b, "doc_id", "full")
    unlike = [F.count_if(F.col("a") & F.col("b") & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(f"other_{c}") for c in columns]
    return both.agg(F.count_if(F.col("b").isNull()).alias("only_catalog"), F.count_if(F.col("a").isNull()).alias("only_source"), *unlike)


def export_results(
    spark: SparkSession, articles: DataFrame, catalog: DataFrame, points: DataFrame, measures: DataFrame, folder: str, digits: int = 5
) -> dict:
    """Published results: points with their documents' titles and URLs, and measures; refused where tables do not fit.

    ``catalog``: ``doc_id, url, content_hash`` of what is published; ``points``: ``doc_id, cluster,
    x, y, z``. Every point must be of a published document whose URL and text are still the same.
    """
    row = differing(catalog, articles).first()
    if row["only_catalog"] or row["other_url"] or row["other_content_hash"]:
        raise StaleIndex(f"the catalog is not of these articles: {row.asDict()}")
    placed = points.join(catalog.select("doc_id", "url"), "doc_id", "left").join(articles.select("doc_id", "title"), "doc_id", "left")
    counts = points.agg(F.count("*").alias("points"), F.count_distinct("doc_id").alias("documents"), F.count_distinct("cluster").alias("clusters")).first()
    if counts["points"] != counts["documents"] or placed.filter("url IS NULL").limit(1).count():
        raise StaleIndex("the points are not one for each published document")
    placed.select("doc_id", "cluster", "title", "url", *[F.round(c, digits).alias(c) for c in "xyz"]).write.mode("overwrite").parquet(f"{folder}/points")
    write_csv(measures, f"{folder}/measures")
    fingerprint = clean.block_fingerprint(articles.select("doc_id", "content_hash"), "doc_id").first()[0]
    manifest = counts.asDict() | {"fingerprint": fingerprint}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return manifest
