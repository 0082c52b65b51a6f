"""Evaluation of clusterings, and clusterings themselves."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenary.functions import vectors
from lumenary.session import written


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Rows by columns, zero-filled; a column for each of ``values``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(f"{column}_{v}") for v in values])


def majority(df: DataFrame, cluster: str, category: str) -> DataFrame:
    """Each cluster's size, majority category and purity; ties go to the lower category."""
    pairs = df.groupBy(cluster, category).agg(F.count("*").alias("n"))
    ranked = pairs.withColumn("k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("n"), category)))
    sizes = pairs.groupBy(cluster).agg(F.sum("n").alias("size"))
    top = ranked.filter("k = 1").select(cluster, F.col(category).alias("majority"), F.col("n").alias("correct"))
    return sizes.join(top, cluster).select(cluster, "size", "majority", "correct", F.round(F.col("correct") / F.col("size"), 6).alias("purity"))


def purity(by_cluster: DataFrame) -> DataFrame:
    """Global purity and the distinct majority categories."""
    return by_cluster.agg(
        F.round(F.sum("correct") / F.sum("size"), 6).alias("purity"),
        F.array_join(F.array_sort(F.collect_set(F.col("majority").cast("string"))), ",").alias("categories"),
        F.sum("size").alias("rows"),
    )


def confusion(df: DataFrame, by_cluster: DataFrame, cluster: str, category: str) -> DataFrame:
    """True category by the category of its cluster."""
    named = by_cluster.select(cluster, F.col("majority").alias("predicted"))
    counted = df.groupBy(cluster, category).agg(F.count("*").alias("n"))
    return counted.join(named, cluster).groupBy(F.col(category).alias("actual"), "predicted").agg(F.sum("n").alias("n"))


def sums(df: DataFrame, cluster: str, vector: str, size: int) -> DataFrame:
    """``cluster, n, s``: sum of unit vectors. One row for each cluster."""
    u = df.select(cluster, vectors.unit(vectors.doubles(F.col(vector))).alias("u"))
    return u.groupBy(cluster).agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("u")[k]) for k in range(size)]).alias("s"))


def cohesion(df: DataFrame, cluster: str, vector: str, size: int) -> DataFrame:
    """Mean cosine of a cluster's pairs: (|sum u|^2 - sum |u|^2) / n(n-1); 1 for one row."""
    u = df.select(cluster, vectors.unit(vectors.doubles(F.col(vector))).alias("u"))
    got = u.groupBy(cluster).agg(
        F.count("*").alias("n"), F.sum(vectors.dot(F.col("u"), F.col("u"))).alias("own"), F.array(*[F.sum(F.col("u")[k]) for k in range(size)]).alias("s")
    )
    pairs = (vectors.dot(F.col("s"), F.col("s")) - F.col("own")) / (F.col("n") * (F.col("n") - 1))
    return got.select(cluster, F.col("n").alias("size"), F.round(F.when(F.col("n") < 2, 1.0).otherwise(pairs), 6).alias("cohesion"))


def centroid_distances(df: DataFrame, cluster: str, vector: str, size: int) -> DataFrame:
    """Cosine distance of every two centroids, in [0, 2]; k rows joined with k rows."""
    mean = df.select(cluster, vectors.doubles(F.col(vector)).alias("v")).groupBy(cluster).agg(F.array(*vectors.mean_vector(F.col("v"), size)).alias("c"))
    a, b = (mean.select(F.col(cluster).alias(f"{x}"), F.col("c").alias(f"c{x}")) for x in ("a", "b"))
    distance = F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - vectors.relevance(F.col("ca"), F.col("cb"), "cosine")))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(distance, 6).alias("distance"))


def silhouette(df: DataFrame, cluster: str, vector: str, size: int) -> DataFrame:
    """Mean cosine silhouette, from each cluster's sum of unit vectors instead of pairs.

    The mean distance of u to a cluster is 1 - u.s/n. The clusters' sums (k rows) go to every task.
    A cluster of one row counts 0, as does a clustering of one cluster.
    """
    totals = sums(df, cluster, vector, size).agg(F.collect_list(F.struct(F.col(cluster).alias("c"), "n", "s")).alias("all"))
    u = vectors.unit(vectors.doubles(F.col(vector)))
    rows = df.select(F.col(cluster).alias("c"), u.alias("u")).join(F.broadcast(totals))
    own = F.filter("all", lambda t: t["c"] == F.col("c"))[0]
    inside = (own["n"] - vectors.dot(F.col("u"), own["s"]) - (1 - vectors.dot(F.col("u"), F.col("u")))) / (own["n"] - 1)
    outside = F.array_min(F.transform(F.filter("all", lambda t: t["c"] != F.col("c")), lambda t: 1 - vectors.dot(F.col("u"), t["s"]) / t["n"]))
    both = rows.select(F.when(own["n"] > 1, inside).alias("a"), outside.alias("b"))
    return both.agg(F.round(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))), 6).alias("silhouette"))


#: Vectors that one task of a k-means round reads.
TASK_ROWS = 10_000


def best_kmeans(df: DataFrame, vector: str, k: int, seeds: int = 10, seed: int = 42):
    """k-means of the least cost over several seeds: the model and its assignments.

    The seeds are fitted side by side on one cached input, as each alone is many short jobs.
    """
    held = df.withColumn("__features", array_to_vector(vectors.doubles(F.col(vector))))
    # each round is a job, so what it costs is its tasks: as many as the vectors need, not as the tables before had
    rows = held.select("__features").repartition(max(1, -(-df.count() // TASK_ROWS))).persist()
    try:
        rows.count()
        with ThreadPoolExecutor(min(seeds, 8)) as pool:
            fit = lambda i: KMeans(k=k, seed=seed + i, featuresCol="__features", predictionCol="cluster", maxIter=20).fit(rows)
            models = list(pool.map(fit, range(seeds)))
    finally:
        rows.unpersist()
    model = min(models, key=lambda m: m.summary.trainingCost)
    return model, model.transform(held).drop("__features")


def principal(df: DataFrame, vector: str, id_col: str, k: int = 3) -> tuple[DataFrame, list[float]]:
    """Coordinates on the first k centred components (sign free), and their shares of variance."""
    rows = df.withColumn("__raw", array_to_vector(vectors.doubles(F.col(vector))))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__raw", outputCol="__centred").fit(rows).transform(rows)
    model = PCA(k=k, inputCol="__centred", outputCol="__pc").fit(centred)
    out = model.transform(centred).select(id_col, vector_to_array("__pc").alias("xyz"))
    names = "xyz"[:k]
    return out.select(id_col, *[F.col("xyz")[i].alias(n) for i, n in enumerate(names)]), list(model.explainedVariance.toArray())


def top_terms(weights: DataFrame, clusters: DataFrame, cluster: str, sizes: DataFrame, k: int = 8) -> DataFrame:
    """The k heaviest terms of each cluster's mean weights, and a name of the first three."""
    summed = weights.join(clusters, "doc_id").groupBy(cluster, "term").agg(F.sum("weight").alias("w"))
    mean = summed.join(F.broadcast(sizes), cluster).withColumn("mean", F.round(F.col("w") / F.col("n"), 6))
    ranked = mean.withColumn("k", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("mean"), "term"))).filter(F.col("k") <= k)
    held = F.transform(F.array_sort(F.collect_list(F.struct("k", "term"))), lambda x: x["term"])
    return ranked.groupBy(cluster).agg(held.alias("t")).select(
        cluster, F.array_join("t", "; ").alias("terms"), F.array_join(F.slice("t", 1, 3), " / ").alias("name")
    )


def similar_pairs(df: DataFrame, vector: str, id_col: str, least: float, block_rows: int = 2000) -> DataFrame:
    """``a, b, cosine`` of all pairs (a < b) from ``least`` up.

    Every pair is looked at, block against block as matrix products, so the work is that of the
    square by definition. A block is one row, moved once; tasks then read the partitions that they
    compare from where those were written, so what is exchanged grows with the rows only. For near
    duplicates in large tables use an index instead.
    """
    blocks = max(1, -(-df.count() // block_rows))  # of bounded size, so a task's matrix is, too
    # at most four blocks for each partition on average, and a task for each two partitions
    parts = max(-(-blocks // 4), min(blocks, 2 * round(df.sparkSession.sparkContext.defaultParallelism ** 0.5)))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vectors.doubles(F.col(vector)).alias("v")).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    held = written(rows.repartition(parts, "k").groupBy("k").agg(F.collect_list(F.struct("id", "v")).alias("l")).select("k", F.col("l.id").alias("id"), F.col("l.v").alias("v")))
    other = held.select(F.col("k").alias("o"), F.col("id").alias("id2"), F.col("v").alias("v2"))

    def unit(lists: pa.Array, n: int) -> np.ndarray:
        x = lists.flatten().flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                at, to = (one.column(n).flatten().to_numpy() for n in ("id", "id2"))
                like = unit(one.column("v"), len(at)) @ unit(one.column("v2"), len(to)).T
                hit = (like >= least) & ((at[:, None] < to[None, :]) if one.column("k")[0] == one.column("o")[0] else (at[:, None] != to[None, :]))
                r, c = np.nonzero(hit)
                i, j, value = np.minimum(at[r], to[c]), np.maximum(at[r], to[c]), like[r, c]
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(value, pa.float64())], names=["a", "b", "cosine"])

    return held.hint("shuffle_replicate_nl").join(other, F.col("k") <= F.col("o")).mapInArrow(compare, "a long, b long, cosine double")


def compare_k(df: DataFrame, vector: str, category: str, size: int, ks: tuple[int, ...] = (9, 12, 13), seeds: int = 3) -> DataFrame:
    """Silhouette and purity of k-means for several k, best silhouette first."""
    return compare_representations({"vectors": (df, vector, size)}, category, ks, seeds).drop("representation")


def compare_representations(
    spaces: dict[str, tuple[DataFrame, str, int]], category: str, ks: tuple[int, ...] = (9, 12, 13), seeds: int = 3
) -> DataFrame:
    """``representation, k, silhouette, purity, ...`` of k-means, best silhouette and then purity first.

    ``spaces``: for each representation its rows, vector column and number of dimensions.
    """
    out = None
    for name, (df, vector, size) in spaces.items():
        for k in ks:
            _, found = best_kmeans(df, vector, k, seeds)
            one = silhouette(found, "cluster", vector, size).join(purity(majority(found, "cluster", category)))
            one = one.withColumn("k", F.lit(k)).withColumn("representation", F.lit(name))
            out = one if out is None else out.unionByName(one)
    return out.orderBy(F.desc("silhouette"), F.desc("purity"), "representation", "k")


def check_matrix(df: DataFrame, vector: str, k: int) -> int:
    """Number of dimensions of vectors that can be clustered and drawn: three or more, finite, more rows than k."""
    v = F.col(vector)
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    row = df.agg(F.count("*").alias("n"), F.count_if(~fine).alias("odd"), F.min(F.size(v)).alias("least"), F.max(F.size(v)).alias("most")).first()
    if row["odd"] or row["least"] != row["most"] or (row["most"] or 0) < 3:
        raise ValueError("vectors must be finite, of one length and of three numbers at least")
    if not 2 <= k < row["n"]:
        raise ValueError(f"k must be at least 2 and below the {row['n']} rows")
    return row["most"]


@dataclass(frozen=True)
class Drawing:
    """A clustering with what a picture and its legend need.

    ``points``: id, cluster, category and x, y, z; ``legend``: a row for each cluster with size,
    majority category, purity, cohesion and, where weights were given, terms and a name;
    ``measures``: one row with silhouette, purity, k and the three axes' shares of variance.
    """

    points: DataFrame
    legend: DataFrame
    measures: DataFrame
    model: KMeansModel


def drawing(
    df: DataFrame, vector: str, category: str, k: int, *, id_col: str = "doc_id", weights: DataFrame | None = None, seeds: int = 10, digits: int = 5
) -> Drawing:
    """Clusters of a representation, their legend and principal coordinates; an empty cluster is an error.

    ``weights``: ``doc_id, term, weight`` that clusters are named by.
    """
    size = check_matrix(df, vector, k)
    model, found = best_kmeans(df, vector, k, seeds)
    by = majority(found, "cluster", category)
    if by.count() != k:
        raise ValueError("a cluster is empty")
    legend = by.join(cohesion(found, "cluster", vector, size).drop("size"), "cluster")
    if weights is not None:
        sizes = by.select("cluster", F.col("size").alias("n"))
        legend = legend.join(top_terms(weights, found.select(F.col(id_col).alias("doc_id"), "cluster"), "cluster", sizes), "cluster", "left")
    at, shares = principal(df, vector, id_col)
    axes = [F.round(c, digits).alias(c) for c in "xyz"]
    points = found.select(id_col, "cluster", category).join(at, id_col).select(id_col, "cluster", category, *axes)
    measures = silhouette(found, "cluster", vector, size).join(purity(by)).select(
        "silhouette", "purity", "rows", F.lit(k).alias("k"), *[F.lit(round(float(share), 6)).alias(f"share_{c}") for c, share in zip("xyz", shares)]
    )
    return Drawing(points, legend, measures, model)


def check_drawing(drawn: Drawing, compared: DataFrame, representation: str, room: float = 1e-6) -> None:
    """Refuse a drawing whose measures are not those of a comparison, or whose points are not its rows."""
    one = drawn.measures.first()
    row = compared.filter((F.col("representation") == representation) & (F.col("k") == one["k"])).first()
    if row is None or abs(row["silhouette"] - one["silhouette"]) > room or abs(row["purity"] - one["purity"]) > room:
        raise ValueError("the drawing and the comparison are not of the same clustering")
    if drawn.points.count() != one["rows"]:
        raise ValueError("the drawing has not a point for each row")
