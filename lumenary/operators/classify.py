"""Category classification: training sets, splits, models and reports."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, IDF, NGram, Normalizer, SQLTransformer, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenary.session import written

#: Hexadecimal digits of the hash that ``stratified`` counts rows by.
PLACES = 3
#: Rows that one task of a fit's round reads.
TASK_ROWS = 10_000


def training_set(rows: DataFrame, text: str, category: str, order: str, least: int = 30) -> DataFrame:
    """Rows with text and category, repeats of both dropped (first kept), categories of ``least`` rows or more."""
    fine = rows.filter(F.col(text).isNotNull() & F.col(category).isNotNull() & (F.trim(text) != ""))
    # by the text's digest, so that the exchange does not sort whole texts
    first = F.row_number().over(Window.partitionBy(F.sha2(text, 256), category).orderBy(order))
    once = fine.withColumn("__n", first).filter("__n = 1").drop("__n")
    large = once.groupBy(category).count().filter(F.col("count") >= least).select(category)
    # a list of categories, told to every task: dealt by category, a frequent one's texts would meet in one task
    return once.join(F.broadcast(large), category, "left_semi")


def stratified(rows: DataFrame, category: str, id_col: str, share: float = 0.2) -> DataFrame:
    """``part`` of every row: in each category, ``share`` of the rows (by a hash of the id) are ``test``.

    No category is sorted as a whole: rows are counted by the first ``PLACES`` bits of the hash,
    a small table says in which of these places a category's test rows end, and only rows of that
    one place are ranked.
    """
    key = F.sha2(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 256)
    held = rows.withColumns({"__key": key, "__place": F.substring(key, 1, PLACES)})
    counted = held.groupBy(category, "__place").agg(F.count("*").alias("n"))
    by_place = Window.partitionBy(category).orderBy("__place")
    cut = counted.withColumn("before", F.sum("n").over(by_place) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy(category)))
    cut = cut.withColumn("wanted", F.round(F.col("all") * share).cast("long")).select(
        F.col(category).alias("__c"), F.col("__place").alias("__p"), (F.col("wanted") - F.col("before")).alias("__room"), F.col("n").alias("__n")
    )
    told = held.join(F.broadcast(cut), F.col(category).eqNullSafe(F.col("__c")) & (F.col("__place") == F.col("__p")))
    sure = F.when(F.col("__room") >= F.col("__n"), "test").when(F.col("__room") <= 0, "train")
    told = told.withColumn("part", sure)
    # in all places but a category's one the rank changes nothing, and a place is a small share of the rows
    rank = F.row_number().over(Window.partitionBy(category, "__place").orderBy("__key", id_col))
    open_rows = told.filter("part is null").withColumn("part", F.when(rank <= F.col("__room"), "test").otherwise("train"))
    ranked = told.filter("part is not null").unionByName(open_rows)
    return ranked.select(*rows.columns, "part")


def report(pairs: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, then accuracy, macro and weighted means.

    A ratio with nothing below the line is 0.
    """
    pairs = pairs.select(F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p"))
    cells = pairs.groupBy("a", "p").agg(F.count("*").alias("n"))
    by_a = cells.groupBy(F.col("a").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("a") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    by_p = cells.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("called"))
    joined = by_a.join(by_p, "label", "full").na.fill(0, ["support", "hit", "called"])
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    each = joined.select(
        "label", ratio(F.col("hit"), F.col("called")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"), "support", "hit"
    ).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    whole = each.agg(
        F.struct(F.lit("accuracy").alias("label"), *[ratio(F.sum("hit"), total).alias(n) for n in names], total.alias("support")).alias("r1"),
        F.struct(F.lit("macro avg").alias("label"), *[F.avg(n).alias(n) for n in names], total.alias("support")).alias("r2"),
        F.struct(F.lit("weighted avg").alias("label"), *[ratio(F.sum(F.col(n) * F.col("support")), total).alias(n) for n in names], total.alias("support")).alias("r3"),
    ).select(F.explode(F.array("r1", "r2", "r3")).alias("r")).select("r.*")
    both = each.select("label", *names, "support").unionByName(whole)
    return both.select("label", *[F.round(n, 6).alias(n) for n in names], "support")


def lexical_model(text: str, category: str, n_train: int, c: float = 1.0) -> Pipeline:
    """Word 1- and 2-grams, TF-IDF and multinomial logistic regression."""
    # the smoothed idf that Spark computes lacks the one, so counts are added to their weighted form
    return Pipeline(
        stages=[
            SQLTransformer(statement=f"SELECT *, filter(regexp_extract_all(lower({text}), '[\\\\p{{L}}\\\\p{{N}}_]+', 0), x -> length(x) > 1) AS __w FROM __THIS__"),
            NGram(n=2, inputCol="__w", outputCol="__w2"),
            SQLTransformer(statement="SELECT *, concat(__w, __w2) AS __g FROM __THIS__"),
            CountVectorizer(inputCol="__g", outputCol="__tf", minDF=2.0, maxDF=0.95, vocabSize=20_000),
            IDF(inputCol="__tf", outputCol="__idf"),
            Normalizer(inputCol="__idf", outputCol="features"),
            StringIndexer(inputCol=category, outputCol="label"),
            LogisticRegression(maxIter=60, regParam=1 / (c * max(n_train, 1)), elasticNetParam=0.0, standardization=False, family="multinomial"),
        ]
    )


def dense_model(category: str, n_train: int, c: float = 1.0) -> Pipeline:
    """Standardised vectors (column ``vector``) and logistic regression."""
    return Pipeline(
        stages=[
            StandardScaler(withMean=True, withStd=True, inputCol="vector", outputCol="features"),
            StringIndexer(inputCol=category, outputCol="label"),
            LogisticRegression(maxIter=100, regParam=1 / (c * max(n_train, 1)), standardization=False, family="multinomial"),
        ]
    )


def as_vector(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("vector", array_to_vector(F.col(column).cast("array<double>")))


def fit_and_report(rows: DataFrame, pipeline: Pipeline, category: str) -> DataFrame:
    """Report of a pipeline fitted on ``part`` train over ``part`` test."""
    model = pipeline.fit(rows.filter("part = 'train'"))
    names = next(s for s in model.stages if hasattr(s, "labels")).labels
    label = F.array(*map(F.lit, names))
    called = model.transform(rows.filter("part = 'test'"))
    return report(called.withColumn("called", label[F.col("prediction").cast("int")]), category, "called")


def compare_representations(spaces: dict[str, tuple[DataFrame | None, str]], category: str, id_col: str = "doc_id", c: float = 1.0) -> DataFrame:
    """Held-out accuracy and F1 of a classifier on each representation, best weighted F1 first.

    ``spaces``: rows with ``category`` and ``value``, and whether that is a text (``"lexical"``) or
    a vector (``"dense"``). Where the rows are None, or of one category only, the representation
    has nulls and a ``note``.
    """
    out = None
    for name, (rows, kind) in spaces.items():
        note, found = "no vectors are stored", None
        if rows is not None:
            # a split reads its rows three times: what they are made of is worked out once
            held = written(rows)
            parts = stratified(held, category, id_col)
            # each round of a fit is a job, so what it costs is its tasks: as many as the rows need
            parts = parts.coalesce(max(1, -(-held.count() // TASK_ROWS), parts.sparkSession.sparkContext.defaultParallelism)).persist()
            try:
                classes = parts.select(category).distinct().limit(2).count()
                note = None if classes == 2 else "fewer than two categories"
                if classes == 2:
                    n = parts.filter("part = 'train'").count()
                    model = lexical_model("value", category, n, c) if kind == "lexical" else dense_model(category, n, c)
                    held = parts if kind == "lexical" else as_vector(parts, "value").drop("value")
                    each = {r["label"]: r for r in fit_and_report(held, model, category).filter(F.col("label").isin("accuracy", "macro avg", "weighted avg")).collect()}
                    found = (each["accuracy"]["f1"], each["macro avg"]["f1"], each["weighted avg"]["f1"], int(each["accuracy"]["support"]))
            finally:
                parts.unpersist()
        one = (name, *(found or (None,) * 4), note)
        out = [one] if out is None else [*out, one]
    spark = next((rows.sparkSession for rows, _ in spaces.values() if rows is not None), None) or SparkSession.active()
    shape = "representation string, accuracy double, macro_f1 double, weighted_f1 double, test_rows long, note string"
    return spark.createDataFrame(out or [], shape).orderBy(F.desc_nulls_last("weighted_f1"), F.desc_nulls_last("accuracy"), "representation")
