"""Incremental ingestion: an idempotent streaming upsert, and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenary.operators.clean import upsert


def latest(previous: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """State after a batch: one row for each key, the greatest ``order`` wins, so replays change nothing."""
    rows = previous.unionByName(incoming)
    value = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(value, F.struct(order, *[c for c in rows.columns if c not in (key, order)])).alias("v")).select("v.*")


def stream_upsert(
    spark: SparkSession, source: str, schema, target: str, checkpoint: str, key: str, order: str, buckets: int = 64
) -> None:
    """Read all files that are new in ``source`` and fold them into ``target``.

    The state is dealt to ``buckets`` by a hash of the key, and a batch rewrites only those that it
    touches, in a folder of its own. A pointer of a new version then names every bucket's folder,
    so a failed batch leaves the state before it and is replayed; what neither of the last two
    versions names is removed.
    """

    def fold(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        version, held = _pointer(spark, target)
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
        batch = batch.persist()
        try:
            touched = [row[0] for row in batch.select(bucket).distinct().collect()]
            if not touched:
                return
            paths = [held[b] for b in touched if b in held]
            before = spark.read.schema(batch.schema).parquet(*paths) if paths else spark.createDataFrame([], batch.schema)
            place = f"{target}/state-{version + 1:09d}"
            new = latest(before, batch, key, order).withColumn("__bucket", bucket)
            new.repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(place)
        finally:
            batch.unpersist()
        now = held | {b: f"{place}/__bucket={b}" for b in touched}
        spark.createDataFrame(list(now.items()), POINTER).coalesce(1).write.mode("overwrite").json(f"{target}/pointers/{version + 1:09d}")
        named = {path.rsplit("/", 2)[1] for path in (*now.values(), *held.values())}
        for name in _folders(spark, target):
            if name.startswith("state-") and name not in named:
                _remove(spark, f"{target}/{name}")
        for name in _folders(spark, f"{target}/pointers"):
            if int(name) < version:
                _remove(spark, f"{target}/pointers/{name}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


POINTER = "bucket int, path string"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _folders(spark: SparkSession, folder: str) -> list[str]:
    """Names of the folders in a folder; none where it is not there."""
    files, path = _files(spark, folder)
    return sorted(f.getPath().getName() for f in files.listStatus(path) if f.isDirectory()) if files.exists(path) else []


def _remove(spark: SparkSession, folder: str) -> None:
    files, path = _files(spark, folder)
    files.delete(path, True)


def _pointer(spark: SparkSession, target: str) -> tuple[int, dict[int, str]]:
    """Number of the last finished version, 0 where there is none, and its buckets' folders."""
    for name in reversed(_folders(spark, f"{target}/pointers")):
        files, done = _files(spark, f"{target}/pointers/{name}/_SUCCESS")
        if files.exists(done):
            return int(name), dict(spark.read.schema(POINTER).json(f"{target}/pointers/{name}").collect())
    return 0, {}


def state(spark: SparkSession, target: str) -> DataFrame:
    """All buckets of the last finished version."""
    version, held = _pointer(spark, target)
    if not version:
        raise FileNotFoundError(f"there is no state in {target}")
    return spark.read.parquet(*held.values())


def daily_counts(events: DataFrame, at: str, kind: str, late: str = "1 day", size: str = "1 day") -> DataFrame:
    """Counts and sums by tumbling window and kind; in a stream, rows later than ``late`` are not waited for."""
    held = events.withWatermark(at, late) if events.isStreaming else events
    return held.groupBy(F.window(at, size).alias("w"), kind).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.to_date("w.start").alias("day"), kind, "n", "total"
    )


__all__ = ["daily_counts", "latest", "state", "stream_upsert", "upsert"]
