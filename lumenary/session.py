"""Session factory and table access shared by the operators."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(app: str = "lumenary", cores: str | int = "*", **conf: str) -> SparkSession:
    """Local session with UTC time and adaptive execution; ``conf`` overrides any setting."""
    parallel = str(os.cpu_count() if cores == "*" else cores)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": parallel,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark's readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where its files are split into fewer tasks than there are.

    For tables whose rows cost much more to work on than to move. A table of more splits than
    cores, so any large one, stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if 0 < splits < cores else df


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where none is set a local session (tests) takes a temporary folder; on a cluster, whose
    machines would not see it, that is an error.
    """
    context = spark.sparkContext
    held = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not held:
        if not context.master.startswith("local") or "cluster" in context.master:
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = tempfile.mkdtemp(prefix="checkpoints-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(held)
    return held.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut where the session has a checkpoint folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            return df
        context.setCheckpointDir(folder)
    return df.checkpoint()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless their path has it already.

    A local session's workers get the package's folder; a cluster's executors get a copy of the
    package as a zip file, once for each application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if root in map(os.path.abspath, os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    context = spark.sparkContext
    if context.master.startswith("local") and "cluster" not in context.master:
        held = context.environment.get("PYTHONPATH", "")
        if root not in held.split(os.pathsep):
            context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held]))
    elif not getattr(context, "_lumenary_shipped", False):
        import shutil

        copy = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "lumenary"), "zip", root, "lumenary")
        context.addPyFile(copy)
        context._lumenary_shipped = True
