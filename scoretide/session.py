"""Session defaults and the shared folder that intermediate tables go to."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the jobs rely on: skewed join keys are split at run time, small
# shuffle partitions are merged, and timestamps mean the same everywhere.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

# The normal functions make generated methods of more than 8,000 bytes, which the
# JVM leaves uncompiled unless told otherwise; set this for executors too.
JVM_OPTIONS = "-XX:-DontCompileHugeMethods"


def local_session(cores: str = "*", memory: str = "8g", name: str = "scoretide", folder: str | None = None) -> SparkSession:
    """A session for tests and single-machine runs. ``folder`` is where intermediate tables go."""
    threads = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.driver.extraJavaOptions", JVM_OPTIONS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(threads))
    )
    if folder:
        builder = builder.config("spark.checkpoint.dir", folder)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir`` if the cluster names one.

    A machine-local folder is made only in local mode, where one process does
    all the work; anywhere else a missing setting is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="scoretide-")
    spark.sparkContext.setCheckpointDir(made)
    return shared_dir(spark)


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, survives the loss of any executor, and leaves a
    table whose size Spark knows when it picks join strategies.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, in buckets of ``key``: joins on it leave its rows where they are, in every job
    and after the loss of any executor."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)


class Parts:
    """A table that grows by whole parts in the shared folder and is read back in one scan."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.base, self.paths, self.schema = spark, fresh_path(spark, label), [], None

    def add(self, df: DataFrame) -> None:
        path = f"{self.base}/{len(self.paths)}"
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = df.schema

    def all(self) -> DataFrame | None:
        return self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else None


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="scoretide-code-"), "scoretide_code")
    shutil.make_archive(archive, "zip", root, "scoretide")
    spark.sparkContext.addPyFile(archive + ".zip")
    _shipped.add(app)
