"""Tables between steps, result CSVs and file size reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def write_scores(scores: DataFrame, path: str) -> None:
    """Score CSV ordered by ticker and year; the order runs over the part files."""
    scores.orderBy("ticker", "year").write.csv(path, header=True)


def write_item_params(params: DataFrame, path: str) -> None:
    params.orderBy("year", "item_col").write.csv(path, header=True)


def file_sizes(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """Number of files and their total size, from the listing alone: no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = listed.select("path", "length").filter(F.col("path").endswith(suffix))
    return files.agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"),
                     (F.sum("length") / 1e9).alias("gigabytes"))
