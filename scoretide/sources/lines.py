"""Line numbers for text inputs that Spark reads in splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoretide.operators.spread import bounded_broadcast
from scoretide.session import materialise

SPLIT = ["_file", "_block"]


def with_split(df: DataFrame) -> DataFrame:
    """Adds the file and the split start of every row."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def number_rows(df: DataFrame, out: str, per_file: bool) -> DataFrame:
    """1-based position of each row in its file, or over all files in path order.

    ``df`` comes from ``with_split``, filtered to the rows that count. Rows keep
    their order inside a split, so a position is the split's offset plus the
    distance from the split's first row; only one row per split is shuffled.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    splits = tagged.groupBy(*SPLIT).agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    # one row per split (a file's bytes over the split size), so the window is small
    order = Window.partitionBy("_file" if per_file else F.lit(0)).orderBy(*SPLIT)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    joined = tagged.join(bounded_broadcast(materialise(starts, "splits")), SPLIT)
    return joined.withColumn(out, F.col("_before") + F.col("_mid") - F.col("_first") + 1).drop(
        "_mid", "_first", "_before"
    )
