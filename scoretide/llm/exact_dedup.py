"""Exact dedup by a content sort, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoretide.llm.common import row_struct, stored, text_of, without_white

# A text is hot when it holds more than one HOT_SHARE-th of all rows, so there are fewer than HOT_SHARE hot texts.
HOT_SHARE = 1024

# Splitters are sampled from so many leading characters; the digest breaks their ties.
SPLITTER_CHARS = 32


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rows: bool = False) -> DataFrame:
    """One row per input row: the id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` and, with ``keep_rows``, the
    input row as a struct ``row``.

    Two texts are equal when they are the same without ASCII white space. The row with the most code points in its
    original text stays, then the one with the smallest id (NULL ids last), then the first in the input.

    The normalised texts are written once. Sampled splitters range-partition them; each range is sorted on the whole text
    by Spark's external sort, which puts equal texts side by side, and a window tells neighbours apart by full comparison.
    A text that holds more than 1/1024 of all rows would fill one range. Such texts are reduced in place to one row per
    task and text before any shuffle, compared in full there, and their rows look their group up in that table of
    fewer than 1,024 texts.

    NULL and empty texts, and texts of white space only, are equal to each other. An empty table gives an empty result.
    Repeated rows are members like any other; one of them stays. Other columns of the input are left alone; names cannot
    clash, because they are only carried inside ``row``.
    """
    text = text_of(f"`{text_col}`")
    body = row_struct(docs) if keep_rows else without_white(text).alias("norm")
    rows = stored(docs.select(
        F.col(f"`{id_col}`").alias("id"), F.length(text).alias("chars"), F.monotonically_increasing_id().alias("place"),
        F.left(without_white(text), F.lit(SPLITTER_CHARS)).alias("lead"), F.xxhash64(without_white(text)).alias("digest"), body,
    ), "norm")
    norm = without_white(text_of(f"row.`{text_col}`")) if keep_rows else F.col("norm")
    out = ["id", "keep_id", "group_size", "kept", "text_sha256", *(["row"] if keep_rows else [])]

    total = rows.count()
    hot = rows.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") * HOT_SHARE > total).select("digest")
    hot = F.broadcast(stored(hot, "hot"))
    cold = _sorted_groups(rows.join(hot, "digest", "left_anti"), norm, out)
    return cold.unionByName(_hot_groups(rows.join(hot, "digest", "left_semi"), norm, out)).withColumnRenamed("id", id_col)


def _sorted_groups(rows: DataFrame, norm: Column, out: list[str]) -> DataFrame:
    ranged = rows.repartitionByRange("lead", "digest").withColumn("norm", norm)
    equal = Window.partitionBy("lead", "digest", "norm").orderBy(F.desc("chars"), F.asc_nulls_last("id"), F.asc("place"))
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return ranged.select(
        "*", F.first("id").over(equal).alias("keep_id"), F.count("*").over(whole).alias("group_size"),
        (F.row_number().over(equal) == 1).alias("kept"),
    ).withColumn("text_sha256", F.sha2("norm", 256)).select(*out)


def _hot_groups(rows: DataFrame, norm: Column, out: list[str]) -> DataFrame:
    order = F.struct((-F.col("chars")).alias("chars"), F.col("id").isNull().alias("lost"), "id", "place")
    heads = rows.withColumn("norm", norm).groupBy("norm").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    heads = heads.select(_digest(F.col("norm")), "best", "group_size")
    return rows.withColumn("norm", norm).withColumn("text_sha256", _digest(F.col("norm"))).join(F.broadcast(heads), "text_sha256").select(
        "*", F.col("best.id").alias("keep_id"), (F.col("place") == F.col("best.place")).alias("kept"),
    ).select(*out)


def _digest(norm: Column) -> Column:
    """Never NULL, so that the join on it adds no filter below."""
    return F.coalesce(F.sha2(norm, 256), F.lit("")).alias("text_sha256")
