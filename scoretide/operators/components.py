"""Connected components by the smallest label, over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.session import materialise


def min_labels(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), both long: label is the smallest node that can be reached.

    Two steps in turn (Kiveris et al. 2014): larger neighbours of a node are tied to its smallest neighbour, then smaller ones are,
    with the node itself. Edges stay as many or become fewer, and end as one star per component after about log n rounds.
    A round is a table in the shared folder; the driver sees a count and a checksum of it.
    """
    def ties(far: str, near: str) -> DataFrame:
        return edges.select(F.greatest(far, near).alias("high"), F.least(far, near).alias("low")).where("high > low").distinct()

    def mark(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).first())

    edges = materialise(ties("a", "b"), "edges")
    seen = mark(edges)
    while seen[0]:
        near = edges.select(F.col("high").alias("node"), F.col("low").alias("other")).unionByName(
            edges.select(F.col("low").alias("node"), F.col("high").alias("other")))
        least = near.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label"))
        edges = near.where("other > node").join(least, "node").select("other", "label")
        edges = ties("other", "label")
        lowest = edges.groupBy("high").agg(F.min("low").alias("label"))
        tied = edges.join(lowest, "high").select(F.col("low").alias("far"), "label")
        edges = tied.unionByName(lowest.select(F.col("high").alias("far"), "label"))
        edges = materialise(ties("far", "label"), "edges")
        now = mark(edges)
        if now == seen:
            break
        seen = now
    stars = edges.select(F.col("high").alias("node"), F.col("low").alias("label"))
    return stars.unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("label")).distinct())
