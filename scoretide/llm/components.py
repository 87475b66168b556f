"""Connected components of links that stay distributed, and the reduction of links inside a tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import stored


def forest(left: np.ndarray, right: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes 0..n-1 as stars: fewer than ``n`` links that join the same nodes as the given ones do."""
    if len(left) < 2:
        return left, right
    low = np.arange(n)
    while True:
        least = np.minimum(low[left], low[right])
        before = low.copy()
        np.minimum.at(low, left, least)
        np.minimum.at(low, right, least)
        np.minimum.at(low, before, low)  # the old label follows its members
        low = low[low]
        if np.array_equal(low, before):
            break
    nodes = np.flatnonzero(low != np.arange(n))
    return nodes, low[nodes]


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node that can be reached.

    Large and small stars in turn until the links no longer change. Every round is written to the shared folder; what is
    known of a round on the driver are a count and a checksum.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    edges = stored(links.select(hi, lo).where("hi <> lo").distinct(), "links")
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = stored(small.unionByName(down.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    found = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
    return found[0], found[1]
