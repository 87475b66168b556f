"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.llm.common import added, over_batches, slices, stored, text_of
from scoretide.llm.toxicity import labelled

BUCKETS = 10_000
KEEP = 0.8  # share of the documents that is sampled
SEED = 17

TOKENS = re.compile(r"\w+|[^\w\s]+")
KNOWN_TOKENS = 500_000


class Grams:
    """Bucket numbers of the words and word pairs of a text."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str) -> np.ndarray:
        tokens = TOKENS.findall(text)
        if len(self.known) > KNOWN_TOKENS:
            self.known.clear()
        known = self.known
        for token in set(tokens):
            if token not in known:
                known[token] = xxhash.xxh32_intdigest(token)
        one = np.fromiter((known[t] for t in tokens), np.uint64, len(tokens))
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(32)
        return (np.concatenate([one, two]) % np.uint64(self.buckets)).astype(np.int64)


def _totals(rows: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts of ``rows``: every task sends one row per bucket at most."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").to_pylist():
                    counts += np.bincount(grams(text), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["bucket", "n"])

    found = over_batches(rows.select("text"), work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets)
    for r in found:
        out[r.bucket] = r.n
    return out


def kth_largest(df: DataFrame, column: str, k: int) -> tuple[float | int, int] | None:
    """The k-th largest value of ``column`` and how many values are above it. Bins of the range are counted and the one that
    holds it is opened, so the driver sees counts only."""
    above, lo, hi = 0, *df.agg(F.min(column), F.max(column)).first()
    if lo is None or k < 1:
        return None
    while lo < hi:
        c = F.col(column)
        span = F.least(F.floor((c - lo) / (hi / 1 - lo) * 1000), F.lit(999)) if hi / 1 - lo > 0 else F.lit(0)
        bins = df.where(c.between(lo, hi)).groupBy(span.alias("bin")).agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
        for b in sorted(bins.collect(), key=lambda b: -b.bin):
            if above + b.n >= k:
                lo, hi = b.lo, b.hi
                break
            above += b.n
    return lo, above


def sample_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    keep: float = KEEP, buckets: int = BUCKETS, seed: int = SEED,
) -> DataFrame:
    """One row per input row: the id, ``log_weight``, ``key`` and ``kept``.

    Words and word pairs are hashed into ``buckets``. The raw model counts all documents; the target model counts all
    documents with label 1 but those whose id has a CRC-32 divisible by five. A document's log weight
    is the log ratio of the two models, summed over its n-grams. With a Gumbel number added, the largest ceil(``keep`` * rows)
    keys are a sample without replacement in proportion to the weights; ``kept`` marks it. The numbers depend on seed, id and text.

    A NULL or empty text has weight 0. NULL ids and repeated rows are drawn like others; equal keys go by place in the input.
    Without target documents all weights are 0. An empty table gives an empty result. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(f"`{text_col}`").alias("text"))
    target_rows, _ = labelled(rows, labels, id_col, label_col)
    target, raw = _totals(target_rows.where("label = 1"), buckets), _totals(rows, buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)) if target.any() else np.zeros(buckets)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, weight = Grams(buckets), shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                texts, ids = part.column("text").to_pylist(), part.column("id").to_pylist()
                w = [math.fsum(weight[grams(t)].tolist()) for t in texts]
                u = [(xxhash.xxh64_intdigest(f"{i}\0{t}", seed) + 0.5) / 2**64 for i, t in zip(ids, texts)]
                keys = [a - math.log(-math.log(min(max(b, 1e-300), 1 - 1e-16))) for a, b in zip(w, u)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(w, pa.float64()), pa.array(keys, pa.float64())], names=["id", "log_weight", "key"])

    scored = stored(over_batches(rows, work, added(rows, "log_weight double, key double")).withColumn("place", F.monotonically_increasing_id()), "weights")
    wanted = math.ceil(keep * scored.count())
    found = kth_largest(scored, "key", wanted)
    if found is None:
        kept = F.lit(False)
    else:
        limit, above = found
        ties = scored.where(F.col("key") == limit).select((-F.col("place")).alias("place"))
        last = kth_largest(ties, "place", wanted - above)
        kept = (F.col("key") > limit) | ((F.col("key") == limit) & (F.col("place") <= -last[0]))
    return scored.select(F.col("id").alias(id_col), "log_weight", "key", kept.alias("kept"))
