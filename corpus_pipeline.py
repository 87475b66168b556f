"""From raw documents to packed training windows, in stages that each write and reread their documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretide.llm.common import stored, table
from scoretide.llm.exact_dedup import content_sort
from scoretide.llm.packing import pack
from scoretide.llm.secrets import scan_secrets
from scoretide.llm.simhash import near_duplicates
from scoretide.llm.toxicity import score_toxicity

# Near copies share 0.8 of their five-word shingles, counted exactly. Fingerprints of such pairs differ in about ten bits and
# hardly ever in more than 26, within which pairs are candidates.
SIMILARITY, RADIUS = 0.8, 26


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. NULL and empty texts are scored like others."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    return score_toxicity(docs, labels, keep_rows=True).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return content_sort(docs, keep_rows=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies."""
    return near_duplicates(docs, radius=RADIUS, similarity=SIMILARITY, keep_rows=True).where("kept").select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by the name of their kind in brackets and ``n_chars`` counted anew. Texts
    without a secret stay as they are, NULL ones too."""
    found = scan_secrets(docs, keep_rows=True)
    changed = F.col("spans") != ""
    text = F.when(changed, F.col("masked")).otherwise(F.col("row.text"))
    chars = F.when(changed, F.length("masked").cast("long")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": chars}
    return found.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4,096 tokens, with their ids."""
    return pack(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", mask_secrets),
    ("packing", pack_windows),
]

# Fitted models, fingerprint links and tokens are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-').lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
