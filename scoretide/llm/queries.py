"""The queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretide.llm.common import table
from scoretide.llm.embedding import near_vectors
from scoretide.llm.exact_dedup import content_sort
from scoretide.llm.neighbours import nearest
from scoretide.llm.packing import pack
from scoretide.llm.passages import drop_repeats
from scoretide.llm.periodic import find_runs, run_report
from scoretide.llm.pieces import decode_pieces, encode_pieces
from scoretide.llm.quality import sample_quality
from scoretide.llm.secrets import scan_secrets
from scoretide.llm.simhash import near_duplicates
from scoretide.llm.toxicity import score_toxicity
from scoretide.llm.warc import archive_round_trip
from scoretide.llm.whitening import whiten


def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = content_sort(table(spark, sf, "documents", "doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return scan_secrets(table(spark, sf, "documents", "doc_id", "text"))


def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(table(spark, sf, "documents", "doc_id", "text"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    return sample_quality(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels", "doc_id", "quality"))


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return score_toxicity(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels", "doc_id", "toxic"))


def op7_warc(spark: SparkSession, sf: str) -> DataFrame:
    read = archive_round_trip(table(spark, sf, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every text, and the digest of what they decode to."""
    encoded = encode_pieces(table(spark, sf, "documents", "doc_id", "text"))
    return decode_pieces(encoded).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(table(spark, sf, "embeddings", "vec_id", "embedding", "label"))


def op10_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeats(table(spark, sf, "documents", "doc_id", "text"))


def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whiten(table(spark, sf, "embeddings", "vec_id", "embedding"))


def op12_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest(table(spark, sf, "embeddings", "vec_id", "embedding"))


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    return run_report(find_runs(table(spark, sf, "documents", "doc_id", "text"), planted=True))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_whitening": op11_whitening,
    "op12_neighbours": op12_neighbours,
    "op13_periodic_runs": op13_periodic_runs,
}
