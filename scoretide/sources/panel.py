"""Reading a raw entity-period CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretide.operators.clean import clamp_count, drop_count_columns, lead_columns, normalise_indicators
from scoretide.sources.lines import SPLIT, number_rows, with_split

# What the raw file writes for a missing cell, and the columns it carries in vain.
NA_TOKENS = ("", "R", "NA")
SKIPPED = ("CUSIP", "legacy_companyID", "domicile")
RENAMES = {"CompanyName": "name", "Ticker": "ticker", "year": "period"}
LEAD = ["name", "ticker", "issuerid", "period"]


def read_panel(
    spark: SparkSession, path: str, na_tokens: tuple[str, ...] = NA_TOKENS, skip: tuple[str, ...] = SKIPPED
) -> DataFrame:
    """All columns as text, missing tokens as NULL, with the file order as ``row_ord``.

    No schema inference: that would be a second pass, and the cells are
    normalised column by column afterwards anyway.
    """
    raw = with_split(spark.read.csv(path, header=True, enforceSchema=False))
    data = [c for c in raw.columns if c not in SPLIT and c not in skip]
    blanked = [F.when(~F.col(c).isin(*na_tokens), F.col(c)).alias(c) for c in data]
    return number_rows(raw.select(*SPLIT, *blanked), "row_ord", per_file=False).drop(*SPLIT)


def tidy_panel(raw: DataFrame, count_to_clamp: str | None = None) -> tuple[DataFrame, list[str]]:
    """Leading columns, no count columns, 0/1 indicators; also the indicators' names.

    ``count_to_clamp`` is clamped before the count columns are dropped, so it
    only matters if its name escapes that drop.
    """
    if count_to_clamp and count_to_clamp in raw.columns:
        raw = clamp_count(raw, count_to_clamp)
    df = lead_columns(drop_count_columns(raw), RENAMES, LEAD)
    indicators = [c for c in df.columns if c not in (*LEAD, "row_ord")]
    df = df.withColumn("period", F.col("period").try_cast("int"))
    return normalise_indicators(df, indicators), indicators
