"""Cleaning a raw entity-period table: names, values, universe, overrides, duplicates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoretide.functions.values import at_least_one, clamp_binary, indicator_value, logical_to_int


def drop_count_columns(df: DataFrame, word: str = "num") -> DataFrame:
    """Drop every column whose name contains ``word``, whatever its case."""
    return df.select([c for c in df.columns if word.lower() not in c.lower()])


def lead_columns(df: DataFrame, renames: dict[str, str], lead: list[str]) -> DataFrame:
    """Rename columns and put the ``lead`` ones first."""
    named = df.withColumnsRenamed(renames)
    return named.select(*lead, *[c for c in named.columns if c not in lead])


def clamp_count(df: DataFrame, column: str) -> DataFrame:
    """One count column to 0/1."""
    return df.withColumn(column, at_least_one(F.col(column)))


def normalise_indicators(df: DataFrame, indicators: list[str]) -> DataFrame:
    """Indicator columns of any input type as nullable 0/1 integers."""
    types = dict(df.dtypes)
    exprs = {}
    for c in indicators:
        if types[c] == "string":
            exprs[c] = indicator_value(F.col(c))
        elif types[c] == "boolean":
            exprs[c] = logical_to_int(F.col(c))
        else:
            exprs[c] = clamp_binary(F.col(c).try_cast("int"))
    return df.withColumns(exprs)


def restrict_universe(df: DataFrame, cutoff: int, key: str = "ticker", period: str = "period") -> DataFrame:
    """Keep the keys seen up to ``cutoff``; a missing key counts as a key."""
    seen = df.filter(F.col(period) <= cutoff).select(F.col(key).alias("_seen")).distinct()
    return df.join(seen, F.col(key).eqNullSafe(F.col("_seen")), "left_semi")


@dataclass(frozen=True)
class Override:
    """Rows whose ``column`` is one of ``values`` get the key ``new_key``."""

    column: str
    values: tuple[str, ...]
    new_key: str


def apply_overrides(df: DataFrame, rules: list[Override], key: str = "ticker") -> DataFrame:
    """Apply the rules in order; each sees what the earlier ones wrote."""
    for rule in rules:
        hit = F.col(rule.column).isin(*rule.values)
        df = df.withColumn(key, F.when(hit, F.lit(rule.new_key)).otherwise(F.col(key)))
    return df


def dedup_first(df: DataFrame, keys: list[str], order: str = "row_ord") -> DataFrame:
    """The first row in file order for each key.

    ``min_by`` combines on the map side, so a key that repeats many times
    (a missing one, say) never gathers in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.col(order)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*keys, "_row.*").select(*df.columns)


def to_long(
    df: DataFrame,
    indicators: list[str],
    ids: list[str] | None = None,
    key: str = "name",
    period: str = "period",
) -> DataFrame:
    """Wide indicator columns to one row per observed value."""
    ids = ids or [key, period]
    return df.unpivot(ids, indicators, "indicator", "y").filter(F.col("y").isNotNull())


def validate_binary(obs: DataFrame) -> DataFrame:
    """Per item, how many values lie outside 0 and 1."""
    return (
        obs.filter(~F.col("y").isin(0, 1))
        .groupBy("indicator", "period")
        .agg(F.count("*").alias("n_bad"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    )


def items_by_period(obs: DataFrame) -> DataFrame:
    """The indicators that have any value in each period."""
    return obs.groupBy("period", "indicator").agg(F.count("*").alias("n_obs"))


def collisions(df: DataFrame, key: str = "ticker", period: str = "period", by: tuple[str, ...] = ("name",)) -> DataFrame:
    """(period, key) pairs claimed by more than one distinct name, or (id, name) pair.

    Distinct claims first, so that the second step counts small partial groups.
    """
    claims = df.select(period, key, *by).distinct()
    return claims.groupBy(period, key).agg(F.count("*").alias("n_claims")).filter(F.col("n_claims") > 1)


def duplicate_keys(df: DataFrame, key: str = "ticker", period: str = "period") -> DataFrame:
    """(period, key) pairs with more than one row, taken before duplicates are dropped."""
    return df.groupBy(period, key).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)
