"""Summaries of posterior draws: one row per (param, idx, chain, iteration, value)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoretide.functions.values import is_concern
from scoretide.operators.spread import HOT_ROWS, grouped_quantiles, is_hot, join_null_safe

PROBS = [0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95]
QUANTILE_NAMES = ["pct05", "pct10", "pct25", "pct50", "pct75", "pct90", "pct95"]
PARAM = ["param", "idx"]


def posterior_summary(
    draws: DataFrame, keys: list[str] | None = None, value: str = "value", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Mean, sd, extremes and seven exact quantiles over all chains.

    While no parameter is hot this is one aggregation, with all quantiles read
    from one value map; a hot parameter's quantiles come from the spread path.
    """
    keys = keys or PARAM
    moments = [
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ]
    if not is_hot(draws, keys, hot_rows):
        out = draws.groupBy(*keys).agg(F.percentile(value, PROBS).alias("_q"), *moments)
    else:
        quantiles = grouped_quantiles(draws, keys, value, PROBS, "_q", hot=True)
        out = join_null_safe(draws.groupBy(*keys).agg(*moments), quantiles, keys, "left")
    named = [F.col("_q")[i].alias(n) for i, n in enumerate(QUANTILE_NAMES)]
    return out.select(*keys, "mean", "sd", "min", *named, "max")


def scores(draws: DataFrame, ep_table: DataFrame, meta: DataFrame, base: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Entity-period scores with names.

    ``ep_table``: ticker, period_idx, ep_idx. ``meta``: name, ticker, year.
    Summaries first, so both joins run on one row per parameter. Both sides have about as many rows, so neither is broadcast, however
    small they are on disk.
    """
    summary = posterior_summary(draws.filter(F.col("param") == "theta"), hot_rows=hot_rows)
    placed = summary.join(ep_table.hint("merge"), summary["idx"] == ep_table["ep_idx"], "left")
    placed = placed.withColumn("year", (F.col("period_idx") + base).cast("int"))
    named = placed.join(meta.select("name", "ticker", "year").distinct().hint("merge"), ["ticker", "year"], "left")
    return named.select("name", "ticker", "year", "mean", "sd", "min", *QUANTILE_NAMES, "max")


def item_params(draws: DataFrame, items: DataFrame, base: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Difficulty and discrimination of every item, side by side.

    ``items``: item_col, period_idx, item_idx. One aggregation serves both
    parameters; the second one only lines them up.
    """
    kept = ["mean", "sd", "pct05", "pct50", "pct95"]
    summary = posterior_summary(draws.filter(F.col("param").isin("alpha", "beta")), hot_rows=hot_rows)
    side = [
        F.max(F.when(F.col("param") == p, F.col(c))).alias(f"{p}_{c}") for p in ("alpha", "beta") for c in kept
    ]
    both = summary.groupBy("idx").agg(*side)
    joined = items.join(both, items["item_idx"] == both["idx"], "left")
    return joined.select(
        "item_col", (F.col("period_idx") + base).cast("int").alias("year"), "item_idx",
        *[f"{p}_{c}" for p in ("alpha", "beta") for c in kept],
    )


def beta_sign_crosstab(params: DataFrame) -> DataFrame:
    """Items by label (concern or strength) and sign of the discrimination."""
    return (
        params.withColumn("is_concern", is_concern(F.col("item_col")))
        .withColumn("beta_neg", F.col("beta_mean") < 0)
        .groupBy("is_concern", "beta_neg")
        .agg(F.count("*").alias("n"))
    )


def anchor_check(score_rows: DataFrame, negative: str, positive: str) -> DataFrame:
    """Per anchor, also one that is not there: whether it was found, its periods, how many are negative, and whether all have the wanted sign."""
    is_neg = F.col("ticker") == negative
    right_sign = F.when(is_neg, F.col("mean") < 0).otherwise(F.col("mean") > 0)
    anchors = score_rows.sparkSession.createDataFrame([(a,) for a in sorted({negative, positive})], "ticker string")
    mine = score_rows.filter(F.col("ticker").isin(negative, positive)).select("ticker", "mean")
    return anchors.join(mine, "ticker", "left").groupBy("ticker").agg(
        (F.count("mean") > 0).alias("found"),
        F.count("mean").alias("n_periods"),
        F.count_if(F.col("mean") < 0).alias("n_negative"),
        F.coalesce(F.bool_and(F.when(F.col("mean").isNotNull(), right_sign)), F.lit(False)).alias("sign_ok"),
    )


def draw_counts(draws: DataFrame) -> DataFrame:
    """Draws per chain and parameter name: the rows of one column of a chain file."""
    per = draws.groupBy("chain", "param", "idx").agg(F.count("*").alias("n"))
    return per.groupBy("chain", "param").agg(
        F.min("n").alias("min_draws"), F.max("n").alias("max_draws"), F.count("*").alias("n_params")
    )


def thin_draws(draws: DataFrame, burn: int, thin: int) -> DataFrame:
    """Drop the warm-up and keep every ``thin``-th draw, renumbered from 1."""
    after = F.col("iteration") - burn
    kept = draws.filter((after > 0) & (after % thin == 0))
    return kept.withColumn("iteration", (after / thin).cast("long"))


def propagate(
    draws: DataFrame, stat: Callable[[Column], Column], by: list[str] | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Posterior of a statistic: computed within every draw, then summarised over draws."""
    by = by or []
    per_draw = draws.groupBy("chain", "iteration", *by).agg(stat(F.col("value")).alias("value"))
    return posterior_summary(per_draw.withColumn("stat", F.lit("stat")), ["stat", *by], hot_rows=hot_rows).drop("stat")
