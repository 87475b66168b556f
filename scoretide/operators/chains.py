"""Reports over chains and scores: trajectories, anchors, scales, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoretide.operators.spread import HOT_ROWS, bounded_broadcast, grouped_quantiles, is_hot


def _theta_of(draws: DataFrame, wanted: DataFrame, cut: bool, chains: list[int] | None) -> DataFrame:
    """Theta draws of the wanted indexes; a cut to few of them happens before any shuffle."""
    theta = draws.filter(F.col("param") == "theta")
    if chains is not None:
        theta = theta.filter(F.col("chain").isin(chains))
    if cut:
        theta = theta.join(bounded_broadcast(wanted.select(F.col("ep_idx").alias("idx"))), "idx", "left_semi")
    return theta


def chain_period_means(draws: DataFrame, ep_table: DataFrame, keys: list[str] | None = None,
                       chains: list[int] | None = None) -> DataFrame:
    """Mean of theta per key, period and chain.

    Means first: the join then carries one row per parameter and chain, so a
    parameter with very many draws does not meet it.
    """
    wanted = ep_table if keys is None else ep_table.filter(F.col("ticker").isin(keys))
    means = _theta_of(draws, wanted, keys is not None, chains).groupBy("idx", "chain").agg(
        F.avg("value").alias("chain_mean")
    )
    placed = wanted.select("ticker", "period_idx", F.col("ep_idx").alias("idx"))
    return means.join(placed, "idx").select("ticker", "period_idx", "chain", "chain_mean")


def trajectory(draws: DataFrame, ep_table: DataFrame, keys: list[str] | None = None,
               chains: list[int] | None = None) -> DataFrame:
    """Per key and period, the mean of the chain means."""
    per = chain_period_means(draws, ep_table, keys, chains)
    return per.groupBy("ticker", "period_idx").agg(F.avg("chain_mean").alias("theta"))


def trajectory_summary(traj: DataFrame) -> DataFrame:
    """Per key: overall mean, first-period value, range."""
    return traj.groupBy("ticker").agg(
        F.avg("theta").alias("overall_mean"),
        F.min_by("theta", "period_idx").alias("first_mean"),
        F.min("theta").alias("min_theta"),
        F.max("theta").alias("max_theta"),
    )


def screen_anchors(traj: DataFrame, candidates: DataFrame) -> DataFrame:
    """Mean, spread and sign of each candidate's trajectory; a candidate without one is flagged."""
    stats = traj.groupBy("ticker").agg(
        F.count("*").alias("n_periods"), F.avg("theta").alias("mean"), F.stddev_samp("theta").alias("sd"),
        F.min("theta").alias("min_theta"), F.max("theta").alias("max_theta"),
        F.bool_and(F.col("theta") < 0).alias("all_negative"),
        F.bool_and(F.col("theta") > 0).alias("all_positive"),
    )
    listed = candidates.select("ticker").distinct().join(stats, "ticker", "left")
    return listed.withColumn("found", F.col("n_periods").isNotNull())


def chain_pivot(draws: DataFrame, ep_table: DataFrame, keys: list[str], chains: list[int] | None = None) -> DataFrame:
    """Per chain, one column of first-period means and one of overall means for each key."""
    per = chain_period_means(draws, ep_table, keys, chains)
    stats = per.groupBy("chain", "ticker").agg(
        F.min_by("chain_mean", "period_idx").alias("first"), F.avg("chain_mean").alias("mean")
    )
    return stats.groupBy("chain").pivot("ticker", keys).agg(F.max("first").alias("first"), F.max("mean").alias("mean"))


def chain_key_stats(draws: DataFrame, ep_table: DataFrame, keys: list[str] | None = None,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per chain, the draws of each key's first period: mean, sd, 5% and 95%."""
    if keys is not None:
        ep_table = ep_table.filter(F.col("ticker").isin(keys))
    first = ep_table.groupBy("ticker").agg(F.min_by("ep_idx", "period_idx").alias("ep_idx"))
    start = _theta_of(draws, first, True, None).select("chain", "idx", "value")
    hot = is_hot(start, ["chain", "idx"], hot_rows)
    ends = grouped_quantiles(start, ["chain", "idx"], "value", [0.05, 0.95], "_q", hot)
    stats = start.groupBy("chain", "idx").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    both = stats.join(ends, ["chain", "idx"]).join(first.withColumnRenamed("ep_idx", "idx"), "idx")
    return both.select("chain", "ticker", "mean", "sd", F.col("_q")[0].alias("pct05"), F.col("_q")[1].alias("pct95"))


def chain_param_stats(draws: DataFrame, params: list[str]) -> DataFrame:
    """Per chain, mean and sd of scalar parameters (the scales)."""
    return (
        draws.filter(F.col("param").isin(params))
        .groupBy("chain", "param")
        .agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    )


def chain_means_spread(draws: DataFrame, large: float = 5.0) -> DataFrame:
    """Per chain and parameter name, the distribution of the parameters' means."""
    means = draws.groupBy("chain", "param", "idx").agg(F.avg("value").alias("m"))
    return means.groupBy("chain", "param").agg(
        F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), F.min("m").alias("min"),
        F.max("m").alias("max"), F.count_if(F.abs("m") > large).alias("n_large"),
    )


def scale_check(draws: DataFrame) -> DataFrame:
    """Spread of theta and beta means per chain, each against the first chain, and their product.

    If chains differ by scale alone, the product is the same in all of them.
    """
    kept = draws.filter(F.col("param").isin("theta", "beta"))
    per = chain_means_spread(kept).groupBy("chain").agg(
        F.max(F.when(F.col("param") == "theta", F.col("sd"))).alias("theta_sd"),
        F.max(F.when(F.col("param") == "beta", F.col("sd"))).alias("beta_sd"),
    )
    # one row per chain by now, so the unpartitioned window is a handful of rows
    first = Window.partitionBy(F.lit(0)).orderBy("chain")
    return (
        per.withColumn("theta_ratio", F.try_divide("theta_sd", F.first("theta_sd").over(first)))
        .withColumn("beta_ratio", F.try_divide("beta_sd", F.first("beta_sd").over(first)))
        .withColumn("theta_beta", F.col("theta_sd") * F.col("beta_sd"))
    )


def persistent_sign(score_rows: DataFrame, min_periods: int) -> DataFrame:
    """Keys with enough periods whose means are all negative."""
    per = score_rows.groupBy("ticker").agg(
        F.count("*").alias("n_periods"), F.avg("mean").alias("mean"), F.max("mean").alias("max_mean")
    )
    return per.filter((F.col("n_periods") >= min_periods) & (F.col("max_mean") < 0))


def score_trend(score_rows: DataFrame) -> DataFrame:
    """Mean score per year."""
    return score_rows.groupBy("year").agg(
        F.count("*").alias("n"), F.avg("mean").alias("mean_score"), F.stddev_samp("mean").alias("sd_score")
    )


def precision_profile(score_rows: DataFrame, obs: DataFrame) -> DataFrame:
    """Posterior sd against the number of items observed: one row per item count."""
    n_items = obs.groupBy("ticker", "year").agg(F.count("*").alias("n_items"))
    joined = score_rows.join(n_items, ["ticker", "year"])
    return joined.groupBy("n_items").agg(F.count("*").alias("n"), F.avg("sd").alias("mean_sd"))


def precision_correlation(score_rows: DataFrame, obs: DataFrame) -> DataFrame:
    n_items = obs.groupBy("ticker", "year").agg(F.count("*").alias("n_items"))
    joined = score_rows.join(n_items, ["ticker", "year"])
    return joined.agg(F.count("*").alias("n"), F.corr("n_items", "sd").alias("corr_items_sd"))
