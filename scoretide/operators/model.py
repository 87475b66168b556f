"""Evaluating the dynamic two-parameter probit model: paths, probabilities, likelihood, priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoretide.functions.normal import normal_cdf, normal_log_cdf, normal_log_cdf_array
from scoretide.functions.values import is_concern
from scoretide.operators.panel import with_runs
from scoretide.operators.spread import bounded_broadcast, tasks_for
from scoretide.session import materialise, ship_code

LOG_2PI = 1.8378770664093453
ALPHA_SD, BETA_SD = 5.0, 2.5


def firm_scales(raw: DataFrame, scale: DataFrame) -> DataFrame:
    """sigma = sigma_global * raw scale, draw by draw.

    ``raw``: chain, iteration, key, raw. ``scale``: chain, iteration, sigma_global.
    """
    return raw.join(scale, ["chain", "iteration"]).withColumn("sigma", F.col("sigma_global") * F.col("raw"))


def rebuild_paths(steps: DataFrame, key: str = "name", draw: list[str] | None = None) -> DataFrame:
    """Theta from its innovations: a start, then a running sum of scaled steps.

    ``steps``: key, period, is_fresh, pin, z, sigma_init, sigma. A run of one
    key has at most one row per period, so the windows stay small.
    """
    ids = [*(draw or []), key]
    step = (
        F.when(F.col("pin").isNotNull(), F.col("pin"))
        .when(F.col("is_fresh"), F.col("sigma_init") * F.col("z"))
        .otherwise(F.col("sigma") * F.col("z"))
    )
    ordered = Window.partitionBy(*ids).orderBy("period")
    run = F.sum(F.col("is_fresh").cast("int")).over(ordered)
    in_run = Window.partitionBy(*ids, "_run").orderBy("period")
    return (
        steps.withColumn("_run", run)
        .withColumn("theta", F.sum(step).over(in_run))
        .drop("_run")
    )


def linear_predictor(obs: DataFrame, theta: DataFrame, items: DataFrame, key: str = "name") -> DataFrame:
    """Observations with mu = beta * theta - alpha.

    The item table is broadcast only if its counted size allows; the
    entity-period side is joined on its own key.
    """
    with_items = obs.join(bounded_broadcast(items), ["indicator", "period"])
    joined = with_items.join(theta, [key, "period"])
    return joined.withColumn("mu", F.col("beta") * F.col("theta") - F.col("alpha"))


def predict_prob(obs: DataFrame, theta: DataFrame, items: DataFrame, key: str = "name") -> DataFrame:
    return linear_predictor(obs, theta, items, key).withColumn("prob", normal_cdf("mu"))


def with_log_lik(scored: DataFrame) -> DataFrame:
    """log Phi(mu) for a one and log Phi(-mu) for a zero."""
    signed = F.when(F.col("y") == 1, F.col("mu")).otherwise(-F.col("mu"))
    return scored.withColumn("_s", signed).withColumn("log_lik", normal_log_cdf("_s")).drop("_s")


def log_likelihood(obs: DataFrame, theta: DataFrame, items: DataFrame, by: list[str] | None = None,
                   key: str = "name") -> DataFrame:
    """Log-likelihood in total, or per entity, period or item; partial sums combine before the shuffle."""
    scored = with_log_lik(linear_predictor(obs, theta, items, key))
    return scored.groupBy(*(by or [])).agg(F.count("*").alias("n_obs"), F.sum("log_lik").alias("log_lik"))


def _normal_sum(n, ss, sd: float):
    return -0.5 * ss / (sd * sd) - n * (F.log(F.lit(sd)) + 0.5 * LOG_2PI)


def log_prior(z: DataFrame, items: DataFrame, raw_scales: DataFrame, sigma_global: float,
              sigma_init: float) -> DataFrame:
    """Log prior density of one parameter set, a row per block.

    ``z``: innovations; ``items``: alpha, beta; ``raw_scales``: raw. Half-normal
    blocks carry log 2 per value.
    """
    log2 = F.log(F.lit(2.0))

    def block(df: DataFrame, column: str, sd: float, half: bool, name: str) -> DataFrame:
        sums = df.agg(F.count(column).alias("n"), F.sum(F.col(column) * F.col(column)).alias("ss"))
        lp = _normal_sum(F.col("n"), F.col("ss"), sd) + (F.col("n") * log2 if half else F.lit(0.0))
        return sums.select(F.lit(name).alias("block"), F.col("n"), lp.alias("log_prior"))

    spark = z.sparkSession
    hyper = spark.range(1).select(F.explode(F.array(F.lit(sigma_global), F.lit(sigma_init))).alias("v"))
    return (
        block(z, "z", 1.0, False, "innovations")
        .unionByName(block(items, "alpha", ALPHA_SD, False, "alpha"))
        .unionByName(block(items, "beta", BETA_SD, False, "beta"))
        .unionByName(block(raw_scales, "raw", 1.0, True, "firm_scales"))
        .unionByName(block(hyper, "v", 1.0, True, "hyper_scales"))
    )


def log_prior_draws(z: DataFrame, items: DataFrame, raw_scales: DataFrame, hyper: DataFrame) -> DataFrame:
    """Log prior density per (chain, iteration) and block.

    All four tables are keyed by chain and iteration. ``z``: innovations; ``items``: alpha, beta; ``raw_scales``: raw;
    ``hyper``: sigma_global, sigma_init. Partial sums of squares combine before the shuffle.
    """
    log2 = F.log(F.lit(2.0))

    def block(df: DataFrame, columns: list[str], sd: float, half: bool, name: str) -> DataFrame:
        n, squares = sum(F.count(c) for c in columns), sum(F.sum(F.col(c) * F.col(c)) for c in columns)
        sums = df.groupBy("chain", "iteration").agg(n.alias("n"), squares.alias("ss"))
        lp = _normal_sum(F.col("n"), F.col("ss"), sd) + (F.col("n") * log2 if half else F.lit(0.0))
        return sums.select("chain", "iteration", F.lit(name).alias("block"), "n", lp.alias("log_prior"))

    return (
        block(z, ["z"], 1.0, False, "innovations")
        .unionByName(block(items, ["alpha"], ALPHA_SD, False, "alpha"))
        .unionByName(block(items, ["beta"], BETA_SD, False, "beta"))
        .unionByName(block(raw_scales, ["raw"], 1.0, True, "firm_scales"))
        .unionByName(block(hyper, ["sigma_global", "sigma_init"], 1.0, True, "hyper_scales"))
    )


def _sum_log_lik(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chain and chunk of draws: observations, and the sum of their log-likelihoods for each draw."""
    found: dict[tuple, list] = {}
    for b in batches:
        width = np.diff(b.column("theta").offsets.to_numpy())
        chain, chunk, y = (b.column(c).to_numpy() for c in ("chain", "chunk", "y"))
        for key in set(zip(chain.tolist(), chunk.tolist(), width.tolist())):
            rows = np.flatnonzero((chain == key[0]) & (chunk == key[1]) & (width == key[2]))
            theta, alpha, beta = (b.column(c).take(pa.array(rows)).flatten().to_numpy().reshape(len(rows), -1) for c in ("theta", "alpha", "beta"))
            mu = beta * theta - alpha
            held = found.setdefault(key, [0, np.zeros(key[2])])
            held[0] += len(rows)
            held[1] += normal_log_cdf_array(np.where(y[rows, None] == 1, mu, -mu)).sum(axis=0)
    for (chain, chunk, _), (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([chain], pa.int32()), pa.array([chunk], pa.int64()), pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.float64()))],
                                         names=["chain", "chunk", "n_obs", "sums"])


def log_likelihood_draws(obs: DataFrame, theta_draws: DataFrame, item_draws: DataFrame, key: str = "name", per_chunk: int = 256) -> DataFrame:
    """Log-likelihood of all observations per (chain, iteration).

    ``theta_draws``: key, period, chain, iteration, theta; ``item_draws``: indicator, period, chain, iteration, alpha, beta; iterations
    count from 1 without gaps, the same ones for all parameters. Draws travel in arrays of ``per_chunk``, so an observation meets
    draws / per_chunk rows, and a task gives back one row per chain and chunk.
    """
    ship_code(obs.sparkSession)

    def packed(draws: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
        cut = draws.withColumn("chunk", F.floor((F.col("iteration") - 1) / per_chunk)).groupBy(*keys, "chain", "chunk").agg(
            F.sort_array(F.collect_list(F.struct("iteration", *columns))).alias("_d"))
        return cut.select(*keys, "chain", "chunk", *[F.col(f"_d.{c}").alias(c) for c in columns])

    theta, items = packed(theta_draws, [key, "period"], ["theta"]), packed(item_draws, ["indicator", "period"], ["alpha", "beta"])
    met = obs.join(theta, [key, "period"]).join(bounded_broadcast(items), ["indicator", "period", "chain", "chunk"])
    same = (F.size("theta") == F.size("alpha"))
    theta = F.when(same, F.col("theta")).otherwise(F.raise_error(F.lit("scores and items have different draws")))
    rows = met.select(F.col("chain").cast("int").alias("chain"), F.col("chunk").cast("long").alias("chunk"), "y", theta.alias("theta"), "alpha", "beta")
    sums = rows.mapInArrow(_sum_log_lik, "chain int, chunk long, n_obs long, sums array<double>")
    cells = sums.select("chain", "chunk", "n_obs", F.posexplode("sums").alias("place", "s"))
    return cells.groupBy("chain", (F.col("chunk") * per_chunk + F.col("place") + 1).alias("iteration")).agg(
        F.sum("n_obs").alias("n_obs"), F.sum("s").alias("log_lik"))


def pack_draws(draws: DataFrame, keys: list[str], columns: list[str], per_chunk: int) -> DataFrame:
    """Draw values as arrays of at most ``per_chunk`` draws, in draw order."""
    packed = draws.withColumn("chunk", F.floor((F.col("draw") - 1) / per_chunk)).groupBy(*keys, "chunk").agg(
        F.sort_array(F.collect_list(F.struct("draw", *columns))).alias("_d")
    )
    return packed.select(*keys, "chunk", *[F.col(f"_d.{c}").alias(c) for c in columns])


def pointwise_log_lik(obs: DataFrame, theta_draws: DataFrame, item_draws: DataFrame, key: str = "name",
                      per_chunk: int = 64) -> DataFrame:
    """Per observation over all draws: log mean likelihood and variance of the log-likelihood.

    Draws travel in chunks, so an observation meets ``draws / per_chunk`` rows
    in the joins and not one per draw. Within a chunk the largest term is known
    beforehand, as the log-likelihood rises with the signed predictor; so the
    sum is scaled by it, and the chunks then merge exactly.

    Observations and draws are dealt by entity and period, once, to as many tasks
    as the rows that meet need. Packing, joining and merging stay in these tasks.
    """
    spark = obs.sparkSession
    obs = materialise(obs.select(key, "indicator", "period", "y"), "pointwise-obs")
    items = materialise(pack_draws(item_draws, ["indicator", "period"], ["alpha", "beta"], per_chunk), "pointwise-items")
    chunks = items.select("chunk").distinct().count()
    tasks = tasks_for(spark, obs.count() * chunks + theta_draws.count())
    theta = pack_draws(theta_draws.repartition(tasks, key, "period"), [key, "period"], ["theta"], per_chunk)
    met = obs.repartition(tasks, key, "period").join(theta.hint("merge"), [key, "period"])
    # where the items are too many to be broadcast, rows go to them and come back to the same tasks
    met = met.join(bounded_broadcast(items), ["indicator", "period", "chunk"]).repartition(tasks, key, "period")
    mu = F.transform(
        F.arrays_zip("theta", "alpha", "beta"),
        lambda d: F.when(F.col("y") == 1, d["beta"] * d["theta"] - d["alpha"]).otherwise(
            d["alpha"] - d["beta"] * d["theta"]
        ),
    )
    keys = [key, "indicator", "period"]
    signed = met.select(*keys, "chunk", mu.alias("_mu")).withColumn("_high", F.array_max("_mu"))
    signed = signed.withColumn("_top", normal_log_cdf("_high"))
    # one row per draw from here, inside one generated stage up to the partial sums; the outer form, as the plain one adds a filter that
    # works out the arrays twice more, and none is empty
    each = signed.select(*keys, "chunk", "_top", F.explode_outer("_mu").alias("_s"))
    each = each.withColumn("_ll", normal_log_cdf("_s"))
    chunk = each.groupBy(*keys, "chunk").agg(
        F.count("*").alias("_n"), F.first("_top").alias("_top"),
        F.sum(F.exp(F.col("_ll") - F.col("_top"))).alias("_scaled"),
        F.avg("_ll").alias("_mean"), (F.var_pop("_ll") * F.count("*")).alias("_m2"),
    )
    whole = Window.partitionBy(*keys)
    chunk = chunk.withColumns({"_m": F.max("_top").over(whole), "_all": F.sum(F.col("_n") * F.col("_mean")).over(whole) / F.sum("_n").over(whole)})
    # squares about each chunk's mean, moved to the common mean: nothing large cancels
    apart = F.col("_mean") - F.col("_all")
    summed = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c))  # noqa: E731  # a chunk without values makes it NULL
    per = chunk.groupBy(*keys).agg(
        F.sum("_n").alias("n_draws"), F.first("_m").alias("_m"),
        summed(F.col("_scaled") * F.exp(F.col("_top") - F.col("_m"))).alias("_total"),
        summed(F.col("_m2") + F.col("_n") * apart * apart).alias("_squares"),
    )
    total, squares = F.col("_total"), F.col("_squares")
    var = F.try_divide(squares, F.col("n_draws") - 1)
    return per.select(
        *keys, "n_draws",
        (F.col("_m") + F.log(total / F.col("n_draws"))).alias("lppd"),
        var.alias("p_waic"),
    )


def sample_observations(obs: DataFrame, fraction: float, seed: int = 61802, key: str = "name") -> DataFrame:
    """A subsample for pointwise comparisons, which the full data would make very large.

    Chosen by a hash of the observation, so every run and every task agrees on it.
    """
    place = F.pmod(F.xxhash64(F.lit(seed), key, "indicator", "period"), F.lit(1_000_000))
    return obs.filter(place < int(fraction * 1_000_000))


def waic(pointwise: DataFrame) -> DataFrame:
    """Totals for model comparison."""
    elpd = F.col("lppd") - F.col("p_waic")
    return pointwise.agg(
        F.count("*").alias("n_obs"), F.sum("lppd").alias("lppd"), F.sum("p_waic").alias("p_waic"),
        (-2.0 * F.sum(elpd)).alias("waic"),
        (2.0 * F.sqrt(F.count("*") * F.var_samp(elpd))).alias("se_waic"),
    )


def additive_index(obs: DataFrame, key: str = "name") -> DataFrame:
    """Strengths minus concerns per entity-period: the equal-weight baseline."""
    signed = F.when(is_concern(F.col("indicator")), -F.col("y")).otherwise(F.col("y"))
    return obs.groupBy(key, "period").agg(F.sum(signed).alias("index"), F.count("*").alias("n_items"))


def path_inputs(ep: DataFrame, starts: DataFrame, key: str = "name") -> DataFrame:
    """Entity-periods with run flags and pinned start values."""
    pins = starts.select(key, "period", "pin")
    return with_runs(ep, key).join(pins, [key, "period"], "left")
