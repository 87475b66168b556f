"""The three steps a user runs: clean a raw panel, read chains into results, check the chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretide.operators import chains as ch
from scoretide.operators import clean, convergence, panel, posterior, resolve
from scoretide.session import materialise
from scoretide.sources import chains as chain_files



def clean_step(raw: DataFrame, indicators: list[str], cutoff: int | None = None,
               overrides: list[clean.Override] | None = None, mode: str = "coded") -> dict[str, DataFrame]:
    """Raw panel (name, ticker, issuerid, period, row_ord, indicators) to its tables.

    ``mode`` is "coded" or "first_keeps". The tables: ``panel`` with one row per
    key and period, ``meta``, ``obs``, ``items``, ``log`` (coded mode), and the
    reports ``unresolved``, ``lost`` and ``bad_values``, taken before anything
    is dropped.
    """
    df = clean.normalise_indicators(raw, indicators)
    if cutoff is not None:
        df = clean.restrict_universe(df, cutoff)
    df = materialise(clean.apply_overrides(df, overrides or []), "clean")
    tables: dict[str, DataFrame] = {}
    if mode == "coded":
        resolution = resolve.resolve_keys(df)
        rows, tables["log"] = resolution.rows, resolution.log
    elif mode == "first_keeps":
        rows = resolve.resolve_first_keeps(df)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    rows = materialise(rows, "resolved")
    tables["unresolved"] = resolve.unresolved_collisions(rows)
    tables["lost"] = resolve.lost_rows(rows)
    done = materialise(resolve.finish_panel(rows), "panel").drop("ticker").withColumnRenamed("new_key", "ticker")
    tables["panel"] = done
    tables["meta"] = done.select("name", "ticker", "issuerid", F.col("period").alias("year"))
    keyed = done.filter(F.col("ticker").isNotNull())
    tables["obs"] = clean.to_long(keyed, indicators, key="ticker")
    tables["items"] = clean.items_by_period(tables["obs"])
    tables["bad_values"] = clean.validate_binary(tables["obs"])
    return tables


def index_step(obs: DataFrame, base: int, key: str = "ticker") -> dict[str, DataFrame]:
    """The dimension tables that tie parameter indexes to keys, periods and items."""
    ep = panel.entity_periods(obs, key)
    numbered = materialise(panel.entity_period_table(ep, key), "ep")
    items = materialise(panel.item_table(obs), "items")
    return {
        "entity_period": panel.with_period_index(numbered, base),
        "item": panel.with_period_index(items, base),
        "indexed": panel.index_observations(obs, numbered, items, key),
        "transitions": panel.transitions(ep, key),
        "starts": panel.fresh_starts(ep, key),
    }


def convert_step(spark: SparkSession, chain_path: str, out: str) -> DataFrame:
    """Chain CSVs to Parquet draws, without the sampler's internal parameters."""
    chain_files.write_draws(chain_files.read_chains(spark, chain_path), out)
    return chain_files.read_draws(spark, out)


def extract_step(draws: DataFrame, index: dict[str, DataFrame], meta: DataFrame, base: int) -> dict[str, DataFrame]:
    """Score table, item table and the sign cross-tab."""
    params = posterior.item_params(draws, index["item"], base)
    return {
        "scores": posterior.scores(draws, index["entity_period"], meta, base),
        "item_params": params,
        "beta_signs": posterior.beta_sign_crosstab(params),
    }


def diagnose_step(draws: DataFrame, ep_table: DataFrame, anchors: tuple[str, str], sample: dict[str, int] | None = None,
                  ragged: str = "error") -> dict[str, DataFrame]:
    """Sampler checks, R-hat and ESS, anchors (negative, positive), scales, verdict.

    All parameters are checked, unless ``sample`` names how many evenly spaced ones of a parameter are enough; the verdict
    says how many there are beside how many were checked.
    """
    sampler = convergence.sampler_diagnostics(chain_files.sampler_table(draws))
    checked = draws.filter(~F.col("param").isin(*chain_files.SAMPLER_FIELDS, "lp__"))
    n_parameters = checked.select("param", "idx").distinct().count()
    if sample:
        picked = checked.filter(~F.col("param").isin(*sample))
        for param, k in sample.items():
            picked = picked.unionByName(convergence.spaced_draws(checked.filter(F.col("param") == param), k))
        checked = materialise(picked, "sampled")
    conv = materialise(convergence.convergence(checked, ragged=ragged), "convergence")
    tracked = materialise(convergence.key_convergence(draws, ep_table, list(anchors), ragged=ragged), "anchor-paths")
    return {
        "sampler": sampler,
        "convergence": conv,
        "classes": convergence.convergence_rollup(conv),
        "offenders": convergence.offenders(conv),
        "anchors": tracked,
        "anchor_signs": posterior.anchor_check(tracked, *anchors),
        "scales": ch.scale_check(draws),
        "health": convergence.health_report(conv, sampler).withColumn("n_parameters", F.lit(n_parameters)),
    }
