"""Every operator as a named query over the test tables.

Each takes (spark, sf_dir) and returns a DataFrame over whole tables. Results
are rounded where floating sums may differ in their last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretide.functions.values import is_concern, param_index, param_name
from scoretide.operators import chains as ch
from scoretide.operators import clean, model, panel, posterior, resolve
from scoretide.operators import convergence as conv
from scoretide.plans import fit
from scoretide.plans import views as v
from scoretide.session import fresh_path, materialise
from scoretide.sources import chains as chain_files
from scoretide.sources import panel as panel_files
from scoretide.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else c for c, t in df.dtypes])


# cleaning


@query
def clean_panel(spark, sf):
    p = v.panel_clean(spark, sf)
    return p.select("name", "ticker", "issuerid", "period", "row_ord", *v.INDICATORS)


@query
def validate_binary(spark, sf):
    return clean.validate_binary(v.raw_obs(spark, sf))


@query
def restrict_universe(spark, sf):
    p = v.panel_raw(spark, sf).withColumn("ticker", F.when(F.col("row_ord") % 11 != 0, F.col("ticker")))
    return clean.restrict_universe(p, 1995).select("name", "ticker", "period", "row_ord")


OVERRIDES = [
    clean.Override("ticker", ("T5",), "T5X"),
    clean.Override("name", ("Customer#000000013", "Customer#000000007"), "R"),
    clean.Override("ticker", ("R",), "R1"),
]


@query
def apply_overrides(spark, sf):
    out = clean.apply_overrides(v.panel_raw(spark, sf), OVERRIDES)
    return out.select("name", "period", "ticker")


@query
def items_by_period(spark, sf):
    return clean.items_by_period(v.obs(spark, sf))


@query
def dedup_first(spark, sf):
    p = v.panel_raw(spark, sf).select("ticker", "period", "name", "row_ord")
    return clean.dedup_first(p, ["ticker", "period"])


@query
def duplicate_keys(spark, sf):
    return clean.duplicate_keys(v.panel_raw(spark, sf))


@query
def collisions(spark, sf):
    return clean.collisions(v.panel_raw(spark, sf))


@query
def collisions_by_id(spark, sf):
    with_id = v.panel_raw(spark, sf).filter(F.col("issuerid").isNotNull() & (F.col("issuerid") != ""))
    return clean.collisions(with_id, by=("issuerid", "name"))


@query
def resolve_first_keeps(spark, sf):
    out = resolve.resolve_first_keeps(v.panel_raw(spark, sf))
    return out.select("name", "period", "ticker", "new_key")


@query
def resolve_coded(spark, sf):
    out = resolve.resolve_keys(v.panel_raw(spark, sf))
    return out.rows.select("name", "period", "ticker", "new_key")


@query
def resolve_resumed(spark, sf):
    """All periods but the last, then the last from what the first run remembers."""
    p = materialise(v.panel_raw(spark, sf), "panel")
    last = p.agg(F.max("period")).first()[0]
    early = resolve.resolve_keys(p.where(F.col("period") < last))
    late = resolve.resolve_keys(p.where(F.col("period") == last), early.memory)
    return early.rows.unionByName(late.rows).select("name", "period", "ticker", "new_key")


@query
def unresolved(spark, sf):
    out = resolve.resolve_keys(v.panel_raw(spark, sf))
    return resolve.unresolved_collisions(out.rows)


@query
def resolution_log(spark, sf):
    """Who got which suffix under which key, and when."""
    return resolve.resolve_keys(v.panel_raw(spark, sf)).log.select("name", "old_key", "new_key", "year_created", "stage")


@query
def lost_rows(spark, sf):
    return resolve.lost_rows(resolve.resolve_keys(v.panel_raw(spark, sf)).rows)


# shapes and indexes


@query
def to_long(spark, sf):
    return v.obs(spark, sf)


@query
def subset_periods(spark, sf):
    return panel.subset_periods(v.obs(spark, sf), 1996, 1998)


@query
def to_wide(spark, sf):
    return panel.to_wide(v.obs(spark, sf))


@query
def wide_round_trip(spark, sf):
    return panel.from_wide(panel.to_wide(v.obs(spark, sf))).select("name", "period", "indicator", "y")


@query
def complete_panel(spark, sf):
    done = panel.complete_panel(v.panel_clean(spark, sf).select("name", "period", *v.INDICATORS))
    return done.select("name", "period", *[F.coalesce(c, F.lit(-1)).alias(c) for c in v.INDICATORS])


@query
def item_index(spark, sf):
    return panel.item_table(v.obs(spark, sf)).select("item_col", "period", "item_idx")


@query
def dense_index(spark, sf):
    ep = panel.entity_periods(v.obs(spark, sf))
    return panel.entity_period_table(ep)


@query
def index_observations(spark, sf):
    o = v.obs(spark, sf)
    ep = materialise(panel.entity_period_table(panel.entity_periods(o)), "ep")
    out = panel.index_observations(o, ep, panel.item_table(o))
    return out.select("name", "period", "indicator", "y", "ep_idx", "entity_idx", "item_idx")


@query
def period_index(spark, sf):
    p = v.panel_raw(spark, sf)
    base = panel.period_base(p)
    out = panel.to_calendar(panel.with_period_index(p, base), base)
    return out.select("name", "period_idx", "year")


@query
def transitions(spark, sf):
    return panel.transitions(panel.entity_periods(v.obs(spark, sf)))


@query
def fresh_starts(spark, sf):
    return panel.fresh_starts(panel.entity_periods(v.obs(spark, sf))).select("name", "period")


@query
def classify_starts(spark, sf):
    ep = panel.entity_periods(v.obs(spark, sf))
    low, high = v.anchors(ep)
    out = panel.classify_starts(ep, low, high)
    return out.select("name", "period", F.coalesce("pin", F.lit(0.0)).alias("pin"), "kind")


@query
def panel_dims(spark, sf):
    o = v.obs(spark, sf)
    return panel.panel_dims(o, v.anchors(o))


@query
def coverage(spark, sf):
    return rounded(panel.coverage(v.obs(spark, sf)))


# draws and summaries


@query
def posterior_summary(spark, sf):
    return rounded(posterior.posterior_summary(v.draw_values(spark, sf)))


@query
def scores(spark, sf):
    return rounded(posterior.scores(v.draw_values(spark, sf), v.ep_table(spark, sf), v.meta(spark, sf), v.EP_BASE))


@query
def item_params(spark, sf):
    return rounded(posterior.item_params(v.item_draws(spark, sf), v.item_table(spark, sf), v.EP_BASE))


@query
def beta_sign_crosstab(spark, sf):
    params = posterior.item_params(v.item_draws(spark, sf), v.item_table(spark, sf), v.EP_BASE)
    return posterior.beta_sign_crosstab(rounded(params))


def _centred_scores(spark, sf):
    """Scores with their centre moved to zero, so that signs vary."""
    s = posterior.scores(v.draw_values(spark, sf), v.ep_table(spark, sf), v.meta(spark, sf), v.EP_BASE)
    return s.withColumn("mean", F.col("mean") / 1000 - 52)


@query
def anchor_check(spark, sf):
    return posterior.anchor_check(_centred_scores(spark, sf), "N3", "N7")


@query
def persistent_sign(spark, sf):
    return rounded(ch.persistent_sign(_centred_scores(spark, sf), 2))


@query
def score_trend(spark, sf):
    return rounded(ch.score_trend(_centred_scores(spark, sf)))


def _score_obs(spark, sf):
    """Items observed per key and year: the parts a supplier's key shipped."""
    lines = v.table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    ep = v.ep_table(spark, sf)
    return lines.join(ep, lines["l_suppkey"] == ep["ep_idx"]).select(
        "ticker", (F.col("period_idx") + v.EP_BASE).cast("int").alias("year"), "l_partkey"
    )


@query
def precision_profile(spark, sf):
    return rounded(ch.precision_profile(_centred_scores(spark, sf), _score_obs(spark, sf)))


@query
def precision_correlation(spark, sf):
    return rounded(ch.precision_correlation(_centred_scores(spark, sf), _score_obs(spark, sf)))


@query
def draw_counts(spark, sf):
    return posterior.draw_counts(v.draw_values(spark, sf))


@query
def thin_draws(spark, sf):
    return posterior.thin_draws(v.draws(spark, sf), 10, 3).select("idx", "chain", "iteration", "value")


@query
def propagate(spark, sf):
    out = posterior.propagate(v.draws(spark, sf), F.avg)
    return rounded(out)


@query
def param_labels(spark, sf):
    """Parameter labels in both notations, parsed back."""
    raw = v.table(spark, sf, "part").select(
        F.concat(F.lit("theta["), F.col("p_partkey").cast("string"), F.lit("]")).alias("bracket"),
        F.concat(F.lit("sigma_firm."), F.col("p_partkey").cast("string")).alias("dotted"),
        F.col("p_type"),
    )
    return raw.select(
        "bracket", param_name(F.col("bracket")).alias("name_b"), param_index(F.col("bracket")).alias("idx_b"),
        param_name(F.col("dotted")).alias("name_d"), param_index(F.col("dotted")).alias("idx_d"),
    )


# chains


@query
def sampler_diagnostics(spark, sf):
    return rounded(conv.sampler_diagnostics(v.sampler(spark, sf)))


@query
def rhat(spark, sf):
    return rounded(conv.rhat(v.draws(spark, sf)))


@query
def ess(spark, sf):
    return rounded(conv.ess(v.draws(spark, sf)), 4)


def _conv(spark, sf):
    return materialise(conv.convergence(v.draws(spark, sf)), "convergence")


@query
def convergence_rollup(spark, sf):
    return rounded(conv.convergence_rollup(_conv(spark, sf)), 4)


@query
def offenders(spark, sf):
    r = conv.rhat(v.draws(spark, sf))
    return rounded(conv.offenders(r, 1.003).select("param", "idx", "rhat"), 4)


@query
def health_report(spark, sf):
    return rounded(conv.health_report(_conv(spark, sf), conv.sampler_diagnostics(v.sampler(spark, sf))), 4)


@query
def key_convergence(spark, sf):
    out = conv.key_convergence(v.draws(spark, sf), v.ep_table(spark, sf), ["N3", "N7"])
    return rounded(out.withColumn("ess_bulk", F.round("ess_bulk", 4)))


@query
def spaced_sample(spark, sf):
    sizes = v.item_draws(spark, sf).groupBy("param").agg(F.max("idx").alias("n"))
    return conv.spaced_sample(sizes, 50)


@query
def spaced_draws(spark, sf):
    kept = conv.spaced_draws(v.item_draws(spark, sf), 50)
    return rounded(kept.groupBy("param", "idx").agg(F.count("*").alias("n"), F.avg("value").alias("mean")))


@query
def trajectory(spark, sf):
    return rounded(ch.trajectory(v.draw_values(spark, sf), v.ep_table(spark, sf)))


@query
def trajectory_three_chains(spark, sf):
    t = ch.trajectory(v.draw_values(spark, sf), v.ep_table(spark, sf), chains=[1, 2, 3])
    return rounded(ch.trajectory_summary(t))


@query
def chain_pivot(spark, sf):
    return rounded(ch.chain_pivot(v.draw_values(spark, sf), v.ep_table(spark, sf), ["N3", "N7"], [1, 2, 3]))


CANDIDATES = ["N0", "N3", "N7", "N12", "N99"]


@query
def screen_anchors(spark, sf):
    shifted = v.draw_values(spark, sf).withColumn("value", F.col("value") / 1000 - 52)
    t = ch.trajectory(shifted, v.ep_table(spark, sf), CANDIDATES)
    regions = v.table(spark, sf, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"))
    missing = regions.limit(1).select(F.lit("N99").alias("ticker"))
    listed = regions.filter(F.col("ticker").isin(CANDIDATES)).unionByName(missing)
    out = ch.screen_anchors(t, listed)
    return rounded(out.select(
        "ticker", "found", F.coalesce("n_periods", F.lit(0)).alias("n_periods"),
        *[F.coalesce(c, F.lit(-999.0)).alias(c) for c in ("mean", "sd", "min_theta", "max_theta")],
        F.coalesce("all_negative", F.lit(False)).alias("all_negative"),
        F.coalesce("all_positive", F.lit(False)).alias("all_positive"),
    ))


@query
def chain_key_stats(spark, sf):
    return rounded(ch.chain_key_stats(v.draw_values(spark, sf), v.ep_table(spark, sf)))


def _scales(spark, sf):
    """Two scalar parameters per chain from taxes and discounts."""
    lines = v.table(spark, sf, "lineitem")
    both = F.explode(F.array(
        F.struct(F.lit("sigma_init").alias("param"), F.col("l_tax").alias("value")),
        F.struct(F.lit("sigma_global").alias("param"), F.col("l_discount").alias("value")),
    ))
    return lines.select(F.col("l_linenumber").alias("chain"), both.alias("_d")).select("chain", "_d.*")


@query
def chain_param_stats(spark, sf):
    return rounded(ch.chain_param_stats(_scales(spark, sf), ["sigma_init", "sigma_global"]))


def _theta_and_beta(spark, sf):
    theta = v.draw_values(spark, sf).withColumn("value", F.col("value") / 10000 - 5)
    beta = v.item_draws(spark, sf).filter(F.col("param") == "beta")
    return theta.unionByName(beta)


@query
def chain_means_spread(spark, sf):
    shifted = _theta_and_beta(spark, sf).withColumn("value", 8 * F.col("value"))
    return rounded(ch.chain_means_spread(shifted))


@query
def scale_check(spark, sf):
    return rounded(ch.scale_check(_theta_and_beta(spark, sf)))


# model evaluation


@query
def predict_prob(spark, sf):
    out = model.predict_prob(v.obs(spark, sf), v.theta(spark, sf), v.items(spark, sf))
    return rounded(out.select("name", "period", "indicator", "y", "prob"), 8)


@query
def log_likelihood(spark, sf):
    return rounded(model.log_likelihood(v.obs(spark, sf), v.theta(spark, sf), v.items(spark, sf)), 4)


@query
def log_likelihood_by_item(spark, sf):
    out = model.log_likelihood(v.obs(spark, sf), v.theta(spark, sf), v.items(spark, sf), ["indicator", "period"])
    return rounded(out, 5)


@query
def log_likelihood_by_entity(spark, sf):
    out = model.log_likelihood(v.obs(spark, sf), v.theta(spark, sf), v.items(spark, sf), ["name"])
    return rounded(out)


def _steps(spark, sf):
    """Innovations and scales per entity-period from account balances and file order."""
    p = v.panel_raw(spark, sf).select("name", "period", "c_acctbal", "row_ord")
    low, high = v.anchors(p)
    ep = panel.entity_periods(p)
    flagged = model.path_inputs(ep, panel.classify_starts(ep, low, high))
    return flagged.join(p, ["name", "period"]).select(
        "name", "period", "is_fresh", "pin",
        ((F.col("row_ord") % 7 - 3) / 2).alias("z"),
        F.lit(0.5).alias("sigma_init"),
        (0.1 + (F.abs("c_acctbal") % 10) / 100).alias("sigma"),
    )


@query
def rebuild_paths(spark, sf):
    return rounded(model.rebuild_paths(_steps(spark, sf)).select("name", "period", "theta"))


@query
def firm_scales(spark, sf):
    lines = v.table(spark, sf, "lineitem")
    global_scale = lines.groupBy(F.col("l_linenumber").alias("chain"), F.year("l_shipdate").alias("iteration")).agg(
        F.avg("l_discount").alias("sigma_global")
    )
    raw = lines.groupBy(
        F.col("l_linenumber").alias("chain"), F.year("l_shipdate").alias("iteration"), F.col("l_suppkey").alias("key")
    ).agg(F.avg("l_quantity").alias("raw"))
    return rounded(model.firm_scales(raw, global_scale).select("chain", "iteration", "key", "sigma"))


@query
def log_prior(spark, sf):
    steps = _steps(spark, sf).filter(F.col("pin").isNull()).select("z")
    scales = v.table(spark, sf, "customer").select((F.abs("c_acctbal") / 1000).alias("raw"))
    return rounded(model.log_prior(steps, v.items(spark, sf), scales, 0.7, 0.5), 4)


def _by_chain(draws):
    """The numbered draws of the views as two chains."""
    number = F.col("draw")
    return draws.select("*", (number % 2 + 1).alias("chain"), F.floor((number + 1) / 2).alias("iteration")).drop("draw")


@query
def log_likelihood_draws(spark, sf):
    out = model.log_likelihood_draws(
        v.obs(spark, sf), _by_chain(v.theta_draws(spark, sf, 10)), _by_chain(v.item_param_draws(spark, sf, 10)), per_chunk=3)
    return rounded(out, 4)


@query
def log_prior_draws(spark, sf):
    """Prior per draw: line numbers are chains and ship years iterations; quantities, discounts and taxes the parameters."""
    draws = v.table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("int").alias("chain"), F.year("l_shipdate").alias("iteration"), (F.col("l_quantity") / 25 - 1).alias("z"),
        (F.col("l_quantity") / 10 - 2.5).alias("alpha"), (20 * F.col("l_discount") - 1).alias("beta"), (10 * F.col("l_tax")).alias("raw"))
    hyper = draws.groupBy("chain", "iteration").agg(F.avg("raw").alias("sigma_global"), F.max("raw").alias("sigma_init"))
    return rounded(model.log_prior_draws(draws, draws, draws, hyper), 3)


@query
def waic(spark, sf):
    pw = model.pointwise_log_lik(
        v.obs(spark, sf), v.theta_draws(spark, sf), v.item_param_draws(spark, sf), per_chunk=3
    )
    return rounded(model.waic(pw), 4)


@query
def pointwise_log_lik(spark, sf):
    pw = model.pointwise_log_lik(v.obs(spark, sf), v.theta_draws(spark, sf), v.item_param_draws(spark, sf))
    return rounded(pw, 7)


@query
def additive_index(spark, sf):
    return model.additive_index(v.obs(spark, sf))


@query
def item_labels(spark, sf):
    items = panel.item_label(v.obs(spark, sf).select("indicator", "period").distinct())
    return items.select("item_col", is_concern(F.col("item_col")).alias("is_concern"))


# fits


def _panel_and_anchors(spark, sf):
    o = materialise(v.response_obs(spark, sf), "obs")
    return o, v.anchors(o)


@query
def fit_em(spark, sf):
    return rounded(fit.fit_em(*_panel_and_anchors(spark, sf)).require_converged().scores())


@query
def fit_em_items(spark, sf):
    return rounded(fit.fit_em(*_panel_and_anchors(spark, sf)).require_converged().item_params())


@query
def fit_em_static(spark, sf):
    return rounded(fit.fit_em(*_panel_and_anchors(spark, sf), dynamic=False).require_converged().scores())


@query
def fit_gibbs(spark, sf):
    return fit.fit_gibbs(*_panel_and_anchors(spark, sf)).draws


@query
def gibbs_convergence(spark, sf):
    """R-hat and effective sizes of fitted chains, by parameter."""
    got = fit.fit_gibbs(*_panel_and_anchors(spark, sf))
    return rounded(conv.convergence(materialise(got.draws, "gibbs-draws")))


@query
def fit_to_scores(spark, sf):
    """Fit, draw from the fit, summarise: the whole way from observations to a score table."""
    o, anchors = _panel_and_anchors(spark, sf)
    draws = materialise(fit.posterior_draws(fit.fit_em(o, anchors).require_converged(), 100), "fit-draws")
    ep = panel.dense_index(panel.entity_periods(o), ["name", "period"], "ep_idx")
    base = panel.period_base(o)
    table = panel.with_period_index(ep, base).select(F.col("name").alias("ticker"), "period_idx", "ep_idx")
    meta = ep.select("name", F.col("name").alias("ticker"), F.col("period").alias("year"))
    return posterior.scores(draws, table, meta, base)


# files


def _chain_lines(spark, sf):
    """Wide chain files as a sampler writes them: comments, a header, one line per draw.

    A draw is a ship day of one line number; the columns are a fixed, small set.
    """
    lines = v.table(spark, sf, "lineitem")
    qty = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    per = lines.groupBy(F.col("l_linenumber").alias("chain"), F.to_date("l_shipdate").alias("day")).agg(
        F.count("*").cast("double").alias("lp__"),
        F.sum("l_quantity").alias("energy__"),
        F.lit(0.0).alias("divergent__"),
        F.max("l_quantity").alias("treedepth__"),
        qty("A").alias("z_init.1"), qty("N").alias("theta.1"), qty("R").alias("theta.2"), qty("A").alias("theta.3"),
        F.min("l_quantity").alias("sigma_global"),
    )
    fields = per.columns[2:]
    body = per.select(
        "chain", F.datediff("day", F.lit("1990-01-01").cast("date")).alias("ord"),
        F.concat_ws(",", *[F.col(f"`{c}`").cast("string") for c in fields]).alias("value"),
    )
    heads = [(0, "# sampler settings"), (1, ",".join(fields)), (2, "# adaptation done"), (99999, "# elapsed")]
    extra = F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("value")) for o, t in heads]))
    top = per.select("chain").distinct().select("chain", extra.alias("_h")).select("chain", "_h.*")
    path = fresh_path(spark, "chain-text")
    (
        body.unionByName(top).repartition(v.N_CHAINS, "chain").sortWithinPartitions("chain", "ord")
        .select("chain", "value").write.partitionBy("chain").text(path)
    )
    return path


@query
def chain_text(spark, sf):
    """Chain files to long draws, to Parquet, and back."""
    draws = chain_files.read_chains(spark, _chain_lines(spark, sf) + "/*/*.txt")
    path = fresh_path(spark, "draws")
    chain_files.write_draws(draws, path)
    return chain_files.read_draws(spark, path)


@query
def chain_wide(spark, sf):
    """Chain files with a column per order line, more than Spark's CSV reader takes; of the stored draws an index range of one
    parameter is read."""
    lines = v.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    numbered = materialise(panel.dense_index(lines, ["l_orderkey", "l_linenumber"], "idx"), "wide-cells")
    # the lines are written in pieces of a thousand fields, as none of them fits in a row; a line's last piece holds the next one's first field
    cells = F.sort_array(F.collect_list(F.struct("idx", "q"))).alias("c")
    blocks = numbered.groupBy(F.floor((F.col("idx") - 1) / 1000).alias("block")).agg(cells)
    number = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("ord")
    rows = blocks.select("block", "c", number)
    rows = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("chain"))
    names = F.transform("c", lambda x: F.concat(F.lit("theta."), x["idx"].cast("string")))
    values = F.transform("c", lambda x: (x["q"] + F.col("chain") + F.col("ord") / 4).cast("string"))
    piece = F.concat_ws(",", F.when(F.col("ord") == 0, names).otherwise(values))
    n_cells = numbered.count()
    ends = F.when(F.col("block") != (n_cells - 1) // 1000, F.lit("")).when(F.col("ord") < 3, F.concat(F.lit("\n"), (F.col("ord") + 1).cast("string"))).otherwise(F.lit("\n# end"))
    begins = F.when((F.col("ord") == 0) & (F.col("block") == 0), F.lit("lp__,")).otherwise(F.lit(""))
    path = fresh_path(spark, "wide-text")
    text = rows.select("chain", "ord", "block", F.concat(begins, piece, ends).alias("value")).repartition("chain").sortWithinPartitions("chain", "ord", "block")
    text.select("chain", "value").write.partitionBy("chain").option("lineSep", ",").text(path)
    stored = fresh_path(spark, "wide-draws")
    chain_files.write_draws(chain_files.read_chains(spark, path + "/*/*.txt"), stored)
    return chain_files.read_draws(spark, stored, params=["theta"], first=20_001, last=40_000)


@query
def chain_parameters(spark, sf):
    draws = chain_files.read_chains(spark, _chain_lines(spark, sf) + "/*/*.txt")
    return chain_files.parameters(draws)


@query
def sampler_table(spark, sf):
    draws = chain_files.read_chains(spark, _chain_lines(spark, sf) + "/*/*.txt")
    return chain_files.sampler_table(draws)


@query
def file_sizes(spark, sf):
    path = _chain_lines(spark, sf)
    sizes = tables.file_sizes(spark, path, ".txt")
    return sizes.select("n_files", (F.col("n_bytes") > 0).alias("has_bytes"))


@query
def read_panel(spark, sf):
    """The raw panel written as CSV the way the source writes it, read and tidied again."""
    p = v.panel_raw(spark, sf)
    word = lambda c: F.when(F.col(c) == 1, "TRUE").when(F.col(c) == 0, "FALSE")
    out = p.repartitionByRange("row_ord").sortWithinPartitions("row_ord").select(
        F.lit("x").alias("CUSIP"), F.col("name").alias("CompanyName"),
        F.when(F.col("ticker") == "T5", "R").when(F.col("ticker").isNull(), "NA").otherwise(F.col("ticker")).alias("Ticker"),
        F.col("issuerid"), F.col("period").alias("year"), "pri_str_num",
        *[word(c).alias(c[:3].upper() + c[3:]) for c in v.INDICATORS[:5]], F.col("val_str_a").cast("double").alias("VAL_str_a"),
        F.col("val_con_a").alias("VAL_con_a"),
    )
    path = fresh_path(spark, "panel-csv")
    out.write.csv(path, header=True)
    tidy, indicators = panel_files.tidy_panel(panel_files.read_panel(spark, path), "pri_str_num")
    return tidy.select(
        "name", F.coalesce("ticker", F.lit("-")).alias("ticker"), F.coalesce("issuerid", F.lit("-")).alias("issuerid"),
        "period", "row_ord", *[F.coalesce(c, F.lit(-1)).alias(c) for c in indicators],
    )


@query
def write_scores(spark, sf):
    """Score CSV written in order and read back as text."""
    s = posterior.scores(v.draw_values(spark, sf), v.ep_table(spark, sf), v.meta(spark, sf), v.EP_BASE)
    path = fresh_path(spark, "scores-csv")
    tables.write_scores(rounded(s, 4), path)
    back = spark.read.csv(path, header=True)
    return back.select("name", "ticker", F.col("year").cast("int").alias("year"), *[F.col(c).cast("double").alias(c) for c in s.columns[3:]])


@query
def write_item_params(spark, sf):
    """Item CSV written in order and read back as text."""
    params = rounded(posterior.item_params(v.item_draws(spark, sf), v.item_table(spark, sf), v.EP_BASE))
    path = fresh_path(spark, "items-csv")
    tables.write_item_params(params, path)
    back = spark.read.csv(path, header=True)
    return back.select(*[F.col(c).cast(t).alias(c) for c, t in params.dtypes])


@query
def table_hand_off(spark, sf):
    """Panel tables written for the next step and loaded again."""
    folder = fresh_path(spark, "hand-off")
    o = v.obs(spark, sf)
    tables.save_tables({"obs": o, "items": clean.items_by_period(o)}, folder)
    back = tables.load_table(spark, folder, "items")
    sums = tables.load_table(spark, folder, "obs").groupBy("period", "indicator").agg(F.sum("y").alias("n_ones"))
    return back.join(sums, ["period", "indicator"])
