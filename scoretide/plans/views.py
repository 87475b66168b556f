"""The test tables in the roles of the panel's inputs.

Customers are entities, order years are periods, suppliers are parameters and
line numbers are chains. Everything is a narrow Spark plan over the
given Parquet tables, so the work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoretide.functions.normal import normal_cdf
from scoretide.functions.values import clamp_binary, is_concern
from scoretide.operators import clean
from scoretide.operators.spread import group_positions
from scoretide.session import materialise

INDICATORS = ["pri_str_a", "pri_str_b", "pri_con_a", "sta_str_a", "sta_con_a", "val_str_a", "val_con_a"]
N_CHAINS = 7
DRAW_ORDER = ["l_orderkey", "l_partkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus"]
SAMPLER_ORDER = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]
EP_BASE = 1990


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panel_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer and order year. Orders are reduced before the join to customers."""
    price = F.col("o_totalprice")
    flag = lambda column, value: F.max((F.col(column) == value).cast("int"))
    per = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("period")).agg(
        F.min("o_orderkey").alias("row_ord"),
        flag("o_orderpriority", "1-URGENT").alias("pri_str_a"),
        flag("o_orderpriority", "2-HIGH").alias("pri_str_b"),
        flag("o_orderpriority", "5-LOW").alias("pri_con_a"),
        flag("o_orderstatus", "F").alias("sta_str_a"),
        flag("o_orderstatus", "P").alias("sta_con_a"),
        F.sum((price > 250000).cast("int")).cast("int").alias("val_str_a"),
        F.sum((price < 50000).cast("int")).cast("int").alias("_cheap"),
        F.count("*").cast("int").alias("pri_str_num"),
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    key = F.col("c_custkey")
    return per.join(customer, per["o_custkey"] == customer["c_custkey"]).select(
        F.col("c_name").alias("name"),
        F.when(key % 97 != 13, F.concat(F.lit("T"), (key % 97).cast("string"))).alias("ticker"),
        F.when(F.col("period") >= 2000, F.concat(F.lit("I"), key.cast("string"))).alias("issuerid"),
        "period", "row_ord", "c_acctbal", *INDICATORS[:-1],
        F.when(F.col("period") >= 1997, F.col("_cheap")).alias("val_con_a"),
        "pri_str_num",
    )


def panel_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw panel without its count columns, indicators clamped to 0/1."""
    kept = clean.drop_count_columns(panel_raw(spark, sf_dir))
    return clean.normalise_indicators(kept, INDICATORS)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.to_long(panel_clean(spark, sf_dir), INDICATORS)


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations before clamping."""
    return clean.to_long(panel_raw(spark, sf_dir), INDICATORS)


def _true_theta():
    return (F.col("c_acctbal") - 4500) / 4500 + 0.05 * (F.col("period") - 1998)


def theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed scores for the scoring operators; not a fit."""
    return panel_raw(spark, sf_dir).select("name", "period", _true_theta().alias("theta"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = obs(spark, sf_dir).select("indicator", "period").distinct()
    return found.select(
        "indicator", "period",
        (0.02 * (F.col("period") - 1998)).alias("alpha"),
        F.when(is_concern(F.col("indicator")), -0.5).otherwise(0.8).alias("beta"),
    )


def draw_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta draws without their iteration, for summaries that do not need it."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("theta").alias("param"), F.col("l_suppkey").alias("idx"),
        F.col("l_linenumber").alias("chain"), F.col("l_extendedprice").alias("value"),
    )


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theta draws: a supplier's lines in a total order, dealt in turn to chains of one length.

    A supplier has the most chains, four at most, that its number of lines can be shared out to evenly; so
    every line is a draw and none is left over.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", *DRAW_ORDER)
    placed = group_positions(lines, ["l_suppkey"], [*DRAW_ORDER, "l_linenumber"], "place")
    counts = lines.groupBy("l_suppkey").agg(F.count("*").alias("n"))
    chains = F.coalesce(*[F.when(F.col("n") % c == 0, F.lit(c)) for c in (4, 3, 2, 1)])
    dealt = placed.join(counts, "l_suppkey").withColumn("n_chains", chains)
    # a table, as draws are in use: several passes read it
    return materialise(dealt.select(
        F.lit("theta").alias("param"), F.col("l_suppkey").alias("idx"),
        ((F.col("place") - 1) % F.col("n_chains") + 1).cast("int").alias("chain"),
        F.floor((F.col("place") - 1) / F.col("n_chains") + 1).alias("iteration"), F.col("l_extendedprice").alias("value"),
    ), "draws")


def item_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha and beta draws per part, in long form."""
    lines = table(spark, sf_dir, "lineitem")
    both = F.explode(F.array(
        F.struct(F.lit("alpha").alias("param"), (F.col("l_quantity") / 10 - 2.5).alias("value")),
        F.struct(F.lit("beta").alias("param"), (20 * F.col("l_discount") - 1).alias("value")),
    ))
    return lines.select(
        F.col("l_partkey").alias("idx"), F.col("l_linenumber").alias("chain"), both.alias("_d")
    ).select("_d.param", "idx", "chain", "_d.value")


def sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence, tree depth and energy per draw. A chain is a large part of the
    table, so its positions come from the spread path beyond the hot limit."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_linenumber", "l_quantity", *SAMPLER_ORDER
    )
    placed = group_positions(lines, ["l_linenumber"], SAMPLER_ORDER, "iteration")
    return placed.select(
        F.col("l_linenumber").alias("chain"), "iteration",
        (F.col("l_tax") > 0.079).cast("int").alias("divergent"),
        F.floor(F.col("l_quantity") / 5).cast("int").alias("treedepth"),
        F.col("l_extendedprice").alias("energy"),
    )


def ep_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entity-periods: the nation is the key, the position by name within it the period."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    placed = group_positions(s, ["s_nationkey"], ["s_suppkey"], "period_idx")
    return placed.select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("ticker"),
        F.col("period_idx").cast("int").alias("period_idx"), F.col("s_suppkey").alias("ep_idx"),
    )


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names per key and year, with repeated rows as in a firm-year file."""
    named = table(spark, sf_dir, "nation").select(
        F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("ticker"), F.col("n_name").alias("name")
    )
    ep = ep_table(spark, sf_dir).withColumn("year", (F.col("period_idx") + EP_BASE).cast("int"))
    rows = ep.join(named, "ticker").filter(F.col("period_idx") % 5 != 0)
    return rows.select("name", "ticker", "year", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))


def item_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items, labelled strength or concern by size."""
    label = F.when(F.col("p_size") % 2 == 0, F.lit("par_str_")).otherwise(F.lit("par_con_"))
    return table(spark, sf_dir, "part").select(
        F.concat(label, F.col("p_partkey").cast("string")).alias("item_col"),
        (F.col("p_size") % 7 + 1).cast("int").alias("period_idx"), F.col("p_partkey").alias("item_idx"),
    )


def response_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations for the fits: each of a panel's responses drawn from the model itself, with the fixed scores and three times the
    fixed discriminations, by a number in (0, 1) that hangs on the observation alone. The orders' own flags hold no
    signal that scores could follow."""
    mu = 3 * F.col("beta") * F.col("theta") - F.col("alpha")
    bits = F.shiftrightunsigned(F.xxhash64("name", "period", "indicator"), 11).cast("double")
    scored = obs(spark, sf_dir).select("name", "period", "indicator").join(theta(spark, sf_dir), ["name", "period"])
    scored = scored.join(F.broadcast(items(spark, sf_dir)), ["indicator", "period"])  # one row per indicator and year
    y = ((bits + 0.5) / float(2**53) < normal_cdf(mu)).cast("int")
    return scored.select("name", "period", "indicator", y.alias("y"))


def anchors(panel: DataFrame) -> tuple[str, str]:
    """The first and last name that are present in every period."""
    n_periods = panel.select("period").distinct().count()
    full = panel.select("name", "period").distinct().groupBy("name").count().filter(F.col("count") == n_periods)
    row = full.agg(F.min("name"), F.max("name")).first()
    return row[0], row[1]


def theta_draws(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    """``n`` draws around the fixed scores."""
    d = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")
    return theta(spark, sf_dir).select("name", "period", "theta", d).withColumn(
        "theta", F.col("theta") + 0.1 * (F.col("draw") - (n + 1) / 2)
    )


def item_param_draws(spark: SparkSession, sf_dir: str, n: int = 4) -> DataFrame:
    d = F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw")
    return items(spark, sf_dir).select("indicator", "period", "alpha", "beta", d).withColumns({
        "alpha": F.col("alpha") + 0.05 * (F.col("draw") - 2),
        "beta": F.col("beta") * (1 + 0.1 * (F.col("draw") - 2)),
    })
