"""The long panel: observations, dimension tables, transitions, starts and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoretide.operators.spread import group_positions, nested_index, tasks_for

# A wide table's column names live on the driver; more items or periods than this are refused.
MAX_WIDE_COLUMNS = 10_000
MAX_PERIODS = 10_000


def subset_periods(obs: DataFrame, first: int, last: int) -> DataFrame:
    return obs.filter(F.col("period").between(first, last))


def period_base(df: DataFrame, period: str = "period") -> int:
    """The year before the first one, so that period indexes start at 1."""
    return df.agg(F.min(period)).first()[0] - 1


def with_period_index(df: DataFrame, base: int, period: str = "period") -> DataFrame:
    return df.withColumn("period_idx", (F.col(period) - base).cast("int"))


def to_calendar(df: DataFrame, base: int, out: str = "year") -> DataFrame:
    return df.withColumn(out, (F.col("period_idx") + base).cast("int"))


def item_label(df: DataFrame) -> DataFrame:
    """``indicator_period``, the name of a wide column."""
    return df.withColumn("item_col", F.concat_ws("_", "indicator", F.col("period").cast("string")))


def to_wide(obs: DataFrame, key: str = "name", most: int = MAX_WIDE_COLUMNS) -> DataFrame:
    """One row per key and one column per item; only for panels with few items. Keys are dealt to as many tasks as the rows need, as a
    task holds a wide row for each of its keys."""
    labelled = item_label(obs)
    found = labelled.groupBy("period", "indicator", "item_col").agg(F.count("*").alias("n")).orderBy("period", "indicator")
    items = found.limit(most + 1).collect()
    names = [r["item_col"] for r in items]
    if len(names) > most:
        raise ValueError(f"more than {most} items: keep the panel long")
    dealt = labelled.repartition(tasks_for(obs.sparkSession, sum(r["n"] for r in items)), key)
    return dealt.groupBy(key).pivot("item_col", names).agg(F.max("y"))


def from_wide(wide: DataFrame, key: str = "name") -> DataFrame:
    """Wide columns ``indicator_period`` back to observations."""
    items = [c for c in wide.columns if c != key]
    long = wide.unpivot([key], items, "item_col", "y").filter(F.col("y").isNotNull())
    return long.select(
        key,
        F.regexp_extract("item_col", r"_(\d+)$", 1).cast("int").alias("period"),
        F.regexp_extract("item_col", r"^(.*)_\d+$", 1).alias("indicator"),
        "y",
    )


def complete_panel(df: DataFrame, key: str = "name", period: str = "period", most: int = MAX_PERIODS) -> DataFrame:
    """Every key in every period; the periods a key lacks get NULL in all other columns.

    The periods are few and go into the plan as one array, so keys are
    expanded row by row and no product of two tables is formed.
    """
    rows = df.select(period).distinct().limit(most + 1).collect()
    periods = sorted(r[0] for r in rows)
    if len(periods) > most:
        raise ValueError("too many periods to complete the panel")
    frame = df.select(key).distinct().withColumn(period, F.explode(F.array(*[F.lit(p) for p in periods])))
    return frame.join(df, [key, period], "left").select(*df.columns)


def entity_periods(obs: DataFrame, key: str = "name") -> DataFrame:
    """The (key, period) pairs that have any observation."""
    return obs.select(key, "period").distinct()


def _by_key(key: str) -> Window:
    # A key has at most one row per period here, so the window stays small.
    return Window.partitionBy(key).orderBy("period")


def with_previous(ep: DataFrame, key: str = "name") -> DataFrame:
    """Adds the key's previous period and whether this one starts a new run."""
    prev = F.lag("period").over(_by_key(key))
    return ep.withColumn("prev_period", prev).withColumn(
        "is_fresh", F.col("prev_period").isNull() | (F.col("period") > F.col("prev_period") + 1)
    )


def transitions(ep: DataFrame, key: str = "name") -> DataFrame:
    """Pairs of consecutive periods of one key."""
    return with_previous(ep, key).filter(~F.col("is_fresh")).select(key, "prev_period", "period")


def fresh_starts(ep: DataFrame, key: str = "name") -> DataFrame:
    """First appearances and the periods that follow a gap."""
    return with_previous(ep, key).filter("is_fresh").select(key, "period", "prev_period")


def require_keys(ep: DataFrame, keys: list[str], key: str = "name") -> None:
    found = {r[0] for r in ep.filter(F.col(key).isin(keys)).select(key).distinct().collect()}
    missing = [k for k in keys if k not in found]
    if missing:
        raise ValueError(f"anchors not in the data, so the direction cannot be fixed: {missing}")


def classify_starts(ep: DataFrame, negative: str, positive: str, key: str = "name") -> DataFrame:
    """Fresh starts with the anchors' first one pinned to -1 or +1 and all else free."""
    require_keys(ep, [negative, positive], key)
    starts = fresh_starts(ep, key)
    first = F.col("prev_period").isNull()
    pin = F.when(first & (F.col(key) == negative), -1.0).when(first & (F.col(key) == positive), 1.0)
    return starts.withColumn("pin", pin).withColumn(
        "kind", F.when(F.col("pin").isNull(), "free").otherwise("pinned")
    )


def with_runs(ep: DataFrame, key: str = "name") -> DataFrame:
    """Numbers the gap-free runs of every key from 1."""
    fresh = with_previous(ep, key)
    return fresh.withColumn("run", F.sum(F.col("is_fresh").cast("int")).over(_by_key(key)))


def dense_index(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Ids 1..n over a total order, without sorting everything in one task."""
    return group_positions(df, [], order, out)


def entity_table(ep: DataFrame, key: str = "name") -> DataFrame:
    return dense_index(ep.select(key).distinct(), [key], "entity_idx")


def item_table(obs: DataFrame) -> DataFrame:
    items = item_label(obs.select("period", "indicator").distinct())
    return dense_index(items, ["period", "item_col"], "item_idx")


def entity_period_table(ep: DataFrame, key: str = "name") -> DataFrame:
    """(key, period) with its dense id and its key's dense id, both from one sort."""
    return nested_index(ep, key, ["period"], "ep_idx", "entity_idx")


def index_observations(obs: DataFrame, ep_table: DataFrame, items: DataFrame, key: str = "name") -> DataFrame:
    """Observations with the ids of their entity-period, entity and item."""
    return obs.join(ep_table, [key, "period"], "left").join(items, ["indicator", "period"], "left")


def panel_dims(obs: DataFrame, anchors: tuple[str, ...] = (), key: str = "name") -> DataFrame:
    """One row of sizes. The first start of every anchor that is there is pinned, all other starts are free.

    Everything but the item count comes from one pass over the entity-periods, which partial aggregation has already
    made small.
    """
    per = obs.groupBy(key, "period").agg(F.count("*").alias("n"))
    flagged = with_previous(per, key)
    n = lambda cond: F.count_if(cond)
    pinned = F.col("prev_period").isNull() & F.col(key).isin(*anchors) if anchors else F.lit(False)
    sizes = flagged.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_obs"),
        F.count("*").alias("n_entity_periods"),
        n(F.col("prev_period").isNull()).alias("n_entities"),
        n(F.col("is_fresh") & ~pinned).alias("n_free_starts"),
        n(~F.col("is_fresh")).alias("n_transitions"),
        F.lit(0).cast("long").alias("n_items"),
    )
    items = obs.select("indicator", "period").distinct().agg(F.count("*").alias("n_items"))
    zeros = [F.lit(0).cast("long").alias(c) for c in sizes.columns[:-1]]
    both = sizes.unionByName(items.select(*zeros, "n_items"))
    return both.agg(*[F.sum(c).alias(c) for c in sizes.columns])


def coverage(obs: DataFrame, key: str = "name") -> DataFrame:
    """Per period: entities, items, observations and the share of ones."""
    per = obs.groupBy("period", key).agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    left = per.groupBy("period").agg(
        F.count("*").alias("n_entities"), F.sum("n").alias("n_obs"), F.sum("ones").alias("n_ones")
    )
    right = obs.select("period", "indicator").distinct().groupBy("period").agg(F.count("*").alias("n_items"))
    return left.join(right, "period").withColumn("share_ones", F.col("n_ones") / F.col("n_obs"))
