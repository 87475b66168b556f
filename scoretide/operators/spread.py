"""Ranks, running sums, quantiles and lags that stay distributed for hot groups.

A window over a group puts that whole group into one task. That is the right
plan while groups are small, and the wrong one when a single key holds a large
share of all rows. The functions here measure the largest group first. Up to
``hot_rows`` they use the plain window or aggregate; beyond it they range
partition by (group, order), so that a big group is cut over many tasks, and
carry per-partition totals forward. Both ways give the same, exact result.
Callers that have measured already pass ``hot`` and spare the second count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from scoretide.session import materialise, ship_code

# Largest group that one task may hold; a real chain set has about 10,000
# draws per parameter, so ordinary inputs stay below it.
HOT_ROWS = 100_000
# Rows per range partition on the spread path.
PART_ROWS = 1_000_000
# Rows of a task that sorts or groups them in memory.
TASK_ROWS = 500_000
# Rows and bytes of a table that may be broadcast after its size was counted.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
FIXED_BYTES = 16  # of a value of fixed width with what Spark keeps beside it


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: lengths of text and arrays, a constant for the rest."""
    total = F.lit(FIXED_BYTES)
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif kind.startswith("array"):
            total = total + F.greatest(F.coalesce(F.size(column), F.lit(0)), F.lit(0)) * FIXED_BYTES
        else:
            total = total + FIXED_BYTES
    return total.cast("long")


def bounded_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the counted table is small in rows and bytes; else leave the join to shuffle."""
    rows, size = df.select(_bytes(df).alias("_size")).limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum("_size"), F.lit(0))).first()
    # without the hint a table that is small on disk, but large in rows, would be broadcast all the same
    return F.broadcast(df) if rows <= limit and size <= most else df.hint("merge")


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows in the largest group, rows in all) as two numbers on the driver."""
    row = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return (row[0] or 0, row[1] or 0)


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that so many rows are dealt to where the number must not depend on what the session sets for shuffles: a task's
    memory then stays the same as the table grows."""
    return max(spark.sparkContext.defaultParallelism, rows // TASK_ROWS + 1)


def is_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> bool:
    return group_sizes(df, keys)[0] > hot_rows


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys match each other; the right side's key columns are dropped."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(other[f"_right_{k}"])
    return left.join(other, cond, how).drop(*[f"_right_{k}" for k in keys])


def _spread(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows cut into ranges of (keys, order), with their range and place written beside them.

    The input is written first: counting it and sampling the range bounds then
    read a table and do not run the plan before it again.
    """
    spark = df.sparkSession
    base = materialise(df, "spread-in")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.count() // PART_ROWS + 1)
    cut = base.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    # a range shuffle samples its bounds, so range and place must not be computed twice
    return materialise(
        cut.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()),
        "spread",
    )


def _starts(cut: DataFrame, keys: list[str], weight: Column) -> DataFrame:
    """Per (partition, group): first row position and the weight in earlier partitions."""
    totals = cut.groupBy("_part", *keys).agg(F.min("_row").alias("_first"), F.sum(weight).alias("_sum"))
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.withColumn("_before", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")


def group_positions(
    df: DataFrame, keys: list[str], order: list[str], out: str = "pos", hot: bool | None = None
) -> DataFrame:
    """1-based position of every row in its group, in the given order.

    With no keys this is a dense index over the whole table, which always
    takes the range-partitioned way: an unpartitioned window would pull every
    row into one task.
    """
    rows = None
    if keys and hot is None:
        largest, rows = group_sizes(df, keys)
        hot = largest > HOT_ROWS
    if keys and not hot:
        window = Window.partitionBy(*keys).orderBy(*order)
        dealt = df if rows is None else df.repartition(tasks_for(df.sparkSession, rows), *keys)
        return dealt.withColumn(out, F.row_number().over(window).cast("long"))
    cut = _spread(df, keys, order)
    joined = join_null_safe(cut, _starts(cut, keys, F.lit(1)), ["_part", *keys])
    pos = F.col("_before") + F.col("_row") - F.col("_first") + 1
    return joined.select(*df.columns, pos.cast("long").alias(out))


def _numbered(key: str):
    """Adds to the sorted rows of a task its number, their place from 1, and how many different keys there were so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, keys, last = TaskContext.get().partitionId(), 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(key).dictionary_encode("encode").indices.to_numpy()
            new = np.concatenate([[rows == 0 or b.column(key)[0].as_py() != last], codes[1:] != codes[:-1]])
            n, last = b.num_rows, b.column(key)[b.num_rows - 1].as_py()
            own = [np.full(n, part, dtype=np.int32), rows + np.arange(1, n + 1), keys + np.cumsum(new)]
            rows, keys = rows + n, int(own[2][-1])
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, own)], names=[*b.schema.names, "_part", "_row", "_key"])

    return run


def nested_index(df: DataFrame, key: str, order: list[str], row_out: str, key_out: str) -> DataFrame:
    """Dense ids from 1 of the rows by (key, order) and of the keys themselves, from one range sort.

    A task numbers its range in a single pass; ranges then learn how many rows and keys came before them, where a key that goes
    on from one range to the next counts once. One row per range is all that is gathered for that.
    """
    spark = df.sparkSession
    ship_code(spark)
    base = materialise(df, "index-in")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), base.count() // PART_ROWS + 1)
    schema = T.StructType([*base.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_row", T.LongType()), T.StructField("_key", T.LongType())])
    cut = base.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    cut = materialise(cut.mapInArrow(_numbered(key), schema), "index")
    ranges = cut.groupBy("_part").agg(F.count("*").alias("n"), F.max("_key").alias("k"), F.min_by(key, "_row").alias("first"), F.max_by(key, "_row").alias("last"))
    line = Window.partitionBy(F.lit(0)).orderBy("_part")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.lag("_part").over(line).isNotNull() & F.lag("last").over(line).eqNullSafe(F.col("first"))
    ranges = ranges.withColumn("on", goes_on.cast("long")).select(
        "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows"),
        (F.coalesce(F.sum("k").over(before), F.lit(0)) - F.sum("on").over(line)).alias("_keys"))
    return cut.join(F.broadcast(ranges), "_part").select(
        *df.columns, (F.col("_row") + F.col("_rows")).alias(row_out), (F.col("_key") + F.col("_keys")).alias(key_out))


def nested_offsets(df: DataFrame, key: str, weight: str, row_out: str, first_out: str) -> DataFrame:
    """Dense ids from 1 of rows with different keys, in the order of ``key``, and 1 plus the weight of all rows before each:
    the first id of ``weight`` inner rows that are not there themselves. One range sort serves both."""
    cut = _spread(df, [], [key])
    totals = cut.groupBy("_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"), F.sum(weight).alias("_w"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = totals.select("_part", "_first", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_before{c}") for c in ("_n", "_w")])
    upto = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    own = cut.withColumn("_inside", F.coalesce(F.sum(weight).over(upto), F.lit(0)))
    return own.join(F.broadcast(starts), "_part").select(
        *df.columns, (F.col("_before_n") + F.col("_row") - F.col("_first") + 1).alias(row_out),
        (F.col("_before_w") + F.col("_inside") + 1).alias(first_out))


def running_total(
    df: DataFrame, keys: list[str], value: str, weight: str, out: str = "cum", hot: bool | None = None
) -> DataFrame:
    """Sum of ``weight`` over the rows of the group whose value is at most this row's."""
    if not (is_hot(df, keys) if hot is None else hot):
        upto = Window.partitionBy(*keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(weight).over(upto))
    cut = _spread(df, keys, [value])
    joined = join_null_safe(cut, _starts(cut, keys, F.col(weight)), ["_part", *keys])
    # Equal (group, value) rows share a range partition, so ties stay whole.
    upto = Window.partitionBy("_part", *keys).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(out, F.col("_before") + F.sum(weight).over(upto)).select(*df.columns, out)


def average_ranks(
    df: DataFrame, keys: list[str], value: str, weight: str, out: str = "rank", hot: bool | None = None
) -> DataFrame:
    """Average rank (ties share one) of rows that each stand for ``weight`` equal values.

    Callers collapse equal values first, so a peer group is as small as the
    columns left in ``df``.
    """
    ties = Window.partitionBy(*keys, value)
    ranked = running_total(df, keys, value, weight, "_cum", hot)
    rank = F.col("_cum") - (F.sum(weight).over(ties) - 1) / 2.0
    return ranked.withColumn(out, rank).drop("_cum")


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "q", hot: bool | None = None
) -> DataFrame:
    """Exact interpolated quantiles (R type 7) per group as one array column."""
    if not (is_hot(df, keys) if hot is None else hot):
        return df.groupBy(*keys).agg(F.percentile(value, probs).alias(out))
    return _spread_quantiles(df, keys, value, probs, out)


def _spread_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], out: str) -> DataFrame:
    known = df.filter(F.col(value).isNotNull())
    tied = known.groupBy(*keys, value).agg(F.count("*").alias("_w"))
    cum = running_total(tied, keys, value, "_w", "_cum", hot=True)
    ranked = join_null_safe(cum, known.groupBy(*keys).agg(F.count("*").alias("_n")), keys)

    def at_rank(rank: Column) -> Column:
        # the value that covers the 0-based rank
        covers = (F.col("_cum") > rank) & (F.col("_cum") - F.col("_w") <= rank)
        return F.max(F.when(covers, F.col(value)))

    aggs, quantiles = [F.max("_n").alias("_n")], []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        aggs += [at_rank(F.floor(h)).alias(f"_lo{i}"), at_rank(F.ceil(h)).alias(f"_hi{i}")]
        share = h - F.floor(h)
        between = (1 - share) * F.col(f"_lo{i}") + share * F.col(f"_hi{i}")  # as percentile does
        quantiles.append(F.when(share == 0, F.col(f"_lo{i}")).otherwise(between))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, F.array(*quantiles).alias(out))


def blocked_lag(
    df: DataFrame, keys: list[str], order: str, value: str, out: str = "prev", width: int = HOT_ROWS
) -> DataFrame:
    """Previous value within the group, by an integer order column.

    A group is cut into blocks of ``width`` order values; only the last row of
    each block crosses over to the next block, so no task holds a whole group.
    """
    cut = df.withColumn("_block", F.floor(F.col(order) / width))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    cut = cut.withColumn(out, F.lag(value).over(inside)).withColumn("_first", F.row_number().over(inside) == 1)
    tails = cut.groupBy(*keys, "_block").agg(F.max_by(value, order).alias("_tail"))
    tails = tails.withColumn("_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_block")))
    joined = cut.join(tails, [*keys, "_block"], "left")
    return joined.select(
        *df.columns, F.when(F.col("_first"), F.col("_tail")).otherwise(F.col(out)).alias(out)
    )
