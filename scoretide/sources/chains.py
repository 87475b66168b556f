"""Chain files: wide sampler CSVs to long draws, and draws as Parquet."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoretide.functions.values import param_index, param_name
from scoretide.operators.spread import bounded_broadcast
from scoretide.session import materialise, ship_code
from scoretide.sources.lines import SPLIT, with_split

# Sampler internals that nothing downstream reads.
INTERNAL = r"^(z_init|z_trans|sigma_firm_raw)[.\[]"
NO_VALUE = r"^\s*(?i:NA|NaN)?\s*$"
EXCLUDED = "profile"
# file:/x and file:///x name the same local file
LOCAL_SCHEME = r"^file:/+"
SAMPLER_FIELDS = {"divergent__": "divergent", "treedepth__": "treedepth", "energy__": "energy"}


def chain_files(spark: SparkSession, path: str, exclude: str = EXCLUDED) -> list[str]:
    """Chain files in name order; their position is the chain number."""
    found = sorted(re.sub(LOCAL_SCHEME, "/", f) for f in spark.read.text(path).inputFiles() if exclude not in f.rsplit("/", 1)[-1])
    if not found:
        raise FileNotFoundError(f"no chain files under {path}")
    return found


def _fields(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts between commas, in file order, cut at line breaks: fields with the number of their line within the split (0 goes on from the
    split before) and their place within that line's part of the split."""
    where, part, at = None, 0, 0
    for b in batches:
        files, blocks = b.column("_file").to_pylist(), b.column("_block").to_pylist()
        edges = [i for i in range(len(files)) if i == 0 or (files[i], blocks[i]) != (files[i - 1], blocks[i - 1])] + [len(files)]
        for low, high in zip(edges, edges[1:]):
            if (files[low], blocks[low]) != where:
                where, part, at = (files[low], blocks[low]), 0, 0
            cut = pc.split_pattern(b.column("value").slice(low, high - low), "\n")
            n = np.diff(cut.offsets.to_numpy())
            breaks = np.ones(int(n.sum()), dtype=np.int64)
            breaks[np.cumsum(n) - n] = 0  # each text's first piece goes on with the line of the text before
            number, place = part + np.cumsum(breaks), np.arange(len(breaks))
            line_start = np.maximum.accumulate(np.where(breaks == 1, place, -at))
            places = place - line_start
            part, at = int(number[-1]), int(places[-1]) + 1
            cells = cut.flatten()
            if pc.any(pc.ends_with(cells, "\r")).as_py():
                cells = pc.replace_substring_regex(cells, "\r$", "")
            yield pa.RecordBatch.from_arrays(
                [pa.array([where[0]] * len(breaks), pa.string()), pa.array(np.full(len(breaks), where[1], dtype=np.int64)), pa.array(number), pa.array(places),
                 cells.cast(pa.string())], names=["_file", "_block", "_part", "_at", "cell"])


def _placed_fields(spark: SparkSession, files: list[str]) -> DataFrame:
    """(_file, line, pos, cell): every field of the files with its line and its place there, both from 0.

    Files are read in splits at commas and not at line breaks, so a line can be far longer than a task may hold. One row per split says
    how many lines begin before it, and how many fields its first line has had by then.
    """
    ship_code(spark)
    text = with_split(spark.read.option("lineSep", ",").text(files))
    fields = materialise(text.mapInArrow(_fields, "_file string, _block long, _part long, _at long, cell string"), "chain-fields")
    splits = fields.groupBy(*SPLIT).agg(F.max("_part").alias("breaks"), (F.max(F.struct("_part", "_at"))["_at"] + 1).alias("tail"))
    order = Window.partitionBy("_file").orderBy("_block")  # one row per split
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    # what a split leaves to the line that is open at its end; sums since the last split in which a line ended
    splits = splits.select(*SPLIT, "breaks", before("breaks").alias("_lines"), before("tail").alias("_all"))
    since = F.coalesce(F.max(F.when(F.col("breaks") > 0, F.col("_all"))).over(earlier), F.lit(0))
    splits = splits.withColumn("_open", F.col("_all") - since).drop("breaks", "_all")
    return fields.join(bounded_broadcast(materialise(splits, "splits")), SPLIT).select(
        "_file", (F.col("_lines") + F.col("_part")).alias("line"),
        (F.col("_at") + F.when(F.col("_part") == 0, F.col("_open")).otherwise(0)).alias("pos"), "cell")


def read_chains(spark: SparkSession, path: str, drop: str | None = INTERNAL) -> DataFrame:
    """Long draws (chain, iteration, param, idx, value) from wide chain CSVs; a scalar parameter has index 0.

    A chain file can have more columns than the CSV reader takes, and a line more fields than a task can hold, so files are read field by
    field. The first line of a file that is no comment is its header, and its cells are named by that header, so files may order their
    columns differently. Dropped columns leave in the join with the headers. Iteration is the line's position
    among the file's data lines. A file without a header, a line with more or fewer fields than its header and a cell
    that is no number (but for NA, NaN and empty ones, which are NULL or NaN) are errors.
    """
    files = chain_files(spark, path)
    fields = _placed_fields(spark, files)
    names = spark.createDataFrame([(f, k + 1) for k, f in enumerate(files)], "_path string, chain int")
    # one row per line; a chain has as many as draws
    lines = fields.groupBy("_file", "line").agg(F.count("*").cast("int").alias("n_fields"), F.max(F.when(F.col("pos") == 0, F.col("cell"))).alias("_start"))
    lines = lines.filter(~F.col("_start").startswith("#") & ((F.col("n_fields") > 1) | (F.length("_start") > 0)))
    lines = lines.withColumn("_line", F.row_number().over(Window.partitionBy("_file").orderBy("line")))
    lines = lines.withColumn("_path", F.regexp_replace("_file", LOCAL_SCHEME, "/")).join(bounded_broadcast(names), "_path")
    width = F.max(F.when(F.col("_line") == 1, F.col("n_fields"))).over(Window.partitionBy("chain"))
    lines = materialise(lines.select("_file", "line", "_line", "chain", "n_fields", width.alias("width")), "chain-lines")
    split = fields.join(bounded_broadcast(lines), ["_file", "line"])

    field = F.when(F.col("cell").try_cast("double").isNotNull(), F.raise_error(F.concat(F.lit("no header in chain file "), F.col("chain").cast("string")))).otherwise(F.col("cell"))
    headers = materialise(split.filter("_line = 1").select("chain", "pos", field.alias("field")).select(
        "chain", "pos", "field", param_name(F.col("field")).alias("param"),
        F.coalesce(param_index(F.col("field")), F.lit(0)).cast("long").alias("idx"),
    ), "chain-headers")
    if drop:
        headers = headers.filter(~F.col("field").rlike(drop))

    where = F.concat(F.lit("chain file "), F.col("chain").cast("string"), F.lit(", draw "), F.col("iteration").cast("string"))
    data = split.filter("_line > 1").withColumn("iteration", F.col("_line") - 1)
    whole = F.when(F.col("n_fields") == F.col("width"), F.col("cell")).otherwise(F.raise_error(F.concat(where, F.lit(" has a wrong number of fields"))))
    # broken lines are told before the join with the headers, in which their fields could be lost
    cells = data.select("chain", "iteration", "pos", whole.alias("cell"))
    kept = cells.join(bounded_broadcast(headers.drop("field")), ["chain", "pos"])
    value = F.col("cell").try_cast("double")
    number = F.when(value.isNull() & ~F.col("cell").rlike(NO_VALUE), F.raise_error(F.concat(where, F.lit(" holds a cell that is no number")))).otherwise(value)
    return kept.select("chain", "iteration", "param", "idx", number.alias("value"))


def write_draws(draws: DataFrame, path: str) -> None:
    """Parquet split by parameter name and sorted by index, so that reading a few
    indexes touches a few row groups. Range partitioning cuts a big parameter over files."""
    (
        draws.repartitionByRange("param", "idx", "chain", "iteration")
        .sortWithinPartitions("param", "idx", "chain", "iteration")
        .write.partitionBy("param").parquet(path)
    )


def read_draws(spark: SparkSession, path: str, params: list[str] | None = None, first: int | None = None,
               last: int | None = None) -> DataFrame:
    """Draws of some parameters and an index range: partition pruning plus pushed filters."""
    df = spark.read.parquet(path)
    if params is not None:
        df = df.filter(F.col("param").isin(params))
    if first is not None:
        df = df.filter(F.col("idx") >= first)
    if last is not None:
        df = df.filter(F.col("idx") <= last)
    return df.select("chain", "iteration", "param", "idx", "value")


def parameters(draws: DataFrame) -> DataFrame:
    """The parameters a draw table holds, with their index range and count."""
    names = draws.select("param", "idx").distinct()
    return names.groupBy("param").agg(
        F.count("*").alias("n_params"), F.min("idx").alias("min_idx"), F.max("idx").alias("max_idx")
    )


def sampler_table(draws: DataFrame) -> DataFrame:
    """Sampler internals side by side: one row per chain and iteration."""
    cols = [F.max(F.when(F.col("param") == p, F.col("value"))).alias(c) for p, c in SAMPLER_FIELDS.items()]
    kept = draws.filter(F.col("param").isin(*SAMPLER_FIELDS))
    return kept.groupBy("chain", "iteration").agg(*cols)
