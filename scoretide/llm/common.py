"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoretide.session import fresh_path, ship_code

# The six ASCII white-space characters, in code order.
WHITE = "\t\n\x0b\x0c\r "

FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def text_of(column: str) -> Column:
    """The text itself, empty where it is NULL."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def without_white(text: Column) -> Column:
    """``text`` with every ASCII white-space character deleted."""
    return reduce(lambda kept, white: F.replace(kept, F.lit(white), F.lit("")), WHITE, text)


def stored_at(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, so that no lost executor makes it run again; and where it lies."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def stored(df: DataFrame, label: str) -> DataFrame:
    return stored_at(df, label)[0]


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end, not when the driver next collects its garbage. For
    writes: a frame that is collected again would have to shuffle again."""
    was = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, was)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table of ``stored_at`` that nothing reads any more: all that was derived from it must be stored."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def over_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``work`` over the Arrow batches of each partition, with this package at hand on the executors. Spark bounds the
    batches by rows and bytes, so many long texts do not meet in one."""
    ship_code(df.sparkSession)
    return df.mapInArrow(work, schema)


def row_struct(docs: DataFrame) -> Column:
    """The whole row as one struct, so that its column names cannot meet an operator's own."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")


def added(df: DataFrame, columns: str, drop: str = "text") -> T.StructType:
    """The schema of ``df`` without ``drop`` and with ``columns`` behind it."""
    return T.StructType([f for f in df.schema.fields if f.name != drop] + T.StructType.fromDDL(columns).fields)


def slices(batch: pa.RecordBatch, column: str, chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces whose ``column`` holds about ``chars`` bytes, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(size):
        if i > start and total + n > chars:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(size):
        yield batch.slice(start)


def seeded(key: object, seed: int) -> int:
    """A number below 2**32 that depends on ``key`` and ``seed`` alone."""
    return zlib.crc32(f"{seed}:{key}".encode())
