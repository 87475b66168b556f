"""Small column expressions for cleaning indicator values and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def logical_to_int(c: Column) -> Column:
    """FALSE/TRUE/NULL to 0/1/NULL."""
    return c.cast("boolean").cast("int")


def clamp_binary(c: Column) -> Column:
    """Values of 2 or more become 1; everything else, NULL and negatives included, stays."""
    return F.when(c >= 2, F.lit(1)).otherwise(c.cast("int"))


def at_least_one(c: Column) -> Column:
    """1 where the count is at least 1, else 0; NULL stays NULL."""
    return F.when(c.isNotNull(), (c >= 1).cast("int"))


def indicator_value(c: Column) -> Column:
    """A raw text cell as a 0/1 integer: T/F words, truncated numbers, clamped."""
    text = F.trim(c)
    word = F.upper(text)
    as_int = (
        F.when(word.isin("T", "TRUE"), F.lit(1))
        .when(word.isin("F", "FALSE"), F.lit(0))
        .otherwise(text.try_cast("double").try_cast("int"))
    )
    return clamp_binary(as_int)


def is_concern(item: Column) -> Column:
    return item.contains("_con_")


def param_name(raw: Column) -> Column:
    """``theta.42`` or ``theta[42]`` to ``theta``; a scalar parameter keeps its name."""
    return F.regexp_extract(raw, r"^(.*?)(?:[.\[](\d+)\]?)?$", 1)


def param_index(raw: Column) -> Column:
    """``theta.42`` or ``theta[42]`` to 42; NULL for a scalar parameter."""
    return F.regexp_extract(raw, r"[.\[](\d+)\]?$", 1).try_cast("int")
