"""Counters: the INCR family over logs of (key, seq, delta). Integer overflow is an error (ANSI mode)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Sequence numbers of a stretch.
STRETCH = 65_536


def totals(log: DataFrame, sign: int = 1) -> DataFrame:
    return log.groupBy("key").agg(F.sum(F.col("delta") * sign).alias("value"))


def running(log: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """What each INCRBY returns: the sum up to and with it.

    Sums are taken within stretches of seq, and over the totals of those before: no key's log is sorted in one task.
    """
    rows = log.withColumn("_stretch", F.floor(F.col("seq") / stretch))
    before = Window.partitionBy("key").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals_ = rows.groupBy("key", "_stretch").agg(F.sum("delta").alias("_sum"))
    totals_ = totals_.select("key", "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    upto = Window.partitionBy("key", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("value", F.sum("delta").over(upto)).join(totals_, ["key", "_stretch"])
    return out.select(*log.columns, (F.col("value") + F.col("_before")).alias("value"))


def parse_int(text: Column) -> Column:
    """A decimal integer without blanks around it; null for anything else."""
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def parse_float(text: Column) -> Column:
    return F.when(text.rlike(r"^\S+$"), text.try_cast("double"))


def needed(x: Column, message: str) -> Column:
    """The value, or an error if it is null."""
    return F.when(x.isNull(), F.raise_error(F.lit(message))).otherwise(x)


def setfloat(log: DataFrame) -> DataFrame:
    """key, value: the last number written (key, seq, value), which has to be finite."""
    return log.groupBy("key").agg(F.max_by(finite(F.col("value").cast("double")), "seq").alias("value"))


def finite(x: Column) -> Column:
    """The value, or an error if it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("value is not finite"))).otherwise(x)
