"""String commands. Lengths and offsets count bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(state: DataFrame, key: str) -> DataFrame:
    return state.where(F.col("key") == key)


def mget(state: DataFrame, keys: list[str], missing: str | None = None) -> DataFrame:
    """pos, key, value: one row a key asked for, in order; the keys are a literal list, so they are broadcast."""
    spark = state.sparkSession
    asked = spark.createDataFrame(list(enumerate(keys)), "pos long, key string")
    found = state.where(F.col("key").isin(*keys)).select("key", "value")  # reaches the scan as a pushed filter
    out = F.broadcast(asked).join(found, "key", "left")
    value = F.col("value") if missing is None else F.coalesce("value", F.lit(missing))
    return out.select("pos", "key", value.alias("value"))


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")


def getrange(value: Column, start: int, end: int) -> Column:
    """Bytes [start, end): the end is exclusive, negative places count from the end, all is clamped."""
    n = F.octet_length(value)

    def place(i: int) -> Column:
        return F.least(F.greatest(F.lit(i) if i >= 0 else n + i, F.lit(0)), n)

    raw = F.substring(value.cast("binary"), place(start) + 1, F.greatest(place(end) - place(start), F.lit(0)))
    return F.try_validate_utf8(raw)


def append(log: DataFrame) -> DataFrame:
    """key, value, length: all APPENDs (key, seq, arg) of a key in order; a key's string is one value."""
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "arg"))), lambda x: x["arg"]), "")
    return log.groupBy("key").agg(parts.alias("value")).withColumn("length", strlen(F.col("value")))
