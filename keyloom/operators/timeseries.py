"""Samples (key, ms, seq, value); of samples at one time the last written counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(ts: DataFrame) -> DataFrame:
    last = ts.groupBy("key").agg(F.max(F.struct("ms", "seq", "value")).alias("last"))
    return last.select("key", "last.ms", "last.value")


def between(ts: DataFrame, start: int, end: int, count: int | None = None) -> DataFrame:
    """Samples of the closed range, the first `count` of each key if given."""
    out = ts.where(F.col("ms").between(start, end))
    if count is None:
        return out
    order = Window.partitionBy("key").orderBy("ms", "seq")
    return out.withColumn("n", F.row_number().over(order)).where(F.col("n") <= count).drop("n")


def delete(ts: DataFrame, start: int, end: int) -> DataFrame:
    return ts.where(~F.col("ms").between(start, end))


def retained(ts: DataFrame, retention_ms: int) -> DataFrame:
    """Samples no older than the retention before their key's latest."""
    newest = ts.groupBy("key").agg(F.max("ms").alias("newest"))
    return ts.join(newest, "key").where(F.col("ms") >= F.col("newest") - retention_ms).drop("newest")


def live(keys: DataFrame, now: int) -> DataFrame:
    """Keys (key, deadline) that have not expired."""
    return keys.where(F.col("deadline") > now)


def expired(keys: DataFrame, now: int) -> DataFrame:
    return keys.where(F.col("deadline") <= now)


def create(series: DataFrame, new: DataFrame) -> DataFrame:
    """TS.CREATE: series (key, retention_ms, labels) with the new ones; a key that exists is an error."""
    both = new.join(series.select("key", F.lit(True).alias("_there")), "key", "left")
    key = F.when(F.col("_there"), F.raise_error(F.lit("key already exists"))).otherwise(F.col("key"))
    return series.unionByName(both.select(key.alias("key"), "retention_ms", "labels"))


def add(ts: DataFrame, new: DataFrame) -> DataFrame:
    """TS.ADD: one sample (key, ms, seq, value) a key and time, the last written."""
    last = ts.unionByName(new).groupBy("key", "ms").agg(F.max_by(F.struct("seq", "value"), "seq").alias("last"))
    return last.select("key", "ms", "last.seq", "last.value")


def labelled(series: DataFrame, labels: dict[str, str]) -> DataFrame:
    """Series whose labels have all of these."""
    for k, v in labels.items():
        series = series.where(F.coalesce(F.try_element_at("labels", F.lit(k)) == v, F.lit(False)))
    return series
