"""Commands on keys of any kind, as functions of a state (key, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exists(state: DataFrame, keys: list[str]) -> DataFrame:
    """found: how many of the keys exist; a key that is asked twice counts twice."""
    times = {k: keys.count(k) for k in keys}
    weight = F.create_map(*(F.lit(x) for kv in times.items() for x in kv))
    return state.where(F.col("key").isin(*times)).select("key").distinct().agg(F.coalesce(F.sum(weight[F.col("key")]), F.lit(0)).cast("long").alias("found"))


def delete(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.where(~F.col("key").isin(*keys))


def rename(state: DataFrame, old: str, new: str) -> DataFrame:
    """`old` becomes `new`, over what stood there. A missing source changes nothing but loses nothing either."""
    has = F.broadcast(state.where(F.col("key") == old).limit(1).select(F.lit(1).alias("has")))
    kept = state.where(F.col("key") != new)
    target = state.where(F.col("key") == new).join(has, how="left_anti")
    return kept.withColumn("key", F.when(F.col("key") == old, new).otherwise(F.col("key"))).unionByName(target)


def renamenx(state: DataFrame, old: str, new: str) -> DataFrame:
    """As rename(), but only if `new` doesn't exist."""
    taken = F.broadcast(state.where(F.col("key") == new).limit(1).select(F.lit(new).alias("taken")))
    to = F.when((F.col("key") == old) & F.col("taken").isNull(), F.lit(new)).otherwise(F.col("key"))
    return state.crossJoin(F.broadcast(taken.agg(F.max("taken").alias("taken")))).withColumn("key", to).drop("taken")


def dbsize(state: DataFrame) -> DataFrame:
    return state.agg(F.countDistinct("key").alias("keys"))


def in_slot_of(key: Column) -> Column:
    """The part of a key that decides its slot: what stands in its first {} if not empty, else all of it."""
    tag = F.regexp_extract(key, r"\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)
