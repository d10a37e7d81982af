"""Set commands on (key, member), with or without repeats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sadd(rows: DataFrame) -> DataFrame:
    return rows.select("key", "member").distinct()


def srem(state: DataFrame, gone: DataFrame) -> DataFrame:
    """Sets without the rows of `gone`; emptied ones have no rows left."""
    return state.join(gone.select("key", "member").distinct(), ["key", "member"], "left_anti")


def scard(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.countDistinct("member").alias("members"))


def smembers(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key).select("member").distinct()


def sismember(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """key, member, found (1 or 0) of each row asked."""
    have = rows.select("key", "member").distinct().withColumn("has", F.lit(1))
    return asked.join(have, ["key", "member"], "left").select("key", "member", F.coalesce("has", F.lit(0)).alias("found"))


def _of(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col("key") == key).select("member")


def sinter(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One pass and one shuffle for any number of sets: members that all keys have."""
    n = len(set(keys))
    return rows.where(F.col("key").isin(*keys)).groupBy("member").agg(F.countDistinct("key").alias("n")).where(F.col("n") == n).select("member")


def sunion(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(F.col("key").isin(*keys)).select("member").distinct()


def sdiff(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first set without the others."""
    return reduce(lambda a, k: a.join(_of(rows, k).distinct(), "member", "left_anti"), keys[1:], _of(rows, keys[0]).distinct())


def srandmember(rows: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of `count` different members a key; nothing if count is 0 or less."""
    order = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "member"), "member")
    return sadd(rows).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(count, 0)).drop("n")


def spop(rows: DataFrame, count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """What is popped and what stays; a count below 1 is 1."""
    gone = srandmember(rows, max(count, 1), seed)
    return gone, srem(sadd(rows), gone)
