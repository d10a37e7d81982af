"""Hash commands on the long form (key, field, value[, seq]); nested maps only where a reply is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import numbers


def hset(log: DataFrame) -> DataFrame:
    """key, field, value: the last write of each field."""
    return log.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def hget(state: DataFrame, key: str, field: str) -> DataFrame:
    return state.where((F.col("key") == key) & (F.col("field") == field))


def hmget(state: DataFrame, fields: list[str]) -> DataFrame:
    """key and a column v0, v1, ... a field asked for: null where it is missing."""
    wanted = [F.max(F.when(F.col("field") == f, F.col("value"))).alias(f"v{i}") for i, f in enumerate(fields)]
    return state.groupBy("key").agg(*wanted)


def hdel(state: DataFrame, fields: list[str]) -> DataFrame:
    return state.where(~F.col("field").isin(*fields))


def hexists(state: DataFrame, field: str) -> DataFrame:
    return state.groupBy("key").agg(F.max((F.col("field") == field).cast("int")).alias("found"))


def hlen(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.count("field").alias("fields"))


def hkeys(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.array_sort(F.collect_list("field")).alias("names"))


def hvals(state: DataFrame) -> DataFrame:
    """Values in the order of their fields."""
    pairs = F.array_sort(F.collect_list(F.struct("field", "value")))
    return state.groupBy("key").agg(F.transform(pairs, lambda e: e["value"]).alias("items"))


def hgetall(state: DataFrame) -> DataFrame:
    """Fields and values in turn, by field."""
    pairs = F.array_sort(F.collect_list(F.struct("field", "value")))
    return state.groupBy("key").agg(F.flatten(F.transform(pairs, lambda e: F.array(e["field"], e["value"]))).alias("items"))


def hrandfield(state: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A repeatable sample of fields: `count` different ones, or -count with replacement if it is negative."""
    if count >= 0:
        order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(seed), "key", "field").alias("h"), "field")))
        return state.groupBy("key").agg(F.slice(order, 1, count).alias("s")).select("key", F.explode("s.field").alias("field"))
    names = state.groupBy("key").agg(F.array_sort(F.collect_list("field")).alias("names"))
    draws = names.select("key", "names", F.explode(F.sequence(F.lit(1), F.lit(-count))).alias("draw"))
    return draws.select("key", F.element_at("names", (F.pmod(F.xxhash64(F.lit(seed), "key", "draw"), F.size("names")) + 1).cast("int")).alias("field"))


def hincrby(state: DataFrame, increments: DataFrame) -> DataFrame:
    """key, field, value: integer fields plus the sum of their increments (key, field, delta); missing ones begin at 0, and one that is
    no integer of 64 bits is an error."""
    add = increments.groupBy("key", "field").agg(F.sum("delta").alias("delta"))
    both = state.join(add, ["key", "field"], "full")
    old = F.when(F.col("value").isNull(), F.lit(0).cast("bigint")).otherwise(numbers.needed(numbers.parse_int(F.col("value")), "hash value is not an integer"))
    value = F.when(F.col("delta").isNull(), F.col("value")).otherwise((old + F.col("delta")).cast("string"))
    return both.select("key", "field", value.alias("value"))


def hincrbyfloat(state: DataFrame, increments: DataFrame) -> DataFrame:
    """key, field, value (double): as hincrby() with finite doubles; fields without an increment that are no numbers are null."""
    add = increments.groupBy("key", "field").agg(F.sum(numbers.finite(F.col("delta"))).alias("delta"))
    both = state.join(add, ["key", "field"], "full")
    parsed = numbers.parse_float(F.col("value"))
    old = F.when(F.col("value").isNull(), F.lit(0.0)).otherwise(numbers.needed(parsed, "hash value is not a float"))
    return both.select("key", "field", F.when(F.col("delta").isNull(), parsed).otherwise(numbers.finite(old + F.col("delta"))).alias("value"))
