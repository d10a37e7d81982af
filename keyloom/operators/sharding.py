"""Balance of keys and operations over shards, and plans to move load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations above which a key is hot, load over the mean that calls for a move, moves in a batch.
HOT, UNEVEN, BATCH = 100, 1.5, 64


def shard_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n))


def balance(rows: DataFrame) -> DataFrame:
    """Global figures of (shard, key): keys in all, on average, most, least, and most over least (infinite if that is 0)."""
    per = rows.groupBy("shard").agg(F.countDistinct("key").alias("keys"))
    s = per.agg(F.count("*").alias("shards"), F.sum("keys").alias("keys"), F.avg("keys").alias("mean"), F.max("keys").alias("most"), F.min("keys").alias("least"))
    return s.withColumn("ratio", F.when(F.col("least") == 0, float("inf")).otherwise(F.col("most") / F.col("least")))


def load_share(ops: DataFrame) -> DataFrame:
    """shard, ops, share of all operations (shard, key): the total is taken over one row a shard."""
    per = ops.groupBy("shard").agg(F.count("*").alias("ops"))
    return per.withColumn("share", F.col("ops") / F.sum("ops").over(Window.partitionBy(F.lit(0))))


def hot_keys(ops: DataFrame, above: int = HOT) -> DataFrame:
    """key, ops of keys with more operations than that, hottest first."""
    return ops.groupBy("key").agg(F.count("*").alias("ops")).where(F.col("ops") > above).orderBy(F.desc("ops"), "key")


def moves(ops: DataFrame) -> DataFrame:
    """slot, from_shard, to_shard: hot slots of overloaded shards to the least loaded underloaded one, heaviest first, a batch at most."""
    per = ops.groupBy("shard").agg(F.count("*").alias("load"))
    mean = per.agg(F.avg("load").alias("mean"))
    marked = per.crossJoin(F.broadcast(mean))
    over = marked.where(F.col("load") > F.col("mean") * UNEVEN).select(F.col("shard").alias("from_shard"))
    to = marked.where(F.col("load") < F.col("mean") / UNEVEN).agg(F.min_by("shard", F.struct("load", "shard")).alias("to_shard"))
    slots = ops.groupBy("shard", "slot").agg(F.count("*").alias("ops")).where(F.col("ops") > HOT)
    plan = slots.join(F.broadcast(over), F.col("shard") == F.col("from_shard")).crossJoin(F.broadcast(to)).where(F.col("to_shard").isNotNull())
    return plan.select("slot", "from_shard", "to_shard", "ops").orderBy(F.desc("ops"), "slot").limit(BATCH)


def slot_owners(ranges: DataFrame) -> DataFrame:
    """slot, shard of ranges (first, last, shard) of slots, both ends included: 16384 rows at most, whatever the keys."""
    return ranges.select(F.explode(F.sequence("first", "last")).alias("slot"), "shard")


def routed(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """keys (slot, ...) with the shard that owns their slot; null where none does."""
    return keys.join(F.broadcast(slot_owners(ranges)), "slot", "left")


def extremes(per_shard: DataFrame) -> DataFrame:
    """least and most keys of any shard (shard, keys), and the shards that have them."""
    return per_shard.agg(F.min("keys").alias("least"), F.min_by("shard", F.struct("keys", "shard")).alias("least_shard"), F.max("keys").alias("most"), F.max_by("shard", F.struct("keys", "shard")).alias("most_shard"))
