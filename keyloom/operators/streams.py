"""Ordered streams (key, ms, seq, ...): an entry's id is (ms, seq)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Id = tuple[int, int]


def entry_id() -> Column:
    return F.concat_ws("-", F.col("ms").cast("string"), F.col("seq").cast("string"))


def _id(i: Id) -> Column:
    return F.struct(F.lit(i[0]).cast("long").alias("ms"), F.lit(i[1]).cast("long").alias("seq"))


def xrange(s: DataFrame, low: Id, high: Id) -> DataFrame:
    """Entries of the closed range of ids. The test on ms alone reaches the scan where ms is a stored column."""
    at = F.struct("ms", "seq")
    return s.where(F.col("ms").between(low[0], high[0]) & (at >= _id(low)) & (at <= _id(high)))


def xread(s: DataFrame, after: dict[str, Id], count: int) -> DataFrame:
    """The first `count` entries of each stream after its id."""
    asked = F.lit(False)
    for key, i in after.items():
        asked = asked | ((F.col("key") == key) & (F.struct("ms", "seq") > _id(i)))
    order = Window.partitionBy("key").orderBy("ms", "seq")
    return s.where(asked).withColumn("n", F.row_number().over(order)).where(F.col("n") <= count)


def xlen(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count("*").alias("entries"))


def xdel(s: DataFrame, ids: DataFrame) -> DataFrame:
    return s.join(ids.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_anti")


def xtrim(s: DataFrame, max_len: int) -> DataFrame:
    """The last max_len entries of each stream."""
    order = Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq"))
    return s.withColumn("n", F.row_number().over(order)).where(F.col("n") <= max_len).drop("n")


def xrevrange(s: DataFrame, low: Id, high: Id, count: int) -> DataFrame:
    """The last `count` entries of each stream in the closed range, with their place, the newest first."""
    order = Window.partitionBy("key").orderBy(F.desc("ms"), F.desc("seq"))
    return xrange(s, low, high).withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def xgroup_create(groups: DataFrame, key: str, group: str, start: Id) -> DataFrame:
    """Groups (group, key, ms, seq: the id after which they read) with one more; one that exists is an error."""
    if groups.where((F.col("key") == key) & (F.col("group") == group)).limit(1).count():
        raise ValueError("group already exists")
    new = groups.sparkSession.range(1).select(F.lit(group).alias("group"), F.lit(key).alias("key"), *(F.lit(x).cast("long").alias(c) for x, c in zip(start, ("ms", "seq"), strict=True)))
    return groups.unionByName(new)


def undelivered(s: DataFrame, groups: DataFrame, acks: DataFrame, group: str) -> DataFrame:
    """Entries of the group's streams after its start that it has not acknowledged."""
    own = groups.where(F.col("group") == group).select("key", F.struct("ms", "seq").alias("_start"))
    after = s.join(own, "key").where(F.struct("ms", "seq") > F.col("_start")).drop("_start")
    return pending(after, acks, group)


def pending(s: DataFrame, acks: DataFrame, group: str) -> DataFrame:
    """Entries that the group has not acknowledged (acks: group, key, ms, seq)."""
    return xdel(s, acks.where(F.col("group") == group))
