"""Sorted sets (key, member, score), in order of (score, member).

Ranges of places are windows that Spark limits before the shuffle where the limit is a constant; the place of single
members is a count of those before them, which needs no sort of the whole set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Buckets that scores are dealt into.
BUCKETS = 256


def zadd(log: DataFrame) -> DataFrame:
    """The last score (key, member, score, seq) of each member."""
    return log.groupBy("key", "member").agg(F.max_by("score", "seq").alias("score"))


def zincrby(log: DataFrame) -> DataFrame:
    return log.groupBy("key", "member").agg(F.sum("increment").alias("score"))


def _up():
    return Window.partitionBy("key").orderBy("score", "member")


def _down():
    return Window.partitionBy("key").orderBy(F.desc("score"), F.desc("member"))


def zrange(z: DataFrame, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """key, member, score, place (from 0); negative places count from the other end."""
    ahead, back = (_down(), _up()) if reverse else (_up(), _down())
    out = z.withColumn("_n", F.row_number().over(ahead))
    if start >= 0 and stop >= 0:
        return out.where((F.col("_n") <= stop + 1) & (F.col("_n") > start)).select("key", "member", "score", (F.col("_n") - 1).cast("long").alias("place"))
    out = out.withColumn("_back", F.row_number().over(back) - 1)
    out = out.where(F.col("_n") > start) if start >= 0 else out.where(F.col("_back") <= -start - 1)
    out = out.where(F.col("_n") <= stop + 1) if stop >= 0 else out.where(F.col("_back") >= -stop - 1)
    return out.select("key", "member", "score", (F.col("_n") - 1).cast("long").alias("place"))


def zrank(z: DataFrame, asked: DataFrame, reverse: bool = False) -> DataFrame:
    """key, member, place of each (key, member) asked: a count of the members before it.

    Scores are dealt into buckets at quantiles: whole buckets before are counted once, so a member asked for meets those of its own bucket
    only, and no set is sorted or held as a whole.
    """
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    bounds = sorted({x for x in z.approxQuantile("score", shares, 0.25 / BUCKETS) if x == x}) if shares else []
    bucket = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda x: x < F.col("score"))) if bounds else F.lit(0)
    z = z.select("key", "member", "score", bucket.alias("bucket"))
    mine = z.join(asked.select("key", "member").distinct(), ["key", "member"]).select("key", "bucket", F.col("member").alias("m"), F.col("score").alias("s"))
    whole = Window.partitionBy("key").orderBy(F.desc("bucket") if reverse else "bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = z.groupBy("key", "bucket").agg(F.count("*").alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(whole), F.lit(0)).alias("ahead"))
    before = (F.col("score") > F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") > F.col("m"))) if reverse else (F.col("score") < F.col("s")) | ((F.col("score") == F.col("s")) & (F.col("member") < F.col("m")))
    own = z.join(mine, ["key", "bucket"]).groupBy("key", "bucket", F.col("m").alias("member")).agg(F.count_if(before).alias("n"))
    return own.join(counts, ["key", "bucket"]).select("key", "member", (F.col("n") + F.col("ahead")).alias("place"))


def zscore(z: DataFrame, key: str, member: object) -> DataFrame:
    return z.where((F.col("key") == key) & (F.col("member") == member))


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count("*").alias("members"))


def zcount(z: DataFrame, low: float, high: float) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(F.col("score").between(low, high)).alias("members"))


def zrangebyscore(z: DataFrame, low: float, high: float) -> DataFrame:
    return z.where(F.col("score").between(low, high))


def zrangebylex(z: DataFrame, low: str, high: str) -> DataFrame:
    """Members in closed byte order."""
    return z.where(F.col("member").between(low, high))


def zrem(z: DataFrame, gone: DataFrame) -> DataFrame:
    return z.join(gone.select("key", "member").distinct(), ["key", "member"], "left_anti")


def zunion(z: DataFrame, keys: list[str]) -> DataFrame:
    """member, score: the sums over the sets."""
    return z.where(F.col("key").isin(*keys)).groupBy("member").agg(F.sum("score").alias("score"))


def zinter(z: DataFrame, keys: list[str]) -> DataFrame:
    n = len(set(keys))
    both = z.where(F.col("key").isin(*keys)).groupBy("member").agg(F.sum("score").alias("score"), F.countDistinct("key").alias("n"))
    return both.where(F.col("n") == n).select("member", "score")


def zpop(z: DataFrame, count: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The popped members and the rest."""
    gone = zrange(z, 0, count - 1, highest)
    return gone, zrem(z, gone)
