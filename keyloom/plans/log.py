"""Folds of an append-only change log (seq, op, key, value) into states.

One aggregate a key, combined map-side: a hot key reaches its reducer as one row a task. `seq` orders the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_write(log: DataFrame) -> DataFrame:
    """key, value, seq: SET and DEL, the last op of a key wins; deleted keys are gone."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "seq"), "seq").alias("last"))
    return last.where("last.op = 'set'").select("key", F.col("last.value").alias("value"), F.col("last.seq").alias("seq"))


def first_write(log: DataFrame) -> DataFrame:
    """key, value, seq: SETNX, the first write of a key since it was last deleted wins; deleted keys are gone."""
    gone = log.where("op = 'del'").groupBy("key").agg(F.max("seq").alias("_gone"))
    sets = log.where("op = 'set'").join(gone, "key", "left").where("_gone is null or seq > _gone")
    return sets.groupBy("key").agg(F.min_by("value", "seq").alias("value"), F.min("seq").alias("seq"))


def since_flush(log: DataFrame) -> DataFrame:
    """The log after its last flush; op 'flush' is an event of the log as others are."""
    flushed = log.agg(F.max(F.when(F.col("op") == "flush", F.col("seq"))).alias("flushed"))
    return log.crossJoin(F.broadcast(flushed)).where("op <> 'flush' and (flushed is null or seq > flushed)").drop("flushed")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The state after event `seq`."""
    return last_write(log.where(F.col("seq") <= seq))


def compacted(log: DataFrame) -> DataFrame:
    """A log of the live SETs alone, with the same last_write()."""
    return last_write(log).select("seq", F.lit("set").alias("op"), "key", "value")


def upsert(state: DataFrame, batch: DataFrame) -> DataFrame:
    """MSET on a state (key, value): the batch's keys are overwritten."""
    return state.select("key", "value").join(batch.select("key"), "key", "left_anti").unionByName(batch.select("key", "value"))
