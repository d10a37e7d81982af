"""List commands. A list is one array value of its key; pushes come as a log (key, value, seq)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pushed(log: DataFrame, left: bool = False) -> DataFrame:
    """key, items: all RPUSHes (or LPUSHes) of a key."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("seq") if left else F.col("seq")).alias("at"), "value")))
    return log.groupBy("key").agg(F.transform(items, lambda x: x["value"]).alias("items"))


def lpop(items: Column) -> tuple[Column, Column]:
    """The popped head (null if there is none) and what stays: an empty list stays a list."""
    return F.get(items, 0), F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))


def rpop(items: Column) -> tuple[Column, Column]:
    return F.get(items, F.size(items) - 1), F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0)))


def lrange(items: Column, start: int, stop: int) -> Column:
    """Both ends belong to it; negative ones count from the end and are clamped to the head."""
    n = F.size(items)
    a = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    b = F.least(F.lit(stop), n - 1) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    return F.slice(items, a + 1, F.greatest(b - a + 1, F.lit(0)))


def lset(items: Column, index: int, value: str) -> Column:
    at = F.lit(index) if index >= 0 else F.size(items) + index
    return F.transform(items, lambda x, i: F.when(i == at, F.lit(value)).otherwise(x))


def lrem(items: Column, count: int, value: str) -> Column:
    """Without the first `count` equal items (the last ones if it is negative, all if it is 0)."""
    if count == 0:
        return F.array_remove(items, value)
    line = items if count > 0 else F.reverse(items)
    start = F.struct(F.lit(0).alias("n"), F.slice(items, 1, 0).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gone = (x == value) & (acc["n"] < abs(count))
        return F.struct((acc["n"] + gone.cast("int")).alias("n"), F.when(gone, acc["out"]).otherwise(F.array_append(acc["out"], x)).alias("out"))

    left = F.aggregate(line, start, step, lambda acc: acc["out"])
    return left if count > 0 else F.reverse(left)


def llen(items: Column) -> Column:
    return F.size(items).cast("long")


def fold(log: DataFrame) -> DataFrame:
    """key, idx, value: the lists that a mixed log (key, seq, op, value, at) leaves, in long form; empty lists have no rows.

    op: lpush, rpush, lpop, rpop, lset (`value` at place `at`, negative from the end; out of range it is an error) and lrem (`at` times
    `value`, as lrem()). Each key's events are a sorted stream: the list as it stands is all that is held. What an event does depends on
    all before it, so one key is one task's work.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, items = None, deque()

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"key": [key] * len(items), "idx": range(len(items)), "value": list(items)})

        for part in parts:
            for k, op, value, at in zip(part["key"], part["op"], part["value"], part["at"], strict=True):
                if k != key:
                    if items:
                        yield rows()
                    key, items = k, deque()
                if op == "lpush":
                    items.appendleft(value)
                elif op == "rpush":
                    items.append(value)
                elif op in ("lpop", "rpop"):
                    if items:
                        items.popleft() if op == "lpop" else items.pop()
                elif op == "lset":
                    items[int(at)] = value
                elif op == "lrem":
                    left = abs(int(at)) or len(items)
                    if at < 0:
                        items.reverse()
                    kept = deque()
                    for x in items:
                        if x == value and left:
                            left -= 1
                        else:
                            kept.append(x)
                    items = kept
                    if at < 0:
                        items.reverse()
        if items:
            yield rows()

    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = log.select("key", "seq", "op", "value", F.coalesce("at", F.lit(0)).cast("long").alias("at")).repartition(n, "key").sortWithinPartitions("key", "seq")
    return dealt.mapInPandas(run, "key string, idx long, value string")
