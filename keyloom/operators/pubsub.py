"""Filters and statistics of channel messages (channel, payload_type, payload, message_id, ms, headers).

The same functions serve batch and streaming DataFrames.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob(pattern: str) -> str:
    """A regular expression for a glob: *, ? and [...], everything else by itself."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if end > 0:
            out += "[" + pattern[i + 1 : end].replace("\\", "\\\\").replace("!", "^", pattern[i + 1 : i + 2] == "!") + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def subscribed(channels: list[str], patterns: list[str] = ()) -> Column:
    out = F.col("channel").isin(*channels)
    for p in patterns:
        out = out | F.col("channel").rlike(glob(p))
    return out


def size_between(low: int, high: int) -> Column:
    return F.octet_length("payload").between(low, high)


def metadata(headers: list[str] = (), id_glob: str | None = None, since: int | None = None, until: int | None = None) -> Column:
    """All headers there, id like the glob, time in the closed range; what is missing fails."""
    tests = [F.map_contains_key("headers", h) for h in headers]
    if id_glob is not None:
        tests.append(F.col("message_id").rlike(glob(id_glob)))
    if since is not None:
        tests.append(F.col("ms") >= since)
    if until is not None:
        tests.append(F.col("ms") <= until)
    out = F.lit(True)
    for t in tests:
        out = out & F.coalesce(t, F.lit(False))
    return out


def content(types: list[str] = (), globs: list[str] = (), json_keys: list[str] = ()) -> Column:
    """Payload type among `types`, text like one of `globs`, and all JSON keys at its top level."""
    out = F.col("payload_type").isin(*types) if types else F.lit(True)
    if globs:
        like = F.lit(False)
        for g in globs:
            like = like | F.col("payload").rlike(glob(g))
        out = out & like
    for k in json_keys:
        out = out & F.coalesce(F.array_contains(F.json_object_keys("payload"), k), F.lit(False))
    return out


def channel_stats(messages: DataFrame) -> DataFrame:
    return messages.groupBy("channel").agg(F.count("*").alias("messages"), F.sum(F.octet_length("payload")).alias("bytes"), F.max("ms").alias("last_ms"))


def with_metadata(there: bool = True) -> Column:
    """Messages that have metadata (an id, a time or headers), or none."""
    some = F.col("message_id").isNotNull() | F.col("ms").isNotNull() | (F.size(F.coalesce("headers", F.create_map().cast("map<string,string>"))) > 0)
    return some if there else ~some


def of_type(test: tuple) -> Column:
    """A test of the message's type: ("types", names), ("metadata", bool) or ("and", test, test), to any depth."""
    if test[0] == "types":
        return F.col("payload_type").isin(*test[1])
    if test[0] == "metadata":
        return with_metadata(test[1])
    if test[0] == "and":
        return of_type(test[1]) & of_type(test[2])
    raise ValueError(test[0])


def selected(size: Column | None = None, meta: Column | None = None, text: Column | None = None, custom: Callable[[], Column] | Column | None = None, kind: tuple | None = None) -> Column:
    """All filters of a subscriber together: size, metadata, content, one of its own, message type; those not given pass. A null test fails."""
    own = custom() if callable(custom) and not isinstance(custom, Column) else custom
    out = F.lit(True)
    for test in (size, meta, text, own, of_type(kind) if kind else None):
        if test is not None:
            out = out & F.coalesce(test, F.lit(False))
    return out


def subscriber_stats(messages: DataFrame, subscriptions: DataFrame, passes: Column) -> DataFrame:
    """subscriber, received, bytes, filtered, last_ms of the subscriptions (subscriber, channel): what passes is received, the rest filtered."""
    seen = messages.withColumn("_passes", passes).join(subscriptions.select("subscriber", "channel").distinct(), "channel")
    size = F.octet_length("payload")
    return seen.groupBy("subscriber").agg(
        F.count_if("_passes").alias("received"), F.coalesce(F.sum(F.when(F.col("_passes"), size)), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(~F.col("_passes")).alias("filtered"), F.max(F.when(F.col("_passes"), F.col("ms"))).alias("last_ms"),
    )


def published(messages: DataFrame, new: DataFrame, subscriptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """PUBLISH: the messages with the new ones, and how many subscribers each new one has (channel, message_id, receivers)."""
    receivers = subscriptions.groupBy("channel").agg(F.countDistinct("subscriber").alias("receivers"))
    told = new.select("channel", "message_id").join(receivers, "channel", "left").select("channel", "message_id", F.coalesce("receivers", F.lit(0)).cast("long").alias("receivers"))
    return messages.unionByName(new), told


def active_channels(subscriptions: DataFrame, pattern: str = "*") -> DataFrame:
    """PUBSUB CHANNELS: channels with a subscriber, like the glob."""
    return subscriptions.where(F.col("channel").rlike(glob(pattern))).select("channel").distinct()


def numsub(subscriptions: DataFrame, channels: list[str]) -> DataFrame:
    """PUBSUB NUMSUB: channel, subscribers of each channel asked for, 0 if it has none."""
    asked = F.array(*map(F.lit, channels))
    zero = subscriptions.sparkSession.range(1).select(F.explode(asked).alias("channel"))
    n = subscriptions.where(F.col("channel").isin(*channels)).groupBy("channel").agg(F.countDistinct("subscriber").alias("n"))
    return zero.join(n, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).cast("long").alias("subscribers"))


def fan_in(*sources: DataFrame) -> DataFrame:
    """One flow of several channels' messages, batch or streaming: which one comes first is not told."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out
