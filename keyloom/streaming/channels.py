"""Structured Streaming over the events: filters, channel statistics, windows with a watermark, and expiry of idle keys.

`drain` runs a query over what there is (availableNow) and returns its result as a table: what the tests and the
registered queries use. In production the same DataFrames go to any sink, with a checkpoint for each consumer group.
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from keyloom.fixtures import epoch_ms
from keyloom.storage import new_path, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 8) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(f"{sf_dir}/")


def messages(stream: DataFrame) -> DataFrame:
    return stream.select(F.col("event_type").alias("channel"), F.col("props").alias("payload"), epoch_ms(F.col("ts")).alias("ms"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")


def file_stream(parts: list[DataFrame]) -> DataFrame:
    """A stream of the parts, one a batch, in their order."""
    spark, path = parts[0].sparkSession, new_path(parts[0].sparkSession, "source")
    for part in parts:
        part.select(*parts[0].columns).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def by_time(rows: DataFrame, files: int) -> DataFrame:
    """Messages as a stream of so many files, the earliest first, and two of a far later time, which let all windows before them close."""
    ends = rows.approxQuantile("ms", [i / files for i in range(1, files)], 0.01)
    parts = [rows.where((F.col("ms") >= low) & (F.col("ms") < high)) for low, high in zip([float("-inf"), *ends], [*ends, float("inf")], strict=True)]
    last = rows.agg(F.max("ts").alias("ts"))
    later = [last.select(*(F.expr(f"ts + INTERVAL {days} DAYS").alias("ts") if f.name == "ts" else F.lit("end").alias(f.name) if f.dataType.simpleString() == "string" else F.lit(0).cast(f.dataType).alias(f.name) for f in rows.schema)) for days in (400, 800)]
    return file_stream(parts + later)


def drain(stream: DataFrame, mode: str = "append", lag: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Runs to the end of what there is; the sink is a Parquet folder, written anew by each batch in mode complete."""
    spark = stream.sparkSession
    out, marks = new_path(spark, "stream"), new_path(spark, "marks")
    schema = stream.schema

    def put(batch: DataFrame, epoch: int) -> None:
        (lag(batch, epoch) if lag else batch).write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/epoch={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("basePath", out).parquet(out).select(*schema.names)


def windowed(stream: DataFrame, width: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """channel, start_ms, messages of each window, tumbling or sliding; in mode append a window comes once the watermark has passed it,
    and its state goes."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "channel").agg(F.count("*").alias("messages"))
    return w.select("channel", F.unix_millis("window.start").alias("start_ms"), "messages")


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start_ms, end_ms, messages of each session: messages of a user closer than the gap."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("messages"))
    return w.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), F.unix_millis("session_window.end").alias("end_ms"), "messages")


class Lagged(RuntimeError):
    """A consumer is further behind than its policy allows."""


def checked_lag(policy: str = "ignore", most: int | None = None) -> Callable[[DataFrame, int], DataFrame]:
    """For foreachBatch: what becomes of a batch with more than `most` messages. ignore, log: all of it; skip: its newest `most`; error: Lagged.

    A durable log has no gaps: lag is how much a batch holds, and nothing is lost but by `skip`.
    """
    if policy not in ("ignore", "log", "skip", "error"):
        raise ValueError(policy)

    def check(batch: DataFrame, epoch: int) -> DataFrame:
        if most is None or policy == "ignore" or (n := batch.count()) <= most:
            return batch
        if policy == "error":
            raise Lagged(f"batch {epoch} has {n} messages, {most} at most")
        if policy == "log":
            logging.getLogger(__name__).warning("batch %d has %d messages, more than %d", epoch, n, most)
            return batch
        return batch.orderBy(F.desc("ms"), F.desc("payload")).limit(most)

    return check


def last_seen(stream: DataFrame, idle_ms: int) -> DataFrame:
    """user_id, seen, last_ms each time that something comes from a user; a user's state goes after idle_ms of event time."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen, last = state.get if state.exists else (0, 0)
        if seen and last + idle_ms <= state.getCurrentWatermarkMs():
            seen = 0  # it was due to go before this batch
        for p in parts:
            seen, last = seen + len(p), max(last, int(p["ms"].max()))
        state.update((seen, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "last_ms": [last]})

    keyed = stream.withWatermark("ts", "1 hour").groupBy("user_id")
    return keyed.applyInPandasWithState(fold, "user_id long, seen long, last_ms long", "seen long, last_ms long", "update", GroupStateTimeout.EventTimeTimeout)
