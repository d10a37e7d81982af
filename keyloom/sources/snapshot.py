"""Snapshots of a state, as Parquet folders, and the change log as a table of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Of the layout of snapshots.
VERSION = 1


def save(state: DataFrame, path: str, at: int) -> str:
    """One folder a snapshot, named by its time; Spark's commit makes it appear whole or not at all."""
    folder = f"{path}/snapshot={at}"
    state.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    # The header comes last: a snapshot without one isn't whole.
    rows = state.sparkSession.read.parquet(folder).agg(F.lit(VERSION).alias("version"), F.count("*").alias("rows"), F.lit(at).cast("long").alias("at"))
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/header={at}")
    return folder


def header(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """version, rows, at of the newest snapshot, or of one."""
    return spark.read.parquet(f"{path}/header={snapshots(spark, path)[0] if at is None else at}")


def foreach(state: DataFrame, call: Callable[[Iterator], None]) -> None:
    """Calls `call` with an iterator of rows for each part of a snapshot, on the executors."""
    state.foreachPartition(call)


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """Times of the snapshots there, the newest first."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    return sorted((int(n.split("=")[1]) for n in names if n.startswith("snapshot=")), reverse=True)


def load(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """The newest snapshot, or the newest of time `at` or before."""
    times = [t for t in snapshots(spark, path) if at is None or t <= at]
    if not times:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/snapshot={times[0]}")


def retain(spark: SparkSession, path: str, newest: int = 3) -> list[int]:
    """Deletes all but the newest snapshots; the times that went."""
    gone = snapshots(spark, path)[newest:]
    for t in gone:
        for what in ("header", "snapshot"):
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{what}={t}")
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def count(state: DataFrame) -> DataFrame:
    return state.agg(F.count("*").alias("rows"), F.sum(F.octet_length("key")).alias("key_bytes"))


def transform(state: DataFrame, keep: Column, value: Callable[[Column], Column]) -> DataFrame:
    return state.where(keep).withColumn("value", value(F.col("value")))


def checksummed(log: DataFrame) -> DataFrame:
    """The log with a crc of each record's key and value."""
    return log.withColumn("crc", record_crc())


def record_crc() -> Column:
    return F.crc32(F.concat_ws("\u0000", "op", "key", F.coalesce("value", F.lit(""))).cast("binary"))


def append(log: DataFrame, path: str) -> None:
    checksummed(log).write.mode("append").parquet(path)


def damaged(log: DataFrame) -> DataFrame:
    """Records whose crc doesn't fit."""
    return log.where(F.col("crc") != record_crc())


def export_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)
