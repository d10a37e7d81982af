"""The driver's tables as typed keyspaces: one narrow table for each kind of value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import table


def epoch_ms(ts: Column) -> Column:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return F.unix_millis(F.from_utc_timestamp(ts.cast("timestamp"), F.current_timezone()))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", epoch_ms(F.col("ts")).alias("ms"), "user_id", "event_type", "value", "props")


def user_key() -> Column:
    return F.concat(F.lit("user:"), F.col("user_id").cast("string"))


def kv_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("value"))


def kv_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "del").otherwise("set")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), user_key().alias("key"), F.col("props").alias("value"))


def kv_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(user_key().alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") % 11 - 5).alias("delta"))


def kv_floats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.col("value").alias("delta"))


def kv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(user_key().alias("key"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq"))


def kv_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(user_key().alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"))


def kv_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With repeats: the operators make sets of it."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"))


def kv_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, member, increment: what every order adds to its customer's score."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    per = orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("increment"))
    return per.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("key"), F.col("o_custkey").alias("member"), "increment")


def kv_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("offset"), F.col("event_id").alias("seq"))


def kv_geos(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon = (F.col("c_custkey") * 7919 % 36000) / F.lit(100.0) - 180
    lat = (F.col("c_custkey") * 104729 % 16000) / F.lit(100.0) - 80
    return table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("member"), lon.alias("lon"), lat.alias("lat"))


def kv_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_type").alias("key"), "ms", F.col("event_id").alias("seq"), "user_id", "value")


def kv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(user_key().alias("key"), "ms", F.col("event_id").alias("seq"), "value")


def kv_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.create_map(F.lit("user"), F.col("user_id").cast("string"))
    return events(spark, sf_dir).select(F.col("event_type").alias("channel"), F.lit("json").alias("payload_type"), F.col("props").alias("payload"), F.concat(F.lit("m-"), F.col("event_id").cast("string")).alias("message_id"), "ms", header.alias("headers"), F.col("event_id").alias("seq"))


def kv_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.col("event_id").alias("key"), (F.col("ms") + F.col("event_id") % 30 * 86_400_000).alias("deadline"))


def kv_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("op"), F.col("l_quantity").alias("ms"), "l_orderkey")
