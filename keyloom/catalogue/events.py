"""Streams, time series, messages, expiry, shards, metrics and Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import fixtures as kv
from keyloom.functions import registry
from keyloom.operators import metrics, pubsub, sharding, streams, timeseries
from keyloom.streaming import channels

from .base import MESSAGES, SAMPLES, STREAMS, query

#: Fixed times of the queries, in ms: 5, 10 and 31 January 2024.
JAN5, JAN10, NOW = 1_704_412_800_000, 1_704_844_800_000, 1_706_659_200_000
DAY = 86_400_000


@query(f"SELECT key, ms || '-' || seq AS id, user_id, value FROM {STREAMS}")
def stream_xadd(spark, d):
    return kv.kv_streams(spark, d).select("key", streams.entry_id().alias("id"), "user_id", "value")


@query(f"SELECT key, ms, seq, user_id FROM {STREAMS} WHERE ms >= {JAN5} AND (ms < {JAN10} OR (ms = {JAN10} AND seq <= 0))")
def stream_xrange(spark, d):
    return streams.xrange(kv.kv_streams(spark, d), (JAN5, 0), (JAN10, 0)).select("key", "ms", "seq", "user_id")


@query(f"SELECT key, ms, seq, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC)::INT AS place FROM {STREAMS} WHERE ms BETWEEN {JAN5} AND {JAN10}) WHERE place <= 20")
def stream_xrevrange(spark, d):
    return streams.xrevrange(kv.kv_streams(spark, d), (JAN5, 0), (JAN10, 2**62), 20).select("key", "ms", "seq", "place")


@query(f"SELECT key, count(*) AS entries FROM {STREAMS} GROUP BY key")
def stream_xlen(spark, d):
    return streams.xlen(kv.kv_streams(spark, d))


@query(f"SELECT key, ms, seq FROM {STREAMS} WHERE seq % 5 <> 0")
def stream_xdel(spark, d):
    s = kv.kv_streams(spark, d)
    return streams.xdel(s, s.where("seq % 5 = 0")).select("key", "ms", "seq")


@query(f"SELECT key, ms, seq FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS n FROM {STREAMS}) WHERE n <= 100")
def stream_xtrim(spark, d):
    return streams.xtrim(kv.kv_streams(spark, d), 100).select("key", "ms", "seq")


@query(f"SELECT key, ms, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq)::INT AS n FROM {STREAMS} WHERE (key = 'click' AND (ms > {JAN5} OR (ms = {JAN5} AND seq > 0))) OR (key = 'view' AND (ms > {JAN10} OR (ms = {JAN10} AND seq > 0)))) WHERE n <= 25")
def stream_xread(spark, d):
    return streams.xread(kv.kv_streams(spark, d), {"click": (JAN5, 0), "view": (JAN10, 0)}, 25).select("key", "ms", "seq", "n")


@query(f"SELECT key, ms, seq FROM {STREAMS} WHERE seq % 4 <> 1")
def stream_pending(spark, d):
    s = kv.kv_streams(spark, d)
    acks = s.where("seq % 4 = 1").select(F.lit("workers").alias("group"), "key", "ms", "seq").unionByName(s.where("seq % 4 = 2").select(F.lit("others").alias("group"), "key", "ms", "seq"))
    return streams.pending(s, acks, "workers").select("key", "ms", "seq")


@query(f"SELECT key, max(ms) AS ms, arg_max(value, (ms, seq)) AS value FROM {SAMPLES} GROUP BY key")
def ts_get(spark, d):
    return timeseries.latest(kv.kv_samples(spark, d))


@query(f"SELECT key, ms, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n FROM {SAMPLES} WHERE ms BETWEEN {JAN5} AND {JAN10}) WHERE n <= 3")
def ts_range(spark, d):
    return timeseries.between(kv.kv_samples(spark, d), JAN5, JAN10, 3).select("key", "ms", "value")


@query(f"SELECT key, ms, value FROM {SAMPLES} WHERE NOT ms BETWEEN {JAN5} AND {JAN10}")
def ts_del(spark, d):
    return timeseries.delete(kv.kv_samples(spark, d), JAN5, JAN10).select("key", "ms", "value")


@query(f"SELECT key, ms, value FROM (SELECT *, max(ms) OVER (PARTITION BY key) AS newest FROM {SAMPLES}) WHERE ms >= newest - {7 * DAY}")
def ts_retention(spark, d):
    return timeseries.retained(kv.kv_samples(spark, d), 7 * DAY).select("key", "ms", "value")


@query(f"SELECT event_id AS key, epoch_us(ts) // 1000 + event_id % 30 * {DAY} AS deadline FROM events WHERE epoch_us(ts) // 1000 + event_id % 30 * {DAY} > {NOW}")
def ttl_live(spark, d):
    return timeseries.live(kv.kv_ttl(spark, d), NOW)


@query(f"SELECT event_id AS key, epoch_us(ts) // 1000 + event_id % 30 * {DAY} AS deadline FROM events WHERE epoch_us(ts) // 1000 + event_id % 30 * {DAY} <= {NOW}")
def ttl_expired(spark, d):
    return timeseries.expired(kv.kv_ttl(spark, d), NOW)


def _kept(df):
    return df.select("channel", "message_id")


@query(f"SELECT channel, message_id FROM {MESSAGES} WHERE channel = 'error' OR channel LIKE 'c%'")
def pubsub_channel_filter(spark, d):
    return _kept(kv.kv_messages(spark, d).where(pubsub.subscribed(["error"], ["c*"])))


@query(f"SELECT channel, message_id FROM {MESSAGES} WHERE strlen(payload) BETWEEN 9 AND 100")
def pubsub_size_filter(spark, d):
    return _kept(kv.kv_messages(spark, d).where(pubsub.size_between(9, 100)))


@query(f"SELECT channel, message_id FROM {MESSAGES} WHERE message_id LIKE 'm-1_%' AND ms BETWEEN {JAN5} AND {JAN10}")
def pubsub_metadata_filter(spark, d):
    return _kept(kv.kv_messages(spark, d).where(pubsub.metadata(["user"], "m-1?*", JAN5, JAN10)))


@query(f"SELECT channel, message_id FROM {MESSAGES} WHERE json_extract(payload, '$.k') IS NOT NULL AND seq % 2 = 0")
def pubsub_json_key_filter(spark, d):
    return _kept(kv.kv_messages(spark, d).where(pubsub.content(types=["json"], json_keys=["k"]) & (F.col("seq") % 2 == 0)))


@query(f"SELECT channel, message_id FROM {MESSAGES} WHERE payload LIKE '%7}}' OR payload LIKE '%: 1%'")
def pubsub_glob_filter(spark, d):
    return _kept(kv.kv_messages(spark, d).where(pubsub.content(globs=["*7}", "*: 1*"])))


STATS = f"SELECT channel, count(*) AS messages, sum(strlen(payload))::BIGINT AS bytes, max(ms) AS last_ms FROM {MESSAGES} GROUP BY channel"


@query(STATS)
def pubsub_channel_stats(spark, d):
    return pubsub.channel_stats(kv.kv_messages(spark, d))


@query(STATS)
def streaming_channel_stats(spark, d):
    stream = channels.messages(channels.event_stream(spark, d))
    return channels.drain(pubsub.channel_stats(stream), "complete")


@query(f"SELECT channel, ms, user_id FROM {MESSAGES} WHERE channel IN ('click', 'error') AND strlen(payload) <= 8")
def streaming_filter(spark, d):
    stream = channels.messages(channels.event_stream(spark, d))
    return channels.drain(stream.where(pubsub.subscribed(["click", "error"]) & pubsub.size_between(0, 8)).select("channel", "ms", "user_id"))


def _stream(spark, d):
    return channels.by_time(channels.messages(kv.table(spark, d, "events")).select("channel", "ms", "ts", "user_id"), 4)


@query(f"SELECT channel, ms // {DAY} * {DAY} AS start_ms, count(*) AS messages FROM {MESSAGES} GROUP BY ALL")
def stream_window_counts(spark, d):
    """Mode append over several batches: each window comes once, when the watermark has passed it."""
    return channels.drain(channels.windowed(_stream(spark, d))).where("channel <> 'end'")


@query(f"SELECT channel, s AS start_ms, count(*) AS messages FROM (SELECT channel, ms, unnest([ms // 21600000 * 21600000 - 21600000 * i for i in range(4)]) AS s FROM {MESSAGES}) WHERE s > ms - {DAY} GROUP BY ALL")
def stream_sliding_counts(spark, d):
    return channels.drain(channels.windowed(_stream(spark, d), slide="6 hours")).where("channel <> 'end'")


@query(f"SELECT user_id, min(ms) AS start_ms, max(ms) + {DAY} AS end_ms, count(*) AS messages FROM (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ms, seq) AS session FROM (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, seq) < {DAY} THEN 0 ELSE 1 END AS opens FROM {MESSAGES})) GROUP BY user_id, session")
def stream_session_counts(spark, d):
    last = _stream(spark, d).select("ts", F.when(F.col("channel") == "end", -1).otherwise(F.col("user_id")).alias("user_id"))
    return channels.drain(channels.sessions(last, "1 day")).where("user_id >= 0")


@query(f"SELECT user_id, count(*) AS seen, max(ms) AS last_ms FROM {MESSAGES} GROUP BY user_id")
def streaming_last_seen(spark, d):
    """What a user's state says last: every batch tells the users it has met."""
    out = channels.drain(channels.last_seen(channels.messages(channels.event_stream(spark, d)), 300_000), "update")
    return out.groupBy("user_id").agg(F.max("seen").alias("seen"), F.max("last_ms").alias("last_ms"))


SHARD = "(SELECT user_id % 3 AS shard, user_id % 64 AS slot, 'user:' || user_id AS key, event_type FROM events)"


def _ops(spark, d):
    return kv.table(spark, d, "events").select((F.col("user_id") % 3).alias("shard"), (F.col("user_id") % 64).alias("slot"), kv.user_key().alias("key"), "event_type")


@query(f"SELECT count(*) AS shards, sum(n)::BIGINT AS keys, round(avg(n), 6) AS mean, max(n) AS most, min(n) AS least, round(max(n) / min(n), 6) AS ratio FROM (SELECT shard, count(DISTINCT key) AS n FROM {SHARD} GROUP BY shard)")
def shard_balance(spark, d):
    return sharding.balance(_ops(spark, d)).withColumn("mean", F.round("mean", 6)).withColumn("ratio", F.round("ratio", 6))


@query(f"SELECT shard, count(*) AS ops, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM {SHARD} GROUP BY shard")
def load_share(spark, d):
    return sharding.load_share(_ops(spark, d)).withColumn("share", F.round("share", 6))


@query("SELECT 'supplier:' || l_suppkey AS key, count(*) AS ops FROM lineitem GROUP BY ALL HAVING count(*) > 100")
def hot_keys(spark, d):
    return sharding.hot_keys(kv.table(spark, d, "lineitem").select(F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("key")))


SKEWED = "(SELECT CASE WHEN user_id % 10 < 8 THEN 0 WHEN user_id % 10 = 8 THEN 1 ELSE 2 END AS shard, user_id % 64 AS slot FROM events)"


@query(f"""WITH per AS (SELECT shard, count(*) AS load FROM {SKEWED} GROUP BY shard), m AS (SELECT avg(load) AS mean FROM per),
to_ AS (SELECT arg_min(shard, (load, shard)) AS to_shard FROM per, m WHERE load < mean / 1.5)
SELECT slot, s.shard AS from_shard, to_shard, count(*) AS ops FROM {SKEWED} s JOIN (SELECT shard FROM per, m WHERE load > mean * 1.5) USING (shard), to_ WHERE to_shard IS NOT NULL
GROUP BY ALL HAVING count(*) > 100 ORDER BY ops DESC, slot LIMIT 64""")
def rebalance_candidates(spark, d):
    shard = F.when(F.col("user_id") % 10 < 8, 0).when(F.col("user_id") % 10 == 8, 1).otherwise(2)
    return sharding.moves(kv.table(spark, d, "events").select(shard.alias("shard"), (F.col("user_id") % 64).alias("slot")))


@query()
def key_slots(spark, d):
    """Hash slots by CRC16: told apart from SQL's reach, tested against published values."""
    keys = kv.table(spark, d, "events").select(kv.user_key().alias("key")).distinct()
    return keys.select("key", registry.slot(F.col("key")).alias("slot"))


@query("SELECT l_returnflag AS op, count(*) AS n, round(avg(l_quantity), 6) AS mean, list_sort(list(l_quantity))[least(floor(count(*) * 0.95)::BIGINT, count(*) - 1) + 1] AS p95, list_sort(list(l_quantity))[least(floor(count(*) * 0.99)::BIGINT, count(*) - 1) + 1] AS p99 FROM lineitem GROUP BY ALL")
def latency_percentiles(spark, d):
    return metrics.percentiles(kv.kv_latency(spark, d), {"p95": 0.95, "p99": 0.99}).withColumn("mean", F.round("mean", 6))


@query(f"SELECT epoch_us(ts) // 1000 // {DAY} * {DAY} AS slot_ms, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def metrics_history(spark, d):
    return metrics.history(kv.kv_samples(spark, d), DAY).withColumn("total", F.round("total", 2))


@query(f"""WITH per AS (SELECT shard, count(*) AS ops, count(*) FILTER (event_type = 'error') AS errors FROM {SHARD} GROUP BY shard),
g AS (SELECT avg(ops) AS mean, max(ops) AS most, min(ops) AS least, sum(ops) AS n, sum(errors) AS errors FROM per),
s AS (SELECT count(*) FILTER (ops BETWEEN mean * 0.5 AND mean * 2) AS healthy, count(*) AS shards, any_value(errors / n) AS rate, any_value(CASE WHEN least = 0 THEN 1.0 ELSE most / least END) AS imbalance FROM (SELECT per.shard, per.ops, g.mean, g.most, g.least, g.n, g.errors FROM per, g)),
t AS (SELECT healthy, shards, greatest(1 - least(rate, 0.5) * 2, 0) * greatest(1 - least(imbalance - 1, 2) / 2, 0) * healthy / shards AS score FROM s)
SELECT healthy, shards, round(score, 6) AS score, CASE WHEN score > 0.8 THEN 'healthy' WHEN score > 0.6 THEN 'warning' ELSE 'critical' END AS status FROM t""")
def health_report(spark, d):
    per = _ops(spark, d).groupBy("shard").agg(F.count("*").alias("ops"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return metrics.health(per).withColumn("score", F.round("score", 6))
