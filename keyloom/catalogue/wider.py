"""Lists as logs, ordered ranges, subscribers, series with labels, routing, load and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import fixtures as kv
from keyloom.functions import text
from keyloom.operators import bitmaps, lists, metrics, ordered, pubsub, sharding, streams, timeseries

from .base import MESSAGES, SAMPLES, STREAMS, STRINGS, query
from .events import JAN5, JAN10, SHARD

_OPS = "(SELECT 'user:' || user_id AS key, event_id AS seq, event_type AS op, 'v' || event_id % 3 AS value FROM events)"
_STEP = (
    "CASE op WHEN 'click' THEN list_append(items, value) WHEN 'view' THEN list_prepend(value, items) WHEN 'purchase' THEN items[2:] WHEN 'signup' THEN items[:len(items) - 1] "
    "ELSE CASE WHEN list_contains(items, value) THEN items[:list_position(items, value) - 1] || items[list_position(items, value) + 1:] ELSE items END END"
)


@query(
    f"WITH RECURSIVE ops AS (SELECT key, op, value, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM {_OPS}), st AS (SELECT DISTINCT key, 0::BIGINT AS i, []::VARCHAR[] AS items FROM ops "
    f"UNION ALL SELECT st.key, ops.i, {_STEP} FROM st JOIN ops ON ops.key = st.key AND ops.i = st.i + 1), "
    "final AS (SELECT key, arg_max(items, i) AS items FROM st GROUP BY key) SELECT key, unnest(range(len(items))) AS idx, unnest(items) AS value FROM final"
)
def list_fold(spark, d):
    """Clicks push right, views push left, purchases pop left, sign-ups pop right, errors remove the first equal value."""
    op = F.col("event_type")
    ops = F.when(op == "click", "rpush").when(op == "view", "lpush").when(op == "purchase", "lpop").when(op == "signup", "rpop").otherwise("lrem")
    log = kv.table(spark, d, "events").select(kv.user_key().alias("key"), F.col("event_id").alias("seq"), ops.alias("op"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("value"), F.lit(1).alias("at"))
    return lists.fold(log)


@query(f"SELECT key, value FROM {STRINGS} WHERE key >= 'customer:2' AND key < 'customer:4'")
def range_half_open(spark, d):
    return ordered.half_open(kv.kv_strings(spark, d), "key", "customer:2", "customer:4")


@query(f"SELECT key, min(seq) AS first_seq, arg_min(user_id, seq) AS first_user, max(seq) AS last_seq, arg_max(user_id, seq) AS last_user FROM {STREAMS} GROUP BY key")
def range_ends(spark, d):
    e = ordered.ends(kv.kv_streams(spark, d), "seq", "key")
    return e.select("key", F.col("first.seq").alias("first_seq"), F.col("first.user_id").alias("first_user"), F.col("last.seq").alias("last_seq"), F.col("last.user_id").alias("last_user"))


@query(f"SELECT key, value FROM {STRINGS} ORDER BY key DESC")
def range_iterate_back(spark, d):
    return ordered.iterate(kv.kv_strings(spark, d), "key", descending=True)


@query("SELECT event_type AS key, min(user_id) FILTER (user_id >= 20 AND user_id < 90) AS first_set FROM events GROUP BY event_type")
def bit_bitpos_range(spark, d):
    return bitmaps.bitpos(kv.kv_bits(spark, d), 1, 20, 90).withColumnRenamed("offset", "first_set")


@query("WITH b AS (SELECT DISTINCT event_type AS key, user_id AS o FROM events WHERE user_id % 7 <> 3), k AS (SELECT DISTINCT key FROM b) SELECT key, min(i) AS first_clear FROM k, (SELECT unnest(range(20, 90)) AS i) r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.key = k.key AND b.o = r.i) GROUP BY key")
def bit_bitpos_clear_range(spark, d):
    rows = kv.kv_bits(spark, d).where("offset % 7 <> 3")
    return bitmaps.bitpos(rows, 0, 20, 90).withColumnRenamed("offset", "first_clear")


_SUBS = "(SELECT DISTINCT 's' || user_id % 5 AS subscriber, event_type AS channel FROM events WHERE user_id % 5 < 3 OR event_type = 'click')"
_PASSES = "(strlen(payload) BETWEEN 8 AND 9 AND user_id IS NOT NULL AND ms >= 1704412800000 AND seq % 3 <> 0)"


def _subs(spark, d):
    e = kv.table(spark, d, "events").where("user_id % 5 < 3 or event_type = 'click'")
    return e.select(F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("subscriber"), F.col("event_type").alias("channel")).distinct()


def _all_filters():
    return pubsub.selected(pubsub.size_between(8, 9), pubsub.metadata(["user"], since=JAN5), pubsub.content(["json"], json_keys=["k"]), lambda: F.col("seq") % 3 != 0, ("and", ("types", ["json", "string"]), ("metadata", True)))


@query(f"SELECT channel, message_id FROM {MESSAGES} WHERE {_PASSES}")
def pubsub_all_filters(spark, d):
    return kv.kv_messages(spark, d).where(_all_filters()).select("channel", "message_id")


@query(f"SELECT channel, message_id FROM {MESSAGES} WHERE seq % 2 = 0 AND seq % 3 = 0 AND seq % 5 <> 0")
def pubsub_type_filter(spark, d):
    """Types by turn, some messages without metadata; nested tests are all to hold."""
    m = kv.kv_messages(spark, d)
    kind = F.when(F.col("seq") % 2 == 0, F.when(F.col("seq") % 3 == 0, "json").otherwise("bytes")).otherwise("string")
    bare = F.col("seq") % 5 == 0
    m = m.select("channel", F.col("message_id").alias("id"), kind.alias("payload_type"), *(F.when(~bare, F.col(c)).alias(c) for c in ("message_id", "ms", "headers")))
    test = ("and", ("types", ["json", "bytes"]), ("and", ("types", ["json", "string"]), ("metadata", True)))
    return m.where(pubsub.selected(kind=test)).select("channel", F.col("id").alias("message_id"))


@query(f"SELECT subscriber, count(*) FILTER ({_PASSES}) AS received, coalesce(sum(strlen(payload)) FILTER ({_PASSES}), 0)::BIGINT AS bytes, count(*) FILTER (NOT {_PASSES}) AS filtered, max(ms) FILTER ({_PASSES}) AS last_ms FROM {MESSAGES} m JOIN {_SUBS} s USING (channel) GROUP BY subscriber")
def pubsub_subscriber_stats(spark, d):
    return pubsub.subscriber_stats(kv.kv_messages(spark, d), _subs(spark, d), _all_filters())


@query(f"SELECT channel, message_id, coalesce((SELECT count(*) FROM {_SUBS} s WHERE s.channel = m.channel AND s.subscriber <> 's4'), 0) AS receivers FROM {MESSAGES} m WHERE seq % 100 = 0")
def pubsub_publish(spark, d):
    m = kv.kv_messages(spark, d)
    return pubsub.published(m.where("seq % 100 <> 0"), m.where("seq % 100 = 0"), _subs(spark, d).where("subscriber <> 's4'"))[1]


@query(f"SELECT DISTINCT channel FROM {_SUBS} WHERE channel LIKE '%i%'")
def pubsub_channels(spark, d):
    return pubsub.active_channels(_subs(spark, d), "*i*")


@query(f"SELECT channel, (SELECT count(DISTINCT subscriber) FROM {_SUBS} s WHERE s.channel = a.channel) AS subscribers FROM (VALUES ('click'), ('view'), ('nobody')) a(channel)")
def pubsub_numsub(spark, d):
    return pubsub.numsub(_subs(spark, d), ["click", "view", "nobody"])


@query(f"SELECT channel, count(*) AS messages FROM {MESSAGES} WHERE channel IN ('click', 'error', 'view') GROUP BY channel")
def pubsub_fan_in(spark, d):
    m = kv.kv_messages(spark, d)
    return pubsub.fan_in(*(m.where(F.col("channel") == c) for c in ("click", "error", "view"))).groupBy("channel").agg(F.count("*").alias("messages"))


@query(f"SELECT key, ms // 86400000 AS ms, max(seq) AS seq, arg_max(value, seq) AS value FROM {SAMPLES} GROUP BY ALL")
def ts_add(spark, d):
    """Half of the samples are there and half are added, a day being one time."""
    t = kv.kv_samples(spark, d).withColumn("ms", F.floor(F.col("ms") / 86_400_000))
    return timeseries.add(t.where("seq % 2 = 0"), t.where("seq % 2 = 1")).select("key", "ms", "seq", "value")


@query("SELECT DISTINCT event_type || ':' || user_id % 4 AS key, 1000 * (user_id % 4) AS retention_ms FROM events WHERE event_type = 'view' AND user_id % 4 >= 2")
def ts_labels(spark, d):
    label = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("half"), (F.col("user_id") % 4 >= 2).cast("string"))
    new = kv.table(spark, d, "events").select(F.concat_ws(":", "event_type", (F.col("user_id") % 4).cast("string")).alias("key"), (1000 * (F.col("user_id") % 4)).alias("retention_ms"), label.alias("labels"), F.col("event_type"), (F.col("user_id") % 4).alias("n"))
    new = new.dropDuplicates(["key"]).select("key", "retention_ms", "labels")
    series = timeseries.create(new.where("false"), new)
    return timeseries.labelled(series, {"kind": "view", "half": "true"}).select("key", "retention_ms")


@query(f"SELECT key, ms, seq FROM {STREAMS} WHERE key = 'click' AND ms >= {JAN10} AND seq % 4 <> 1")
def stream_group_undelivered(spark, d):
    s = kv.kv_streams(spark, d)
    none = spark.range(0).select(F.lit("").alias("group"), F.lit("").alias("key"), F.col("id").alias("ms"), F.col("id").alias("seq"))
    groups = streams.xgroup_create(none, "click", "workers", (JAN10 - 1, 2**62))
    acks = s.where("seq % 4 = 1").select(F.lit("workers").alias("group"), "key", "ms", "seq")
    return streams.undelivered(s, groups, acks, "workers").select("key", "ms", "seq")


@query("SELECT user_id % 16384 AS slot, CASE WHEN user_id % 16384 <= 40 THEN 'a' WHEN user_id % 16384 <= 16000 THEN 'b' END AS shard, count(*) AS ops FROM events GROUP BY ALL")
def shard_routing(spark, d):
    ranges = spark.createDataFrame([(0, 40, "a"), (41, 16_000, "b")], "first long, last long, shard string")
    ops = kv.table(spark, d, "events").groupBy((F.col("user_id") % 16_384).alias("slot")).agg(F.count("*").alias("ops"))
    return sharding.routed(ops, ranges).select("slot", "shard", "ops")


@query(f"WITH p AS (SELECT shard, count(DISTINCT key) AS keys FROM {SHARD} GROUP BY shard) SELECT min(keys) AS least, arg_min(shard, (keys, shard)) AS least_shard, max(keys) AS most, arg_max(shard, (keys, shard)) AS most_shard FROM p")
def shard_extremes(spark, d):
    e = kv.table(spark, d, "events").select((F.col("user_id") % 3).alias("shard"), "user_id")
    return sharding.extremes(e.groupBy("shard").agg(F.countDistinct("user_id").alias("keys")))


@query("WITH b AS (SELECT user_id % 5 AS shard, count(*)::DOUBLE AS load FROM events GROUP BY ALL), a AS (SELECT event_id % 5 AS shard, count(*)::DOUBLE AS load FROM events GROUP BY ALL) SELECT round((SELECT var_pop(load) FROM b), 4) AS before, round((SELECT var_pop(load) FROM a), 4) AS after")
def load_variance(spark, d):
    """The variance of five shards' loads by user, and after dealing events out evenly."""
    e = kv.table(spark, d, "events")
    one = lambda c, name: metrics.load_variance(e.groupBy((F.col(c) % 5).alias("shard")).agg(F.count("*").cast("double").alias("load"))).select(F.round("variance", 4).alias(name))
    return one("user_id", "before").crossJoin(F.broadcast(one("event_id", "after")))


@query("SELECT l_returnflag AS op, count(*) AS n, count(*) FILTER (l_quantity > 45) AS slow, round(100.0 * count(*) FILTER (l_quantity > 45) / count(*), 6) AS percent FROM lineitem GROUP BY ALL")
def slow_share(spark, d):
    return metrics.slow_share(kv.kv_latency(spark, d), 45).withColumn("percent", F.round("percent", 6))


@query("SELECT 'user:' || user_id AS key, event_id, value AS ms FROM events WHERE value > 190")
def slow_log(spark, d):
    e = kv.table(spark, d, "events").select(kv.user_key().alias("key"), "event_id", F.col("value").alias("ms"))
    return metrics.slow_log(e, 190, "event_id")


@query(f"WITH e AS (SELECT unnest(range((SELECT min(ms) // 21600000 FROM {SAMPLES}), (SELECT max(ms) // 21600000 + 5 FROM {SAMPLES}))) * 21600000 AS end_ms) SELECT end_ms, count(*)::BIGINT AS n, round(sum(value), 2) AS total FROM e JOIN {SAMPLES} ON ms >= end_ms - 86400000 AND ms < end_ms GROUP BY end_ms")
def metrics_sliding_history(spark, d):
    return metrics.sliding_history(kv.kv_samples(spark, d), 86_400_000, 21_600_000).withColumn("total", F.round("total", 2))


@query(f"SELECT key, ms, value FROM {SAMPLES} WHERE ms > {JAN10} - 86400000 AND ms <= {JAN10}")
def metrics_recent(spark, d):
    return metrics.recent(kv.kv_samples(spark, d), 86_400_000, JAN10).select("key", "ms", "value")


@query("SELECT event_id, epoch_us(ts) // 1000000 AS seconds, epoch_us(ts) % 1000000 AS micros FROM events")
def server_time(spark, d):
    micros = F.unix_micros(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone()))
    return kv.table(spark, d, "events").select("event_id", text.time(micros).alias("t")).select("event_id", "t.*")


_MIXED = "CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN user_id || '.5' WHEN 2 THEN props WHEN 3 THEN 'x' || user_id END"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'json' WHEN 3 THEN 'string' ELSE 'nil' END AS kind, {_MIXED} AS back FROM events")
def value_typed(spark, d):
    m, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    value = F.when(m == 0, u).when(m == 1, F.concat(u, F.lit(".5"))).when(m == 2, F.col("props")).when(m == 3, F.concat(F.lit("x"), u))
    rows = kv.table(spark, d, "events").select("event_id", text.typed(value).alias("v"))
    return rows.select("event_id", "v.kind", text.untyped(F.col("v")).alias("back"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def value_json(spark, d):
    return kv.table(spark, d, "events").select("event_id", text.json_value(F.col("props"), "k bigint").alias("v")).select("event_id", "v.k")


@query("SELECT c_custkey, repeat(c_mktsegment, 3) AS thrice, substr(c_name, 1, 5) AS head, true AS valid, c_name || chr(65533) AS lossy FROM customer")
def sds_bytes(spark, d):
    broken = F.concat(F.col("c_name").cast("binary"), F.lit(bytearray(b"\xff")))
    c = kv.table(spark, d, "customer")
    return c.select("c_custkey", text.repeat(F.col("c_mktsegment"), 3).alias("thrice"), text.truncate(F.col("c_name"), 5).cast("string").alias("head"), (text.is_utf8(F.col("c_name")) & ~text.is_utf8(broken.cast("string"))).alias("valid"), text.lossy(broken.cast("string")).alias("lossy"))
