"""Hashes, lists, sets, sorted sets, bitmaps and sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import fixtures as kv
from keyloom.operators import bitmaps, hashes, hll, lists, sets, zsets

from .base import HASHES, HIGH, LISTS, SCORES, SETS, SHARES, query

TYPES = ["click", "view", "purchase"]
IN_TYPES = "('click', 'view', 'purchase')"
PRIORITIES = ["1-URGENT", "2-HIGH"]


def _hash(spark, d):
    return hashes.hset(kv.kv_hashes(spark, d))


@query(f"SELECT key, field, value FROM {HASHES}")
def hash_hset(spark, d):
    return _hash(spark, d)


@query(f"SELECT key, field, value FROM {HASHES} WHERE key = 'user:7' AND field = 'click'")
def hash_hget(spark, d):
    return hashes.hset(hashes.hget(kv.kv_hashes(spark, d), "user:7", "click"))


@query(f"SELECT key, max(value) FILTER (field = 'view') AS v0, max(value) FILTER (field = 'nothing') AS v1, max(value) FILTER (field = 'click') AS v2 FROM {HASHES} GROUP BY key")
def hash_hmget(spark, d):
    return hashes.hmget(_hash(spark, d), ["view", "nothing", "click"])


@query(f"SELECT key, field, value FROM {HASHES} WHERE field NOT IN ('click', 'signup')")
def hash_hdel(spark, d):
    return hashes.hdel(_hash(spark, d), ["click", "signup"])


@query(f"SELECT key, max((field = 'purchase')::INT) AS found FROM {HASHES} GROUP BY key")
def hash_hexists(spark, d):
    return hashes.hexists(_hash(spark, d), "purchase")


@query(f"SELECT key, count(*) AS fields FROM {HASHES} GROUP BY key")
def hash_hlen(spark, d):
    return hashes.hlen(_hash(spark, d))


@query(f"SELECT key, string_agg(field, ',' ORDER BY field) AS names FROM {HASHES} GROUP BY key")
def hash_hkeys(spark, d):
    return hashes.hkeys(_hash(spark, d)).withColumn("names", F.array_join("names", ","))


@query(f"SELECT key, string_agg(value, ';' ORDER BY field) AS items FROM {HASHES} GROUP BY key")
def hash_hvals(spark, d):
    return hashes.hvals(_hash(spark, d)).withColumn("items", F.array_join("items", ";"))


@query(f"SELECT key, string_agg(field || ';' || value, ';' ORDER BY field) AS items FROM {HASHES} GROUP BY key")
def hash_hgetall(spark, d):
    return hashes.hgetall(_hash(spark, d)).withColumn("items", F.array_join("items", ";"))


@query()
def hash_hrandfield(spark, d):
    return hashes.hrandfield(_hash(spark, d), 2)


@query("SELECT 'user:' || user_id AS key, event_type AS field, (7 + sum(event_id % 11 - 5))::BIGINT::VARCHAR AS value FROM events GROUP BY ALL")
def hash_hincrby(spark, d):
    e = kv.table(spark, d, "events").select(kv.user_key().alias("key"), F.col("event_type").alias("field"), (F.col("event_id") % 11 - 5).alias("delta"))
    state = e.select("key", "field").distinct().withColumn("value", F.lit("7"))
    return hashes.hincrby(state, e)


@query("SELECT 'user:' || user_id AS key, event_type AS field, round(0.5 + sum(value), 2) AS value FROM events GROUP BY ALL")
def hash_hincrbyfloat(spark, d):
    e = kv.table(spark, d, "events").select(kv.user_key().alias("key"), F.col("event_type").alias("field"), F.col("value").alias("delta"))
    state = e.select("key", "field").distinct().withColumn("value", F.lit("0.5"))
    return hashes.hincrbyfloat(state, e).withColumn("value", F.round("value", 2))


def _list(spark, d, left=False):
    return lists.pushed(kv.kv_pushes(spark, d), left)


def _shown(df, *names):
    return df.select("key", *(F.array_join(n, ",").alias(n) for n in names))


@query(f"SELECT key, array_to_string(items, ',') AS items FROM {LISTS}")
def list_rpush(spark, d):
    return _shown(_list(spark, d), "items")


@query(f"SELECT key, array_to_string(list_reverse(items), ',') AS items FROM {LISTS}")
def list_lpush(spark, d):
    return _shown(_list(spark, d, True), "items")


@query(f"SELECT key, items[1] AS popped, array_to_string(items[2:], ',') AS items FROM {LISTS}")
def list_lpop(spark, d):
    popped, rest = lists.lpop(F.col("items"))
    return _list(spark, d).select("key", popped.alias("popped"), F.array_join(rest, ",").alias("items"))


@query(f"SELECT key, items[len(items)] AS popped, array_to_string(items[:len(items) - 1], ',') AS items FROM {LISTS}")
def list_rpop(spark, d):
    popped, rest = lists.rpop(F.col("items"))
    return _list(spark, d).select("key", popped.alias("popped"), F.array_join(rest, ",").alias("items"))


@query(f"SELECT key, len(items)::BIGINT AS length FROM {LISTS}")
def list_llen(spark, d):
    return _list(spark, d).select("key", lists.llen(F.col("items")).alias("length"))


@query(f"SELECT key, array_to_string(items[2:4], ',') AS middle, array_to_string(items[greatest(len(items) - 2, 1):], ',') AS tail, items[1] AS head FROM {LISTS}")
def list_lrange(spark, d):
    i = F.col("items")
    df = _list(spark, d).select("key", lists.lrange(i, 1, 3).alias("middle"), lists.lrange(i, -3, -1).alias("tail"), lists.lrange(i, 0, -100_000_000).alias("head"))
    return _shown(df, "middle", "tail", "head")


@query(f"SELECT key, array_to_string(list_concat(['first'], items[2:]), ',') AS items FROM {LISTS}")
def list_lset(spark, d):
    return _shown(_list(spark, d).withColumn("items", lists.lset(F.col("items"), 0, "first")), "items")


@query(f"""WITH p AS (SELECT key, value, seq, row_number() OVER (PARTITION BY key, value ORDER BY seq) AS n, row_number() OVER (PARTITION BY key, value ORDER BY seq DESC) AS m FROM (SELECT 'user:' || user_id AS key, event_type AS value, event_id AS seq FROM events))
SELECT key, coalesce(string_agg(value, ',' ORDER BY seq) FILTER (value <> 'click'), '') AS without, coalesce(string_agg(value, ',' ORDER BY seq) FILTER (value <> 'view' OR n > 2), '') AS fewer, coalesce(string_agg(value, ',' ORDER BY seq) FILTER (value <> 'view' OR m > 1), '') AS last_gone FROM p GROUP BY key""")
def list_lrem(spark, d):
    i = F.col("items")
    df = _list(spark, d).select("key", lists.lrem(i, 0, "click").alias("without"), lists.lrem(i, 2, "view").alias("fewer"), lists.lrem(i, -1, "view").alias("last_gone"))
    return _shown(df, "without", "fewer", "last_gone")


@query(f"SELECT key, member FROM {SETS}")
def set_sadd(spark, d):
    return sets.sadd(kv.kv_sets(spark, d))


@query(f"SELECT key, member FROM {SETS} WHERE member % 3 <> 0")
def set_srem(spark, d):
    s = kv.kv_sets(spark, d)
    return sets.srem(sets.sadd(s), s.where("member % 3 = 0"))


@query(f"SELECT key, count(*) AS members FROM {SETS} GROUP BY key")
def set_scard(spark, d):
    return sets.scard(kv.kv_sets(spark, d))


@query(f"SELECT member FROM {SETS} WHERE key = 'signup'")
def set_smembers(spark, d):
    return sets.smembers(kv.kv_sets(spark, d), "signup")


@query(f"SELECT 'click' AS key, u.user_id * 2 AS member, (s.member IS NOT NULL)::INT AS found FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN {SETS} s ON s.key = 'click' AND s.member = u.user_id * 2")
def set_sismember(spark, d):
    asked = kv.table(spark, d, "events").select("user_id").distinct().select(F.lit("click").alias("key"), (F.col("user_id") * 2).alias("member"))
    return sets.sismember(kv.kv_sets(spark, d), asked)


def _high(spark, d):
    """Who had an event of a kind with a value above 150."""
    return kv.table(spark, d, "events").where("value > 150").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"))


@query(f"SELECT member FROM {HIGH} WHERE key IN {IN_TYPES} GROUP BY member HAVING count(*) = 3")
def set_sinter(spark, d):
    return sets.sinter(_high(spark, d), TYPES)


@query(f"SELECT DISTINCT member FROM {HIGH} WHERE key IN {IN_TYPES}")
def set_sunion(spark, d):
    return sets.sunion(_high(spark, d), TYPES)


@query(f"SELECT member FROM {HIGH} WHERE key = 'view' EXCEPT SELECT member FROM {HIGH} WHERE key IN ('signup', 'purchase')")
def set_sdiff(spark, d):
    return sets.sdiff(_high(spark, d), ["view", "signup", "purchase"])


@query()
def set_srandmember(spark, d):
    return sets.srandmember(kv.kv_sets(spark, d), 5)


@query(f"SELECT key, least(count(*), 5)::BIGINT AS popped, greatest(count(*) - 5, 0)::BIGINT AS stayed FROM {SETS} GROUP BY key")
def set_spop(spark, d):
    gone, rest = sets.spop(kv.kv_sets(spark, d), 5)
    both = gone.select("key", F.lit(1).alias("g")).unionByName(rest.select("key", F.lit(0).alias("g")))
    return both.groupBy("key").agg(F.sum("g").alias("popped"), F.sum(1 - F.col("g")).alias("stayed"))


def _zset(spark, d):
    return zsets.zincrby(kv.kv_scores(spark, d)).withColumn("score", F.round("score", 2))


def _shares(spark, d):
    o = kv.table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member"), F.col("o_totalprice").alias("increment"))
    return zsets.zincrby(o).withColumn("score", F.round("score", 2))


def _ranked(order: str, where: str) -> str:
    return f"SELECT key, member, score, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) - 1 AS place, count(*) OVER (PARTITION BY key) AS n FROM {SCORES}) WHERE {where}"


@query(_ranked("score DESC, member DESC", "place < 10"))
def leaderboard_zrevrange(spark, d):
    return zsets.zrange(_zset(spark, d), 0, 9, reverse=True)


@query(_ranked("score, member", "place BETWEEN 2 AND 6"))
def zset_zrange(spark, d):
    return zsets.zrange(_zset(spark, d), 2, 6)


@query(_ranked("score, member", "place >= n - 3"))
def zset_zrange_tail(spark, d):
    return zsets.zrange(_zset(spark, d), -3, -1)


@query(f"SELECT key, member, place FROM ({_ranked('score, member', 'true')}) JOIN (SELECT key, min(member) AS member FROM {SCORES} GROUP BY key) USING (key, member)")
def zset_zrank(spark, d):
    z = _zset(spark, d)
    return zsets.zrank(z, z.groupBy("key").agg(F.min("member").alias("member")))


@query(f"SELECT key, member, place FROM ({_ranked('score DESC, member DESC', 'true')}) JOIN (SELECT key, min(member) AS member FROM {SCORES} GROUP BY key) USING (key, member)")
def zset_zrevrank(spark, d):
    z = _zset(spark, d)
    return zsets.zrank(z, z.groupBy("key").agg(F.min("member").alias("member")), reverse=True)


@query(f"SELECT key, member, score FROM {SCORES} WHERE key = 'BUILDING' AND member = (SELECT min(member) FROM {SCORES} WHERE key = 'BUILDING')")
def zset_zscore(spark, d):
    z = _zset(spark, d)
    return zsets.zscore(z, "BUILDING", z.where("key = 'BUILDING'").agg(F.min("member")).first()[0]).select("key", "member", "score")


@query(f"SELECT key, count(*) AS members FROM {SCORES} GROUP BY key")
def zset_zcard(spark, d):
    return zsets.zcard(_zset(spark, d))


@query(f"SELECT key, count(*) FILTER (score BETWEEN 100000 AND 1000000) AS members FROM {SCORES} GROUP BY key")
def zset_zcount(spark, d):
    return zsets.zcount(_zset(spark, d), 100_000, 1_000_000)


@query(f"SELECT key, member, score FROM {SHARES}")
def zset_zincrby(spark, d):
    return _shares(spark, d)


@query("SELECT o_orderstatus AS key, o_custkey AS member, arg_max(o_totalprice, o_orderkey) AS score FROM orders GROUP BY ALL")
def zset_zadd(spark, d):
    o = kv.table(spark, d, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_custkey").alias("member"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("seq"))
    return zsets.zadd(o)


@query(f"SELECT key, member, score FROM {SCORES} WHERE score BETWEEN 1000000 AND 2000000")
def zset_zrangebyscore(spark, d):
    return zsets.zrangebyscore(_zset(spark, d), 1_000_000, 2_000_000)


@query("SELECT c_mktsegment AS key, c_name AS member, c_acctbal AS score FROM customer WHERE c_name BETWEEN 'Customer#000000010' AND 'Customer#000000400'")
def zset_zrangebylex(spark, d):
    c = kv.table(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))
    return zsets.zrangebylex(c, "Customer#000000010", "Customer#000000400")


@query(f"SELECT key, member, score FROM {SCORES} WHERE member % 2 = 1")
def zset_zrem(spark, d):
    z = _zset(spark, d)
    return zsets.zrem(z, z.where("member % 2 = 0"))


@query(f"SELECT member, round(sum(score), 2) AS score FROM {SHARES} WHERE key IN ('1-URGENT', '2-HIGH') GROUP BY member")
def zset_zunionstore(spark, d):
    return zsets.zunion(_shares(spark, d), PRIORITIES).withColumn("score", F.round("score", 2))


@query(f"SELECT member, round(sum(score), 2) AS score FROM {SHARES} WHERE key IN ('1-URGENT', '2-HIGH') GROUP BY member HAVING count(*) = 2")
def zset_zinterstore(spark, d):
    return zsets.zinter(_shares(spark, d), PRIORITIES).withColumn("score", F.round("score", 2))


@query(_ranked("score, member", "place < 3"))
def zset_zpopmin(spark, d):
    return zsets.zpop(_zset(spark, d), 3)[0]


@query(f"SELECT key, member, score FROM ({_ranked('score DESC, member DESC', 'place >= 3')})")
def zset_zpopmax_rest(spark, d):
    return zsets.zpop(_zset(spark, d), 3, highest=True)[1].select("key", "member", "score")


@query("SELECT event_type AS key, max((user_id = 17)::INT) AS bit FROM events GROUP BY ALL")
def bit_getbit(spark, d):
    return bitmaps.getbit(kv.kv_bits(spark, d), 17)


@query("SELECT event_type AS key, user_id AS offset, event_id AS seq, (event_id % 2)::INT AS bit, coalesce(lag((event_id % 2)::INT) OVER (PARTITION BY event_type, user_id ORDER BY event_id), 0) AS old FROM events")
def bit_setbit_old(spark, d):
    return bitmaps.setbit_old(kv.kv_bits(spark, d).withColumn("bit", (F.col("seq") % 2).cast("int")))


@query(f"SELECT key, count(*) FILTER (member >= 10 AND member < 100) AS ones FROM {SETS} GROUP BY key")
def bit_bitcount(spark, d):
    return bitmaps.bitcount(kv.kv_bits(spark, d), 10, 100)


def _bit_sql(having: str) -> str:
    return f"SELECT member AS offset FROM {SETS} WHERE key IN {IN_TYPES} GROUP BY member HAVING {having}"


@query(_bit_sql("count(*) = 3"))
def bit_op_and(spark, d):
    return bitmaps.bitop(kv.kv_bits(spark, d), "AND", [*TYPES, "missing"])


@query(_bit_sql("count(*) >= 1"))
def bit_op_or(spark, d):
    return bitmaps.bitop(kv.kv_bits(spark, d), "OR", TYPES)


@query(_bit_sql("count(*) % 2 = 1"))
def bit_op_xor(spark, d):
    return bitmaps.bitop(kv.kv_bits(spark, d), "XOR", TYPES)


@query(f"SELECT o AS offset FROM range(((SELECT max(member) FROM {SETS} WHERE key = 'signup') // 8 + 1) * 8) r(o) WHERE o NOT IN (SELECT member FROM {SETS} WHERE key = 'signup')")
def bit_op_not(spark, d):
    return bitmaps.bitnot(kv.kv_bits(spark, d), "signup")


@query(f"SELECT key, min(member) AS offset FROM {SETS} GROUP BY key")
def bit_bitpos(spark, d):
    return bitmaps.bitpos(kv.kv_bits(spark, d), 1)


@query(f"SELECT key, coalesce(min(i) FILTER (member <> i), max(i) + 1) AS offset FROM (SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY member) - 1 AS i FROM {SETS}) GROUP BY key")
def bit_bitpos_clear(spark, d):
    return bitmaps.bitpos(kv.kv_bits(spark, d), 0)


@query(f"SELECT key, member // 8 AS byte, sum(pow(2, 7 - member % 8))::INT AS value FROM {SETS} GROUP BY ALL")
def bit_packed(spark, d):
    return bitmaps.packed(kv.kv_bits(spark, d))


@query("SELECT l_returnflag AS key, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY ALL")
def hll_pfcount(spark, d):
    rows = kv.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("elem"))
    exact = rows.groupBy("key").agg(F.countDistinct("elem").alias("exact"))
    out = hll.pfcount(hll.pfadd(rows)).join(exact, "key")
    return out.select("key", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.05).alias("within"))


@query("SELECT count(DISTINCT user_id) AS exact, true AS within FROM events")
def hll_pfmerge(spark, d):
    e = kv.table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("elem"))
    merged = hll.pfmerge(hll.pfadd(e)).select(F.hll_sketch_estimate("sketch").alias("estimate"))
    exact = e.agg(F.countDistinct("elem").alias("exact"))
    return merged.crossJoin(exact).select("exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("exact") * 0.05).alias("within"))
