"""Keys, strings, counters, the change log and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import fixtures as kv
from keyloom.operators import keyspace, numbers, strings
from keyloom.plans import log as folds
from keyloom.sources import snapshot
from keyloom.storage import new_path

from .base import INTS, LOG, STATE, STRINGS, query

WANTED = ["customer:7", "customer:3", "customer:0", "customer:7", "customer:42"]


@query(f"SELECT key, value FROM {STRINGS} WHERE key = 'customer:7'")
def str_get(spark, d):
    return strings.get(kv.kv_strings(spark, d), "customer:7")


@query(f"SELECT pos, a.key, s.value FROM (VALUES (0::BIGINT, 'customer:7'), (1, 'customer:3'), (2, 'customer:0'), (3, 'customer:7'), (4, 'customer:42')) a(pos, key) LEFT JOIN {STRINGS} s USING (key)")
def str_mget(spark, d):
    return strings.mget(kv.kv_strings(spark, d), WANTED)


@query(f"SELECT pos, a.key, coalesce(s.value, '') AS value FROM (VALUES (0::BIGINT, 'customer:7'), (1, 'customer:3'), (2, 'customer:0'), (3, 'customer:7'), (4, 'customer:42')) a(pos, key) LEFT JOIN {STRINGS} s USING (key)")
def str_mget_or_empty(spark, d):
    return strings.mget(kv.kv_strings(spark, d), WANTED, "")


@query(f"SELECT sum(n)::BIGINT AS found FROM (VALUES ('customer:7', 2), ('customer:3', 1), ('customer:0', 1), ('customer:42', 1)) a(key, n) JOIN {STRINGS} s USING (key)")
def str_exists(spark, d):
    return keyspace.exists(kv.kv_strings(spark, d), WANTED)


@query("SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS bytes FROM documents")
def str_strlen(spark, d):
    return kv.table(spark, d, "documents").select("doc_id", strings.strlen(F.col("text")).alias("bytes"))


@query(f"SELECT key, substr(value, 3, 6) AS head, substr(value, greatest(strlen(value) - 4, 0)::BIGINT + 1, 3) AS tail, '' AS none FROM {STRINGS}")
def str_getrange(spark, d):
    v = F.col("value")
    return kv.kv_strings(spark, d).select("key", strings.getrange(v, 2, 8).alias("head"), strings.getrange(v, -4, -1).alias("tail"), strings.getrange(v, 5, 2).alias("none"))


@query("SELECT key, string_agg(value, '' ORDER BY seq) AS value, strlen(string_agg(value, '' ORDER BY seq))::BIGINT AS length FROM (SELECT 'user:' || user_id AS key, event_type AS value, event_id AS seq FROM events) GROUP BY key")
def str_append(spark, d):
    return strings.append(kv.kv_pushes(spark, d).withColumnRenamed("value", "arg"))


@query(f"SELECT key, value, seq FROM {STATE}")
def kv_set_fold(spark, d):
    return folds.last_write(kv.kv_log(spark, d))


@query(f"WITH log AS {LOG} SELECT key, value, seq FROM log l WHERE op = 'set' AND coalesce((SELECT arg_max(op, seq) FROM log b WHERE b.key = l.key AND b.seq < l.seq), 'del') = 'del' AND NOT EXISTS (SELECT 1 FROM log x WHERE x.key = l.key AND x.op = 'del' AND x.seq > l.seq)")
def kv_setnx_fold(spark, d):
    return folds.first_write(kv.kv_log(spark, d))


@query(f"SELECT key, value FROM {STATE} WHERE key NOT IN ('user:1', 'user:2')")
def kv_del_fold(spark, d):
    return keyspace.delete(folds.last_write(kv.kv_log(spark, d)), ["user:1", "user:2"]).select("key", "value")


@query(f"SELECT key, value FROM {STRINGS} WHERE key NOT IN ('customer:1', 'customer:2') UNION ALL SELECT key, upper(value) FROM {STRINGS} WHERE key IN ('customer:1', 'customer:2')")
def kv_mset(spark, d):
    state = kv.kv_strings(spark, d)
    batch = state.where(F.col("key").isin("customer:1", "customer:2")).withColumn("value", F.upper("value"))
    return folds.upsert(state, batch)


@query(f"SELECT CASE key WHEN 'customer:5' THEN 'customer:6' ELSE key END AS key, value FROM {STRINGS} WHERE key <> 'customer:6'")
def kv_rename(spark, d):
    return keyspace.rename(kv.kv_strings(spark, d), "customer:5", "customer:6")


@query(f"SELECT CASE key WHEN 'customer:5' THEN 'fresh' ELSE key END AS key, value FROM {STRINGS}")
def kv_renamenx(spark, d):
    taken = keyspace.renamenx(kv.kv_strings(spark, d), "customer:4", "customer:6")  # there already: nothing changes
    return keyspace.renamenx(taken, "customer:5", "fresh")


@query(f"SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM {LOG} WHERE seq > (SELECT max(event_id) // 2 FROM events) GROUP BY key HAVING arg_max(op, seq) = 'set'")
def kv_flush_epoch(spark, d):
    log = kv.kv_log(spark, d)
    flush = log.agg(F.floor(F.max("seq") / 2).cast("long").alias("seq")).select("seq", F.lit("flush").alias("op"), F.lit("").alias("key"), F.lit("").alias("value"))
    return folds.last_write(folds.since_flush(log.unionByName(flush)))


@query(f"SELECT count(DISTINCT key) AS keys FROM {STATE}")
def kv_dbsize(spark, d):
    return keyspace.dbsize(folds.last_write(kv.kv_log(spark, d)))


@query(f"SELECT key, sum(delta)::BIGINT AS value FROM {INTS} GROUP BY key")
def int_incrby_total(spark, d):
    return numbers.totals(kv.kv_ints(spark, d))


@query(f"SELECT key, seq, delta, (sum(delta) OVER (PARTITION BY key ORDER BY seq ROWS UNBOUNDED PRECEDING))::BIGINT AS value FROM {INTS}")
def int_incrby_running(spark, d):
    return numbers.running(kv.kv_ints(spark, d))


@query(f"SELECT key, (-sum(delta))::BIGINT AS value FROM {INTS} GROUP BY key")
def int_decrby_total(spark, d):
    return numbers.totals(kv.kv_ints(spark, d), -1)


@query("SELECT event_type AS key, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def float_incrby(spark, d):
    return numbers.totals(kv.kv_floats(spark, d)).withColumn("value", F.round("value", 2))


@query("SELECT event_type AS key, round(-sum(value), 2) AS value FROM events GROUP BY ALL")
def float_decrby(spark, d):
    return numbers.totals(kv.kv_floats(spark, d), -1).withColumn("value", F.round("value", 2))


@query("SELECT event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY event_type")
def float_set(spark, d):
    return numbers.setfloat(kv.kv_floats(spark, d).withColumnRenamed("delta", "value"))


@query("SELECT event_id, CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') THEN try_cast(t AS BIGINT) END AS parsed FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || user_id WHEN 1 THEN user_id::VARCHAR ELSE props END AS t FROM events)")
def sds_parse_int(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.col("user_id").cast("string")).otherwise(F.col("props"))
    return kv.table(spark, d, "events").select("event_id", numbers.parse_int(t).alias("parsed"))


@query(f"SELECT key, value, seq FROM (SELECT key, arg_max(value, seq) AS value, max(seq) AS seq, arg_max(op, seq) AS op FROM {LOG} WHERE seq <= 5000 GROUP BY key) WHERE op = 'set'")
def log_replay(spark, d):
    return folds.as_of(kv.kv_log(spark, d), 5000)


@query(f"SELECT seq, 'set' AS op, key, value FROM {STATE}")
def log_compact(spark, d):
    return folds.compacted(kv.kv_log(spark, d))


@query(f"SELECT op, count(*) AS n, count(DISTINCT key) AS keys, max(seq) AS last FROM {LOG} GROUP BY op")
def log_op_counts(spark, d):
    return kv.kv_log(spark, d).groupBy("op").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.max("seq").alias("last"))


@query(f"SELECT seq FROM {LOG} WHERE seq % 1000 = 7")
def log_integrity(spark, d):
    """Writes the log with checksums, damages a few values, finds those records again."""
    path = new_path(spark, "log")
    snapshot.append(kv.kv_log(spark, d), path)
    damaged = spark.read.parquet(path).withColumn("value", F.when(F.col("seq") % 1000 == 7, F.concat("value", F.lit("?"))).otherwise(F.col("value")))
    return snapshot.damaged(damaged).select("seq")


@query(f"SELECT key, value FROM {STATE} WHERE key LIKE 'user:1%'")
def snapshot_filter(spark, d):
    path = new_path(spark, "snapshots")
    state = folds.last_write(kv.kv_log(spark, d)).select("key", "value")
    for at in (1, 2):
        snapshot.save(state, path, at)
    return snapshot.load(spark, path).where(F.col("key").startswith("user:1"))


def _saved(spark, d):
    path = new_path(spark, "snapshots")
    snapshot.save(folds.last_write(kv.kv_log(spark, d)), path, 1)
    return snapshot.load(spark, path)


@query(f"SELECT 1 AS version, count(*) AS rows, 1::BIGINT AS at FROM {STATE}")
def snapshot_header(spark, d):
    path = new_path(spark, "snapshots")
    snapshot.save(folds.last_write(kv.kv_log(spark, d)), path, 1)
    return snapshot.header(spark, path)


@query(f"SELECT key, upper(value) AS value FROM {STATE} WHERE seq % 2 = 0")
def snapshot_transform(spark, d):
    path = new_path(spark, "snapshots")
    snapshot.save(snapshot.transform(_saved(spark, d), F.col("seq") % 2 == 0, F.upper), path, 2)
    return snapshot.load(spark, path).select("key", "value")


@query(f"SELECT count(*) AS rows, sum(strlen(key))::BIGINT AS key_bytes FROM {STATE}")
def snapshot_count(spark, d):
    return snapshot.count(_saved(spark, d))


@query("SELECT 'PONG' AS ping, 'hello' AS echo, count(DISTINCT user_id) AS total_keys FROM events")
def server_info(spark, d):
    return keyspace.dbsize(kv.kv_pushes(spark, d)).select(F.lit("PONG").alias("ping"), F.lit("hello").alias("echo"), F.col("keys").alias("total_keys"))
