"""The register of queries: each a function of (spark, sf_dir), with the SQL that a second engine runs to check it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: Keyspaces in SQL, as the fixtures have them.
LOG = "(SELECT event_id AS seq, CASE WHEN event_type = 'error' THEN 'del' ELSE 'set' END AS op, 'user:' || user_id AS key, props AS value FROM events)"
STRINGS = "(SELECT 'customer:' || c_custkey AS key, c_name AS value FROM customer)"
STATE = f"(SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM {LOG} GROUP BY key HAVING arg_max(op, seq) = 'set')"
INTS = "(SELECT 'user:' || user_id AS key, event_id AS seq, event_id % 11 - 5 AS delta FROM events)"
HASHES = "(SELECT 'user:' || user_id AS key, event_type AS field, arg_max(props, event_id) AS value FROM events GROUP BY ALL)"
PUSHES = "(SELECT 'user:' || user_id AS key, event_type AS value, event_id AS seq FROM events)"
LISTS = f"(SELECT key, list(value ORDER BY seq) AS items FROM {PUSHES} GROUP BY key)"
SETS = "(SELECT DISTINCT event_type AS key, user_id AS member FROM events)"
HIGH = "(SELECT DISTINCT event_type AS key, user_id AS member FROM events WHERE value > 150)"
SCORES = "(SELECT c_mktsegment AS key, o_custkey AS member, round(sum(o_totalprice), 2) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
SHARES = "(SELECT o_orderpriority AS key, o_custkey AS member, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY ALL)"
GEOS = "(SELECT c_mktsegment AS key, c_custkey AS member, (c_custkey * 7919 % 36000) / 100.0::DOUBLE - 180 AS lon, (c_custkey * 104729 % 16000) / 100.0::DOUBLE - 80 AS lat FROM customer)"
STREAMS = "(SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, user_id, value FROM events)"
SAMPLES = "(SELECT 'user:' || user_id AS key, epoch_us(ts) // 1000 AS ms, event_id AS seq, value FROM events)"
MESSAGES = "(SELECT event_type AS channel, props AS payload, 'm-' || event_id AS message_id, epoch_us(ts) // 1000 AS ms, user_id, event_id AS seq FROM events)"


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) * 0.5), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) * 0.5), 2))"
    return f"(6371000.0 * 2.0 * atan2(sqrt({a}), sqrt(1.0 - {a})))"


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add
