"""Points, distances, searches and geohashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom import fixtures as kv
from keyloom.functions import geohash, registry
from keyloom.operators import geo

from .base import GEOS, haversine_sql, query

HERE = (0.0, 0.0)
FROM_HERE = haversine_sql("0.0", "0.0", "lon", "lat")
PAIR = ("p.lon", "p.lat", "q.lon", "q.lat")
#: Each point with the one of the next customer number but 36, whatever its key.
PAIRS = f"{GEOS} p JOIN {GEOS} q ON q.member = p.member + 37"


def _pairs(spark, d):
    g = kv.kv_geos(spark, d)
    p = g.select("member", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    return p.join(g.select((F.col("member") - 37).alias("member"), "lon", "lat"), "member")


def _four():
    return [F.col(c) for c in ("lon1", "lat1", "lon", "lat")]


def _rounded(df, digits=3):
    return df.withColumn("dist", F.round("dist", digits))


@query(f"SELECT a.key, a.member, g.lon, g.lat FROM (VALUES ('BUILDING', 1::BIGINT), ('BUILDING', 2), ('AUTOMOBILE', 3), ('BUILDING', -5)) a(key, member) LEFT JOIN {GEOS} g USING (key, member)")
def geo_pos(spark, d):
    asked = spark.createDataFrame([("BUILDING", 1), ("BUILDING", 2), ("AUTOMOBILE", 3), ("BUILDING", -5)], "key string, member long")
    return geo.geopos(kv.kv_geos(spark, d), asked)


@query(f"SELECT p.key, round({haversine_sql(*PAIR)} / 1000, 3) AS dist FROM (SELECT key, arg_min(lon, member) AS lon, arg_min(lat, member) AS lat FROM {GEOS} GROUP BY key) p, (SELECT lon, lat FROM {GEOS} WHERE member = 9) q")
def geo_dist(spark, d):
    g = kv.kv_geos(spark, d)
    first = g.groupBy("key").agg(F.min_by("lon", "member").alias("lon"), F.min_by("lat", "member").alias("lat")).withColumn("member", F.lit(-1))
    nine = first.select("key").crossJoin(g.where("member = 9").select("lon", "lat")).withColumn("member", F.lit(9))
    return _rounded(geo.geodist(first.unionByName(nine.select("key", "lon", "lat", "member")), -1, 9, "km"))


@query(f"SELECT key, member, lon, lat, round({FROM_HERE} / 1000, 3) AS dist FROM {GEOS} WHERE {FROM_HERE} <= 500000")
def geo_radius(spark, d):
    return _rounded(geo.georadius(kv.kv_geos(spark, d), *HERE, 500, "km"))


@query(f"SELECT g.key, g.member, round({haversine_sql('c.lon', 'c.lat', 'g.lon', 'g.lat')} / 1609.344, 3) AS dist FROM {GEOS} g JOIN {GEOS} c ON c.key = g.key AND c.member = 11 WHERE {haversine_sql('c.lon', 'c.lat', 'g.lon', 'g.lat')} <= 1000 * 1609.344")
def geo_radius_by_member(spark, d):
    return _rounded(geo.by_member(kv.kv_geos(spark, d), 11, 1000, "mi"))


@query(f"SELECT key, member, lon, lat, round({FROM_HERE} / 1000, 3) AS dist FROM {GEOS} WHERE {FROM_HERE} <= 2000000 ORDER BY {FROM_HERE}, key, member LIMIT 10")
def geo_search_count(spark, d):
    return _rounded(geo.geosearch(kv.kv_geos(spark, d), *HERE, 2000, "km", 10))


@query(f"SELECT key, member, lon, lat FROM {GEOS} WHERE lon BETWEEN -20 AND 30 AND lat BETWEEN 10 AND 45")
def geo_bbox(spark, d):
    return geo.bbox(kv.kv_geos(spark, d), -20, 10, 30, 45)


@query(f"SELECT key, member, lon, lat, round(dist, 3) AS dist, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, member)::INT AS place FROM (SELECT *, {FROM_HERE} AS dist FROM {GEOS})) WHERE place <= 5")
def geo_knn(spark, d):
    return _rounded(geo.knn(kv.kv_geos(spark, d), *HERE, 5))


@query(f"SELECT c.key, c.member AS centre, g.member, round({haversine_sql('c.lon', 'c.lat', 'g.lon', 'g.lat')} / 1000, 3) AS dist FROM {GEOS} c JOIN {GEOS} g USING (key) WHERE {haversine_sql('c.lon', 'c.lat', 'g.lon', 'g.lat')} <= 300000")
def geo_radius_join(spark, d):
    g = kv.kv_geos(spark, d)
    return _rounded(geo.radius_join(g, g, 300, "km"))


_GREAT = "6371000.0 * acos(greatest(least(sin(radians(p.lat)) * sin(radians(q.lat)) + cos(radians(p.lat)) * cos(radians(q.lat)) * cos(radians(q.lon - p.lon)), 1.0), -1.0))"
_DX, _DY = "((q.lon - p.lon) * 111000.0 * cos(radians((p.lat + q.lat) * 0.5)))", "((q.lat - p.lat) * 111000.0)"


@query(f"SELECT p.member, round({haversine_sql(*PAIR)}, 1) AS haversine, round({_GREAT}, 1) AS great_circle, round(abs({_DX}) + abs({_DY}), 1) AS manhattan, round(sqrt({_DX} * {_DX} + {_DY} * {_DY}), 1) AS euclidean FROM {PAIRS}")
def geo_dist_methods(spark, d):
    f = {"haversine": geo.haversine, "great_circle": geo.great_circle, "manhattan": geo.manhattan, "euclidean": geo.euclidean}
    return _pairs(spark, d).select("member", *(F.round(g(*_four()), 1).alias(k) for k, g in f.items()))


#: Pairs of points and their distances in metres on WGS84: a published survey line, arcs of the equator, a quarter of a meridian.
KNOWN = [("Flinders Peak - Buninyong", 144.42486788888888, -37.95103341666667, 143.92649552777777, -37.65282113888889, 54972.271), ("one degree of the equator", 0.0, 0.0, 1.0, 0.0, 111319.491), ("a quarter of the equator", 0.0, 0.0, 90.0, 0.0, 10018754.171), ("equator to pole", 0.0, 0.0, 0.0, 90.0, 10001965.729), ("one point", 10.0, 50.0, 10.0, 50.0, 0.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{name}', {metres}::DOUBLE)" for name, *_, metres in KNOWN) + ") t(pair, metres)")
def geo_dist_vincenty(spark, d):
    rows = spark.createDataFrame([r[:5] for r in KNOWN], "pair string, lon1 double, lat1 double, lon double, lat double")
    return rows.select("pair", F.round(registry.vincenty(*_four()), 3).alias("metres"))


@query(f"SELECT p.member, round(m, 3) AS m, round(m / 1000, 6) AS km, round(m / 1609.344, 6) AS mi, round(m * 3.28084, 2) AS ft, round(m / 1852, 6) AS nmi FROM (SELECT p.member, {haversine_sql(*PAIR)} AS m FROM {PAIRS}) p")
def geo_units(spark, d):
    m = geo.haversine(*_four())
    digits = {"m": 3, "km": 6, "mi": 6, "ft": 2, "nmi": 6}
    return _pairs(spark, d).select("member", *(F.round(geo.from_metres(m, u), n).alias(u) for u, n in digits.items()))


@query(f"SELECT p.member, CASE WHEN a < 0.001 THEN 'vincenty' WHEN m < 100 AND a > 10 THEN 'euclidean' WHEN a > m * 0.1 THEN 'manhattan' ELSE 'haversine' END AS method, round(m * 0.005, 1) AS error_m FROM (SELECT p.member, {haversine_sql(*PAIR)} AS m, CASE p.member % 3 WHEN 0 THEN 0.0001 WHEN 1 THEN 50.0 ELSE 3000000.0 END AS a FROM {PAIRS}) p")
def geo_recommend(spark, d):
    m = geo.haversine(*_four())
    a = F.when(F.col("member") % 3 == 0, 0.0001).when(F.col("member") % 3 == 1, 50.0).otherwise(3_000_000.0)
    return _pairs(spark, d).select("member", geo.recommended(m, a).alias("method"), F.round(geo.max_error("haversine", m), 1).alias("error_m"))


def _cells_sql(precision: int, lon: str = "lon", lat: str = "lat") -> tuple[str, str]:
    nx, ny = -(-5 * precision // 2), 5 * precision // 2
    return tuple(f"greatest(least(floor(({v} + {low}) / {w}::DOUBLE * {2**n}::DOUBLE)::BIGINT, {2**n - 1}), 0)" for v, low, w, n in ((lon, 180.0, 360.0, nx), (lat, 90.0, 180.0, ny)))


def _hash_sql(x: str, y: str, precision: int) -> str:
    nx, ny = -(-5 * precision // 2), 5 * precision // 2
    bit = lambda i: f"(({x}) >> {nx - 1 - i // 2}) & 1" if i % 2 == 0 else f"(({y}) >> {ny - 1 - i // 2}) & 1"
    return " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', (" + " + ".join(f"({bit(5 * c + j)}) * {16 >> j}" for j in range(5)) + ")::INT + 1, 1)" for c in range(precision))


X7, Y7 = _cells_sql(7)
CELLS7 = f"(SELECT key, member, lon, lat, {X7} AS x, {Y7} AS y FROM {GEOS})"


@query(f"SELECT member, {_hash_sql('x', 'y', 7)} AS geohash FROM {CELLS7}")
def geohash_encode(spark, d):
    return kv.kv_geos(spark, d).select("member", geohash.encode(F.col("lon"), F.col("lat")).alias("geohash"))


@query(f"SELECT member, round(x * 360.0 / {2**18} - 180, 9) AS west, round(y * 180.0 / {2**17} - 90, 9) AS south, true AS inside FROM {CELLS7}")
def geohash_decode(spark, d):
    g = kv.kv_geos(spark, d).withColumn("b", geohash.bounds(geohash.encode(F.col("lon"), F.col("lat")), 7))
    inside = F.col("lon").between(F.col("b.west"), F.col("b.east")) & F.col("lat").between(F.col("b.south"), F.col("b.north"))
    return g.select("member", F.round("b.west", 9).alias("west"), F.round("b.south", 9).alias("south"), inside.alias("inside"))


_E, _W, _AROUND = "(x + 1) % 262144", "(x + 262143) % 262144", {}
for _name, _x in (("", "x"), ("e", _E), ("w", _W)):
    _AROUND |= {f"n{_name}": (_x, "y + 1"), f"s{_name}": (_x, "y - 1")} | ({_name: (_x, "y")} if _name else {})


@query("SELECT member, " + ", ".join(f"{_hash_sql(x, y, 7)} AS {name}" for name, (x, y) in _AROUND.items()) + f" FROM {CELLS7}")
def geohash_neighbors(spark, d):
    g = kv.kv_geos(spark, d).select("member", geohash.neighbours(F.col("lon"), F.col("lat")).alias("a"))
    return g.select("member", "a.*")


@query(f"SELECT DISTINCT {_hash_sql(*_cells_sql(3), 3)} AS parent, {_hash_sql(*_cells_sql(3), 3)} || c AS child FROM {GEOS}, (SELECT unnest(string_split('0123456789bcdefghjkmnpqrstuvwxyz', '')) AS c)")
def geohash_children(spark, d):
    g = kv.kv_geos(spark, d).select(geohash.parent(geohash.encode(F.col("lon"), F.col("lat"), 4)).alias("parent")).distinct()
    return g.select("parent", F.explode(geohash.children(F.col("parent"))).alias("child"))


def _spread_sql(v: str) -> str:
    return "(" + " + ".join(f"((({v} >> {i}) & 1) << {2 * i})" for i in range(26)) + ")"


_S26 = [f"greatest(least(floor(({v} + {low}) / {w}::DOUBLE * {2**26}::DOUBLE)::BIGINT, {2**26 - 1}), 0)" for v, low, w in (("lon", 180.0, 360.0), ("lat", 90.0, 180.0))]


@query(f"SELECT member, ({_spread_sql('x')} << 1) | {_spread_sql('y')} AS score FROM (SELECT member, {_S26[0]} AS x, {_S26[1]} AS y FROM {GEOS})")
def geohash_score52(spark, d):
    return kv.kv_geos(spark, d).select("member", geohash.score(F.col("lon"), F.col("lat")).alias("score"))


@query(f"SELECT count(*) AS buckets, sum(n)::BIGINT AS members, round(avg(n), 6) AS mean, max(n) AS most FROM (SELECT count(*) AS n FROM {GEOS} GROUP BY {_hash_sql(*_cells_sql(3), 3)})")
def geo_bucket_stats(spark, d):
    return geo.bucket_stats(kv.kv_geos(spark, d), 3).withColumn("mean", F.round("mean", 6))


@query(f"SELECT member, round(x * 360.0 / 67108864 - 180 + 180.0 / 67108864, 9) AS lon, round(y * 180.0 / 67108864 - 90 + 90.0 / 67108864, 9) AS lat FROM (SELECT member, {_S26[0]} AS x, {_S26[1]} AS y FROM {GEOS})")
def geohash_unscore52(spark, d):
    g = kv.kv_geos(spark, d).select("member", geohash.unscore(geohash.score(F.col("lon"), F.col("lat"))).alias("p"))
    return g.select("member", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


@query(f"SELECT key, member, lon, lat FROM (SELECT key, member, CASE WHEN member % 3 = 0 THEN lat ELSE lon END AS lon, lat FROM {GEOS} WHERE member % 5 <> 0 UNION ALL SELECT key, member, lon, lat FROM {GEOS} WHERE member % 5 = 0)")
def geo_geoadd(spark, d):
    """Members are added, every third one again elsewhere; every fifth one's second position is out of range and rejected."""
    g = kv.kv_geos(spark, d)
    again = g.where("member % 3 = 0").withColumn("lon", F.when(F.col("member") % 5 == 0, 500.0).otherwise(F.col("lat")))
    return geo.geoadd(g.withColumn("seq", F.lit(1)).unionByName(again.withColumn("seq", F.lit(2))))


_CENTRE = f"{GEOS} g JOIN {GEOS} c ON c.key = g.key AND c.member = 11"
_APART = haversine_sql("c.lon", "c.lat", "g.lon", "g.lat")


@query(f"SELECT key, member, round(dist, 3) AS dist, place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist, member)::INT AS place FROM (SELECT g.key, g.member, {_APART} AS dist FROM {_CENTRE} WHERE g.member <> 11)) WHERE place <= 4")
def geo_knn_by_member(spark, d):
    return _rounded(geo.knn_by_member(kv.kv_geos(spark, d), 11, 4)).select("key", "member", "dist", "place")


_FLAT = "abs((lon - 0.0) * 111000.0 * cos(radians(lat * 0.5))) + abs(lat * 111000.0)"


@query(f"SELECT key, member, round(dist, 3) AS dist, place FROM (SELECT key, member, {_FLAT} AS dist, row_number() OVER (PARTITION BY key ORDER BY {_FLAT}, member)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {FROM_HERE}, member) AS n FROM {GEOS}) WHERE n <= 10) WHERE place <= 5")
def geo_knn_by_method(spark, d):
    return _rounded(geo.knn_by_method(kv.kv_geos(spark, d), *HERE, 5, "manhattan")).select("key", "member", "dist", "place")


@query(f"SELECT g.key, g.member, round({_APART} / 1000, 3) AS dist, g.lon, g.lat FROM {_CENTRE} WHERE {_APART} <= 2000000")
def geo_search_from_member(spark, d):
    return _rounded(geo.geosearch_from_member(kv.kv_geos(spark, d), 11, 2000, "km", True, True))
