"""Points (key, member, lon, lat): distances, searches and joins by radius.

A radius join cuts the unit sphere's bounding cube into cells as wide as the radius's chord: who is near stands in one of the
27 cells around, at the poles and the antimeridian as anywhere. It is an equi-join on cells and then an exact test.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Mean radius of the Earth and length of a degree in metres; metres of each unit.
RADIUS_M, DEGREE_M = 6_371_000.0, 111_000.0
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.344, "ft": 1 / 3.28084, "nmi": 1852.0}
#: Semi-axes of the WGS84 ellipsoid.
WGS84 = (6_378_137.0, 6_356_752.314245)


def valid(points: DataFrame) -> DataFrame:
    return points.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))


def geoadd(log: DataFrame) -> DataFrame:
    """The last position of each member of (key, member, lon, lat, seq); rows out of range are rejected."""
    last = valid(log).groupBy("key", "member").agg(F.max_by(F.struct("lon", "lat"), "seq").alias("p"))
    return last.select("key", "member", "p.lon", "p.lat")


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = RADIUS_M) -> Column:
    r = F.lit(math.pi / 180.0)
    a = F.pow(F.sin((lat2 - lat1) * r * 0.5), 2) + F.cos(lat1 * r) * F.cos(lat2 * r) * F.pow(F.sin((lon2 - lon1) * r * 0.5), 2)
    return F.lit(radius) * (F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a)))


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    r = F.lit(math.pi / 180.0)
    c = F.sin(lat1 * r) * F.sin(lat2 * r) + F.cos(lat1 * r) * F.cos(lat2 * r) * F.cos((lon2 - lon1) * r)
    return F.lit(RADIUS_M) * F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))


def _planar(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> tuple[Column, Column]:
    shrink = F.cos((lat1 + lat2) * 0.5 * F.lit(math.pi / 180.0))
    return (lon2 - lon1) * DEGREE_M * shrink, (lat2 - lat1) * DEGREE_M


def manhattan(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    x, y = _planar(lon1, lat1, lon2, lat2)
    return F.abs(x) + F.abs(y)


def euclidean(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    x, y = _planar(lon1, lat1, lon2, lat2)
    return F.sqrt(x * x + y * y)


def from_metres(metres: Column, unit: str = "m") -> Column:
    return metres / UNITS.get(unit, 1.0)


def max_error(method: str, metres: Column) -> Column:
    """A bound of a method's error in metres (fixed values)."""
    if method == "vincenty":
        return F.lit(0.0005)
    if method == "euclidean":
        return F.pow(metres / 1000.0, 2) * 100.0
    return metres * (0.3 if method == "manhattan" else 0.005)


def recommended(metres: Column, accuracy: Column) -> Column:
    """The cheapest method that is accurate enough."""
    short = (metres < 100) & (accuracy > 10)
    return F.when(accuracy < 0.001, "vincenty").when(short, "euclidean").when(accuracy > metres * 0.1, "manhattan").otherwise("haversine")


def geopos(points: DataFrame, asked: DataFrame) -> DataFrame:
    """key, member, lon, lat of each (key, member) asked; null where there is none."""
    return asked.join(points, ["key", "member"], "left").select("key", "member", "lon", "lat")


def geodist(points: DataFrame, a: object, b: object, unit: str = "m") -> DataFrame:
    """key, dist of two members in each key that has both."""
    p = points.where(F.col("member") == a).select("key", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    q = points.where(F.col("member") == b).select("key", "lon", "lat")
    return p.join(q, "key").select("key", from_metres(haversine(*map(F.col, ("lon1", "lat1", "lon", "lat"))), unit).alias("dist"))


def box(lon: float, lat: float, metres: float) -> tuple[float, float, float, float]:
    """West, south, east, north of all points within the radius; all longitudes where it reaches a pole or the antimeridian."""
    dlat = math.degrees(metres / RADIUS_M) * 1.000001
    south, north = lat - dlat, lat + dlat
    if south <= -90 or north >= 90:
        return -180.0, max(south, -90.0), 180.0, min(north, 90.0)
    dlon = math.degrees(math.asin(min(1.0, math.sin(metres / RADIUS_M) / math.cos(math.radians(lat))))) * 1.000001
    west, east = lon - dlon, lon + dlon
    return (-180.0, south, 180.0, north) if west < -180 or east > 180 else (west, south, east, north)


def bbox(points: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    return points.where(F.col("lon").between(west, east) & F.col("lat").between(south, north))


def georadius(points: DataFrame, lon: float, lat: float, radius: float, unit: str = "m") -> DataFrame:
    """Points within the radius, with their dist: a box that reaches the scan, then the exact test."""
    near = bbox(points, *box(lon, lat, radius * UNITS.get(unit, 1.0)))
    near = near.withColumn("dist", from_metres(haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")), unit))
    return near.where(F.col("dist") <= radius)


def geosearch(points: DataFrame, lon: float, lat: float, radius: float, unit: str = "m", count: int | None = None) -> DataFrame:
    near = georadius(points, lon, lat, radius, unit)
    return near if count is None else near.orderBy("dist", "key", "member").limit(count)


def bucket_stats(points: DataFrame, precision: int) -> DataFrame:
    """buckets, members, mean and most members of the geohash cells that have some."""
    from keyloom.functions import geohash

    per = points.groupBy(geohash.encode(F.col("lon"), F.col("lat"), precision).alias("cell")).agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("buckets"), F.sum("n").alias("members"), F.avg("n").alias("mean"), F.max("n").alias("most"))


METHODS = {"haversine": haversine, "great_circle": great_circle, "manhattan": manhattan, "euclidean": euclidean}


def knn(points: DataFrame, lon: float, lat: float, k: int) -> DataFrame:
    """The k nearest members of each key, with dist and place; ties by member."""
    return _nearest(points, haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")), k)


def _nearest(points: DataFrame, dist: Column, k: int) -> DataFrame:
    out = points.withColumn("dist", dist)
    order = Window.partitionBy("key").orderBy("dist", "member")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def knn_by_method(points: DataFrame, lon: float, lat: float, k: int, method: str) -> DataFrame:
    """The 2 k nearest members of each key on the sphere, and of them the k nearest by the method."""
    near = knn(points, lon, lat, 2 * k).drop("dist", "place")
    return _nearest(near, METHODS[method](F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")), k)


def knn_by_member(points: DataFrame, member: object, k: int) -> DataFrame:
    """The k members nearest to one, in each key that has it; the member itself isn't among them."""
    centre = points.where(F.col("member") == member).select("key", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    others = points.where(F.col("member") != member).join(centre, "key")
    return _nearest(others, haversine(*map(F.col, ("lon1", "lat1", "lon", "lat"))), k).drop("lon1", "lat1")


def geosearch_from_member(points: DataFrame, member: object, radius: float, unit: str = "m", with_dist: bool = False, with_coord: bool = False) -> DataFrame:
    """GEOSEARCH around a member of each key that has it: key, member, and dist or lon and lat if asked for."""
    near = by_member(points, member, radius, unit)
    near = near.join(points.select("key", "member", "lon", "lat"), ["key", "member"]) if with_coord else near
    return near.select("key", "member", *["dist"] * with_dist, *["lon", "lat"] * with_coord)


def _cells(edge: float) -> list[Column]:
    r = F.lit(math.pi / 180.0)
    flat = F.cos(F.col("lat") * r)
    return [F.floor(v / edge).cast("int") for v in (flat * F.cos(F.col("lon") * r), flat * F.sin(F.col("lon") * r), F.sin(F.col("lat") * r))]


def radius_join(centres: DataFrame, points: DataFrame, radius: float, unit: str = "m") -> DataFrame:
    """key, centre, member, dist of all points of a key within the radius of its centres (key, member, lon, lat)."""
    metres = radius * UNITS.get(unit, 1.0)
    edge = max(2 * math.sin(min(metres / RADIUS_M, math.pi) / 2), 1e-9) * 1.000001
    x, y, z = _cells(edge)
    around = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a, b, c in product((-1, 0, 1), repeat=3)))
    c = centres.select("key", F.col("member").alias("centre"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), x.alias("x"), y.alias("y"), z.alias("z"), F.explode(around).alias("o"))
    c = c.select("key", "centre", "lon1", "lat1", (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y"), (F.col("z") + F.col("o.c")).alias("z"))
    p = points.select("key", "member", "lon", "lat", x.alias("x"), y.alias("y"), z.alias("z"))
    dist = from_metres(haversine(*map(F.col, ("lon1", "lat1", "lon", "lat"))), unit)
    return c.join(p, ["key", "x", "y", "z"]).withColumn("dist", dist).where(F.col("dist") <= radius).select("key", "centre", "member", "dist")


def by_member(points: DataFrame, member: object, radius: float, unit: str = "m") -> DataFrame:
    """GEORADIUSBYMEMBER in each key that has the member; the centre itself belongs to it."""
    centre = points.where(F.col("member") == member).select("key", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    dist = from_metres(haversine(*map(F.col, ("lon1", "lat1", "lon", "lat"))), unit)
    return points.join(centre, "key").withColumn("dist", dist).where(F.col("dist") <= radius).select("key", "member", "dist")
