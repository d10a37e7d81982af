"""Functions that built-ins can't express, and a registry to call functions by name from SQL.

Vincenty's distance iterates, CRC16 walks bytes: both are vectorised over Arrow batches.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.operators.geo import WGS84, haversine

SLOTS = 16_384
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package


def _vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """The inverse problem on WGS84 for arrays; NaN where 100 rounds don't converge."""
    major, minor = WGS84
    flat = (major - minor) / major
    east = np.radians(lon2 - lon1)
    r1, r2 = np.arctan((1 - flat) * np.tan(np.radians(lat1))), np.arctan((1 - flat) * np.tan(np.radians(lat2)))
    s1, c1, s2, c2 = np.sin(r1), np.cos(r1), np.sin(r2), np.cos(r2)
    lam, done = east.copy(), np.zeros(len(east), bool)
    with np.errstate(all="ignore"):
        for _ in range(100):
            sl, cl = np.sin(lam), np.cos(lam)
            ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cs = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0.0, c1 * c2 * sl / np.where(ss == 0, 1.0, ss))
            ca = 1 - sa * sa
            mid = np.where(ca > 1e-15, cs - 2 * s1 * s2 / np.where(ca > 1e-15, ca, 1.0), 0.0)
            k = flat / 16 * ca * (4 + flat * (4 - 3 * ca))
            new = east + (1 - k) * flat * sa * (sigma + k * ss * (mid + k * cs * (2 * mid * mid - 1)))
            done |= np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        u = ca * (major**2 - minor**2) / minor**2
        big = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
        small = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        shift = small * ss * (mid + small / 4 * (cs * (2 * mid * mid - 1) - small / 6 * mid * (4 * ss * ss - 3) * (4 * mid * mid - 3)))
        out = minor * big * (sigma - shift)
    return np.where(ss == 0, 0.0, np.where(done, out, np.nan))


@F.pandas_udf(T.DoubleType())
def _vincenty_udf(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(_vincenty(*(x.to_numpy(float) for x in (lon1, lat1, lon2, lat2))))


def vincenty(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the ellipsoid; the haversine distance where Vincenty's doesn't converge."""
    return F.coalesce(F.nanvl(_vincenty_udf(lon1, lat1, lon2, lat2), F.lit(None).cast("double")), haversine(lon1, lat1, lon2, lat2))


def _crc_table() -> np.ndarray:
    """CRC-16 with the polynomial 0x1021, most significant bit first."""
    t = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        t = np.where(t & 0x8000, (t << 1) ^ 0x1021, t << 1) & 0xFFFF
    return t


@F.pandas_udf(T.IntegerType())
def _crc16(raw: pd.Series) -> pd.Series:
    table = _crc_table()
    lists = [np.frombuffer(x or b"", np.uint8) for x in raw]
    n = np.array([len(x) for x in lists])
    crc = np.zeros(len(lists), np.uint32)
    order = np.argsort(-n, kind="stable")
    for k in range(n.max(initial=0)):  # one step for all keys that are that long
        at = order[: int((n > k).sum())]
        byte = np.array([lists[i][k] for i in at], np.uint32)
        crc[at] = ((crc[at] << 8) & 0xFFFF) ^ table[((crc[at] >> 8) ^ byte) & 0xFF]
    return pd.Series(crc.astype(np.int32))


def slot(key: Column) -> Column:
    """The hash slot of a key, 0 to 16383: CRC16 of its tag."""
    from keyloom.operators.keyspace import in_slot_of

    return _crc16(in_slot_of(key).cast("binary")) % SLOTS


class Registry:
    """Named functions for F.call_function and SQL: Python or pandas UDFs, and table functions."""

    def __init__(self, spark: SparkSession):
        self.spark, self.names = spark, set()

    def add(self, name: str, f: Callable, returns: str | None = None) -> None:
        self.spark.udf.register(name, f, returns) if returns else self.spark.udf.register(name, f)
        self.names.add(name)

    def add_table(self, name: str, f: object) -> None:
        self.spark.udtf.register(name, f)
        self.names.add(name)

    def call(self, name: str, *args: Column) -> Column:
        if name not in self.names:
            raise KeyError(name)
        return F.call_function(name, *args)


@F.udtf(returnType=T.StructType([T.StructField("geohash", T.StringType())]))
class GeohashChildren:
    """The 32 cells within a geohash, as a table function."""

    def eval(self, geohash: str):
        for c in "0123456789bcdefghjkmnpqrstuvwxyz":
            yield (geohash + c,)
