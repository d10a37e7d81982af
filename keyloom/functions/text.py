"""Strings as bytes, typed values, hashes and the clock, as column expressions; hashes that Spark lacks over Arrow batches."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need not have this package
M64 = 0xFFFFFFFFFFFFFFFF


def repeat(text: Column, times: int) -> Column:
    return F.repeat(text, times)


def truncate(text: Column, size: int) -> Column:
    """The first bytes, so many at most."""
    return F.substring(text.cast("binary"), 1, size)


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw)


def lossy(raw: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(raw)


def typed(text: Column) -> Column:
    """What a reply holds: a struct of its kind (nil, integer, float, json, string) and the value in columns i, d, s."""
    i, d = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("bigint")), F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))
    is_json = text.rlike(r"^\s*[\[{]") & F.try_parse_json(text).isNotNull()
    kind = F.when(text.isNull(), "nil").when(i.isNotNull(), "integer").when(d.isNotNull(), "float").when(is_json, "json").otherwise("string")
    return F.struct(kind.alias("kind"), i.alias("i"), F.when(i.isNull(), d).alias("d"), F.when(i.isNull() & d.isNull(), text).alias("s"))


def untyped(value: Column) -> Column:
    """Back to text: integers and strings as they were, floats in their shortest form."""
    return F.coalesce(value["i"].cast("string"), value["d"].cast("string"), value["s"])


def json_value(text: Column, schema: str) -> Column:
    """A JSON text as a typed value; null where it isn't JSON."""
    return F.from_json(text, schema)


def time(micros: Column) -> Column:
    """TIME: seconds and the microseconds within the second of a time in microseconds (now: F.unix_micros(F.current_timestamp()))."""
    return F.struct(F.floor(micros / 1_000_000).cast("long").alias("seconds"), F.pmod(micros, F.lit(1_000_000)).cast("long").alias("micros"))


def _rotl(x: int, r: int) -> int:
    return ((x << r) | (x >> (64 - r))) & M64


def _siphash13(data: bytes, k0: int = 0, k1: int = 0) -> int:
    """SipHash with one round a word and three at the end."""
    v = [k0 ^ 0x736F6D6570736575, k1 ^ 0x646F72616E646F6D, k0 ^ 0x6C7967656E657261, k1 ^ 0x7465646279746573]

    def rounds(n: int) -> None:
        a, b, c, d = v
        for _ in range(n):
            a, c = (a + b) & M64, (c + d) & M64
            b, d = _rotl(b, 13) ^ a, _rotl(d, 16) ^ c
            a, c = (_rotl(a, 32) + d) & M64, (c + b) & M64
            d, b = _rotl(d, 21) ^ a, _rotl(b, 17) ^ c
            c = _rotl(c, 32)
        v[:] = a, b, c, d

    whole = len(data) // 8 * 8
    words = [int.from_bytes(data[i : i + 8], "little") for i in range(0, whole, 8)]
    for m in [*words, int.from_bytes(data[whole:], "little") | (len(data) & 0xFF) << 56]:
        v[3] ^= m
        rounds(1)
        v[0] ^= m
    v[2] ^= 0xFF
    rounds(3)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def _murmur3_128(data: bytes, seed: int = 0) -> int:
    """The low 64 bits of MurmurHash3 x64 128."""
    c1, c2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
    h1 = h2 = seed
    whole = len(data) // 16 * 16
    mix1 = lambda k: _rotl(k * c1 & M64, 31) * c2 & M64
    mix2 = lambda k: _rotl(k * c2 & M64, 33) * c1 & M64
    for i in range(0, whole, 16):
        h1 = ((_rotl(h1 ^ mix1(int.from_bytes(data[i : i + 8], "little")), 27) + h2) * 5 + 0x52DCE729) & M64
        h2 = ((_rotl(h2 ^ mix2(int.from_bytes(data[i + 8 : i + 16], "little")), 31) + h1) * 5 + 0x38495AB5) & M64
    tail = data[whole:]
    if len(tail) > 8:
        h2 ^= mix2(int.from_bytes(tail[8:], "little"))
    if tail:
        h1 ^= mix1(int.from_bytes(tail[:8], "little"))
    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & M64
    h2 = (h2 + h1) & M64

    def final(k: int) -> int:
        k = (k ^ k >> 33) * 0xFF51AFD7ED558CCD & M64
        k = (k ^ k >> 33) * 0xC4CEB9FE1A85EC53 & M64
        return k ^ k >> 33

    h1, h2 = final(h1), final(h2)
    return (h1 + h2) & M64


def _signed(values: list[int]) -> pd.Series:
    return pd.Series(np.array(values, np.uint64).astype(np.int64))


@F.pandas_udf(T.LongType())
def siphash(raw: pd.Series) -> pd.Series:
    """SipHash-1-3 with the zero key, as a signed number; of null as of no bytes."""
    return _signed([_siphash13(x or b"") for x in raw])


@F.pandas_udf(T.LongType())
def murmur3_128(raw: pd.Series) -> pd.Series:
    return _signed([_murmur3_128(x or b"") for x in raw])
