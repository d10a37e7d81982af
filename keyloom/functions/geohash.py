"""Geohashes and 52-bit scores as column expressions: interleaved bits of scaled longitude and latitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The geohash alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Shifts and masks that spread 32 bits over every second bit.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def cell(x: Column, low: float, width: float, bits: int) -> Column:
    """Number of the cell, of 2^bits, in which x stands; the upper end belongs to the last."""
    n = F.floor((x - low) / F.lit(float(width)) * F.lit(float(2**bits))).cast("long")
    return F.least(F.greatest(n, F.lit(0).cast("long")), F.lit(2**bits - 1).cast("long"))


def bits_of(precision: int) -> tuple[int, int]:
    """Bits of longitude and of latitude: longitude has the first, hence the odd one."""
    return (5 * precision + 1) // 2, 5 * precision // 2


def from_cells(x: Column, y: Column, precision: int) -> Column:
    nx, ny = bits_of(precision)

    def bit(i: int) -> Column:
        k = i // 2
        return F.shiftright(x, nx - 1 - k).bitwiseAND(1) if i % 2 == 0 else F.shiftright(y, ny - 1 - k).bitwiseAND(1)

    chars = []
    for c in range(precision):
        code = sum((bit(5 * c + j) * (16 >> j) for j in range(1, 5)), bit(5 * c) * 16)
        chars.append(F.substring(F.lit(ALPHABET), code.cast("int") + 1, F.lit(1)))
    return F.concat(*chars)


def encode(lon: Column, lat: Column, precision: int = 7) -> Column:
    nx, ny = bits_of(precision)
    return from_cells(cell(lon, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny), precision)


def neighbours(lon: Column, lat: Column, precision: int = 7) -> Column:
    """The eight cells around a point's: a struct of n, ne, e, se, s, sw, w, nw; null beyond a pole, around the world by longitude."""
    nx, ny = bits_of(precision)
    x, y = cell(lon, -180.0, 360.0, nx), cell(lat, -90.0, 180.0, ny)
    steps = {"n": (0, 1), "ne": (1, 1), "e": (1, 0), "se": (1, -1), "s": (0, -1), "sw": (-1, -1), "w": (-1, 0), "nw": (-1, 1)}
    out = []
    for name, (dx, dy) in steps.items():
        there = (y + dy).between(0, 2**ny - 1)
        out.append(F.when(there, from_cells(F.pmod(x + dx, F.lit(2**nx)), y + dy, precision)).alias(name))
    return F.struct(*out)


def bounds(geohash: Column, precision: int) -> Column:
    """West, south, east, north of a geohash of a known length."""
    nx, ny = bits_of(precision)
    x = y = F.lit(0).cast("long")
    for i in range(5 * precision):
        code = F.instr(F.lit(ALPHABET), F.substring(geohash, i // 5 + 1, 1)) - 1
        b = F.shiftright(code, 4 - i % 5).bitwiseAND(1).cast("long")
        if i % 2 == 0:
            x = x * 2 + b
        else:
            y = y * 2 + b
    w, h = 360.0 / 2**nx, 180.0 / 2**ny
    return F.struct((x * F.lit(w) - 180.0).alias("west"), (y * F.lit(h) - 90.0).alias("south"), ((x + 1) * F.lit(w) - 180.0).alias("east"), ((y + 1) * F.lit(h) - 90.0).alias("north"))


def parent(geohash: Column) -> Column:
    return F.left(geohash, F.length(geohash) - 1)


def children(geohash: Column) -> Column:
    """Its 32 cells, in order."""
    return F.transform(F.split(F.lit(ALPHABET), ""), lambda c: F.concat(geohash, c))


def unscore(score_: Column) -> Column:
    """lon, lat: the centre of a 52-bit score's cell."""

    def gather(v: Column) -> Column:
        v = v.bitwiseAND(F.lit(SPREAD[-1][1]))
        for (shift, _), (_, mask) in zip(reversed(SPREAD), [*list(reversed(SPREAD))[1:], (0, 0x00000000FFFFFFFF)], strict=True):
            v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask))
        return v

    x, y = gather(F.shiftright(score_, 1)), gather(score_)
    return F.struct(((x + 0.5) * F.lit(360.0 / 2**26) - 180.0).alias("lon"), ((y + 0.5) * F.lit(180.0 / 2**26) - 90.0).alias("lat"))


def score(lon: Column, lat: Column) -> Column:
    """52 bits: 26 of longitude and 26 of latitude, longitude first."""

    def spread(v: Column) -> Column:
        for shift, mask in SPREAD:
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(cell(lon, -180.0, 360.0, 26)), 1).bitwiseOR(spread(cell(lat, -90.0, 180.0, 26)))
