"""Bitmaps in long form: (key, offset), a row a set bit. Packed bytes, most significant bit first, are an export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Offsets of a block.
BLOCK = 65_536


def bits(rows: DataFrame) -> DataFrame:
    return rows.select("key", "offset").distinct()


def setbit_old(log: DataFrame) -> DataFrame:
    """key, offset, seq, old: the bit that each SETBIT (key, offset, bit, seq) replaces."""
    before = Window.partitionBy("key", "offset").orderBy("seq")
    return log.withColumn("old", F.coalesce(F.lag("bit").over(before), F.lit(0)))


def getbit(rows: DataFrame, offset: int) -> DataFrame:
    return rows.groupBy("key").agg(F.max((F.col("offset") == offset).cast("int")).alias("bit"))


def bitcount(rows: DataFrame, start: int, end: int) -> DataFrame:
    """Set bits in [start, end)."""
    return rows.groupBy("key").agg(F.countDistinct(F.when((F.col("offset") >= start) & (F.col("offset") < end), F.col("offset"))).alias("ones"))


def size_bits(rows: DataFrame) -> DataFrame:
    """Length of each bitmap: whole bytes."""
    return rows.groupBy("key").agg(((F.floor(F.max("offset") / 8) + 1) * 8).cast("long").alias("length"))


def bitop(rows: DataFrame, op: str, keys: list[str]) -> DataFrame:
    """offset: the set bits of AND, OR or XOR over those of the keys that exist; keys that don't are left out."""
    own = bits(rows.where(F.col("key").isin(*keys)))
    per = own.groupBy("offset").agg(F.count("*").alias("n"))
    if op == "OR":
        return per.select("offset")
    if op == "XOR":
        return per.where("n % 2 = 1").select("offset")
    if op != "AND":
        raise ValueError(op)
    there = F.broadcast(own.agg(F.countDistinct("key").alias("all")))
    return per.crossJoin(there).where(F.col("n") == F.col("all")).select("offset")


def bitnot(rows: DataFrame, key: str) -> DataFrame:
    """offset: all clear bits up to the bitmap's length, padding with it."""
    own = bits(rows.where(F.col("key") == key))
    # Offsets are made block by block, and by many tasks.
    blocks = size_bits(own).select("length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / BLOCK))).alias("block")).repartition("block")
    last = F.least(F.lit(BLOCK), F.col("length") - F.col("block") * BLOCK) - 1
    every = blocks.select("block", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).select((F.col("block") * BLOCK + F.col("i")).alias("offset"))
    return every.join(own, "offset", "left_anti")


def bitpos(rows: DataFrame, bit: int, start: int = 0, end: int | None = None) -> DataFrame:
    """key, offset: the first set bit, or the first clear one, in [start, end); null if there is none. Keys have a set bit somewhere.

    Clear bits follow a bitmap's end. A gap is looked for among counts of blocks first, then within one block a key.
    """
    inside = (F.col("offset") >= start) & (F.lit(True) if end is None else F.col("offset") < end)
    if bit:
        return rows.groupBy("key").agg(F.min(F.when(inside, F.col("offset"))).alias("offset"))
    keys = rows.select("key").distinct()
    own = bits(rows.where(inside)).select("key", (F.col("offset") - start).alias("offset")).withColumn("block", F.floor(F.col("offset") / BLOCK))
    place = Window.partitionBy("key").orderBy("block")
    full = own.groupBy("key", "block").agg(F.count("*").alias("n")).withColumn("i", F.row_number().over(place) - 1)
    # The first block that isn't full: one with a gap, one that is missing, or the one after all.
    first = full.groupBy("key").agg(F.coalesce(F.min(F.when((F.col("n") < BLOCK) | (F.col("block") != F.col("i")), F.col("i"))), F.max("i") + 1).cast("long").alias("block"))
    at = Window.partitionBy("key", "block").orderBy("offset")
    n = own.join(first, ["key", "block"]).withColumn("i", F.row_number().over(at) - 1 + F.col("block") * BLOCK)
    gap = n.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("offset") != F.col("i"), F.col("i"))), F.max("i") + 1).alias("gap"))
    found = F.coalesce(F.col("gap"), F.col("block") * BLOCK, F.lit(0)) + start
    out = keys.join(first, "key", "left").join(gap, "key", "left").select("key", found.cast("long").alias("offset"))
    return out if end is None else out.select("key", F.when(F.col("offset") < end, F.col("offset")).alias("offset"))


def packed(rows: DataFrame) -> DataFrame:
    """key, byte, value: each byte with a set bit, bit 0 being its most significant."""
    return bits(rows).groupBy("key", F.floor(F.col("offset") / 8).alias("byte")).agg(F.sum(F.pow(F.lit(2), 7 - F.col("offset") % 8)).cast("int").alias("value"))
