"""HyperLogLog sketches: built in partial aggregates, merged, estimated; 2^14 registers unless told otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRECISION = 14


def pfadd(rows: DataFrame, precision: int = PRECISION) -> DataFrame:
    """key, sketch of (key, elem)."""
    return rows.groupBy("key").agg(F.hll_sketch_agg("elem", F.lit(precision)).alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("estimate"))


def pfmerge(sketches: DataFrame, *by: str) -> DataFrame:
    """One sketch of each group `by`, or of all."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
