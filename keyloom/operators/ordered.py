"""Ordered access to rows by a key column: ranges, ends and iteration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def half_open(rows: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """Rows with low <= column < high; an end that is None is open. Both tests reach the scan."""
    if low is not None:
        rows = rows.where(F.col(column) >= low)
    return rows if high is None else rows.where(F.col(column) < high)


def ends(rows: DataFrame, column: str, by: str | None = None) -> DataFrame:
    """The first and the last row by the column, as structs `first` and `last`, of all rows or for each value of `by`: one aggregate, no sort."""
    whole = F.struct(*rows.columns)
    both = F.min_by(whole, column).alias("first"), F.max_by(whole, column).alias("last")
    return rows.groupBy(by).agg(*both) if by else rows.agg(*both)


def iterate(rows: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    """All rows in order: a range sort, whose files in turn are the iteration."""
    return rows.orderBy(*(F.desc(c) if descending else F.asc(c) for c in columns))
