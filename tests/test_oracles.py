"""Every query of the catalogue that SQL can express, against DuckDB; the others by their rows."""

import math

import duckdb
import pytest

from keyloom import catalogue

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(v):
    return (round(v, 6) + 0.0 if math.isfinite(v) else str(v)) if isinstance(v, float) else v


def ordered(rows):
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in names) for r in df.collect())
    if name not in catalogue.ORACLES:
        assert got
        return
    out = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in out.description]
    assert sorted(columns) == names
    assert got == ordered(tuple(plain(r[columns.index(c)]) for c in names) for r in out.fetchall())
