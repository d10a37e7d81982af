"""Pieces that several of the text operators share: shared storage, code shipping, word ids."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are worked on at once, and that an Arrow batch holds. Whole texts are wide, so that is few.
BATCH_ROWS, BATCH_SETTING = 512, "spark.sql.execution.arrow.maxRecordsPerBatch"
_SHIPPED: weakref.WeakSet = weakref.WeakSet()
_TO_DELETE: weakref.WeakSet = weakref.WeakSet()
#: Paths of tables written within the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per SparkContext, and have Spark make short Arrow batches.

    The latter is a setting of the session, since Spark has none for a single plan: it is made only where the user has left it at Spark's
    own default. Batches of the default's length take some 300 MB more of an executor here.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == "10000" and not sc.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))
    if sc in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(), "keyloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(d, n), os.path.relpath(os.path.join(d, n), os.path.dirname(top)))
    sc.addPyFile(path)
    _SHIPPED.add(sc)


def _delete(spark: SparkSession, path: str, at_end: bool = False) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(p) if at_end else fs.delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the one that all executors share (spark.checkpoint.dir); deleted when the driver ends.

    Where that is unset, a temporary folder serves in local mode; on a cluster, whose executors would not see each other's, it is
    an error.
    """
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not set_to:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        set_to = os.path.join(tempfile.gettempdir(), "checkpoints", "keyloom")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(set_to)
    path = f"{set_to.rstrip('/')}/keyloom-{sc.applicationId}"
    if sc not in _TO_DELETE:
        _delete(spark, path, at_end=True)
        _TO_DELETE.add(sc)
    return path


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later plans start at those files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table that cut() returned as `df`, if it did."""
    if path := _PATHS.pop(df, None):
        _delete(df.sparkSession, path)


class scope:
    """Tables that cut() writes within are deleted when it is left; keep() writes one that stays."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scope:
        self.own: list[str] = []
        _SCOPES.append(self.own)
        return self

    def keep(self, df: DataFrame, what: str) -> DataFrame:
        _SCOPES.pop()
        try:
            return cut(df, what)
        finally:
            _SCOPES.append(self.own)

    def __exit__(self, *_) -> None:
        _SCOPES.pop()
        for path in self.own:
            _delete(self.spark, path)


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with batches of BATCH_ROWS rows at most."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, len(b), BATCH_ROWS))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def documents(df: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one."""
    return df.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are for testing only; a null id counts as the text ''."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5) == 0


class WordIds(dict):
    """64-bit ids of words, remembered for the words met last."""

    def __init__(self, most: int = 80_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = xxhash.xxh64_intdigest(word)
        return x

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def windows(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k ids in a row; empty when there are fewer."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = ids[:n].copy()
    for j in range(1, k):
        h = mixed(h + np.uint64(0x9E3779B97F4A7C15)) + ids[j : j + n]
    return mixed(h)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)
