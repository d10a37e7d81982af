"""A corpus of training text from `documents`: five stages, each written as Parquet and read again by the next.

toxicity drops documents that score as toxic; near-dedup keeps one document of each group; secret scans replace found
secrets in texts; mixing repeats and drops documents by their sources' target weights and puts them in training order;
BPE returns each document's token ids with its place in training order, and sorted by that. A stage's table is deleted once the next
one is written.

Defined cases: null text is empty: it is kept as not toxic, linked with nothing, unchanged, and has no words, so that the mix leaves it
out; rows with a null doc_id are documents of their own; rows that repeat a doc_id, or whose texts tie, count as one document,
of which the least id, then the least text stays; an empty table gives no rows; other columns stay up to the last stage, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import bpe, common, mixing, near_dedup, queries, secrets, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, queries.TOXIC_FROM)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, k=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and place (0, 1, ...) of rows read from sorted files: by the files' names, then the rows within each."""
    rows = docs.select("doc_id", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    first, at = {}, 0
    for r in sorted(rows.groupBy("file").count().collect()):
        first[r["file"]], at = at, at + r["count"]
    start = F.element_at(F.create_map(*(F.lit(x) for kv in first.items() for x in kv)), F.col("file")) if first else F.lit(0)
    return rows.select("doc_id", "text", (start + F.col("row")).cast("long").alias("place"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Written before it is sorted: the sort reads its rows twice.
    return common.cut(bpe.encode_documents(in_order(docs), queries.vocabulary(), place="place").drop("decoded_sha256"), "encoded").orderBy("place")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", redact_secrets), ("mixing", mix_sources), ("bpe", encode)]
#: Learned scores, minwise tokens and token ids can't be written in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = docs
        with common.scope(spark) as s:
            docs = s.keep(stage(spark, before, sf_dir), f"stage-{name}")
        common.discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run(), as registered: ids are told by their number and digest."""
    return run(spark, sf_dir).withColumn("ids", F.size("ids")).withColumnRenamed("ids", "n_ids")
