"""Mixing sources to target weights by a time-varying curriculum; DataFrame functions only.

Size of a document: its runs of characters other than ASCII white space. Sources, in order of their code points with
null last, weigh by `WEIGHTS`, repeating. Together they get `SHARE` of all words; a source's target stops at `MOST` times its
size, and what is over is shared again by weight. That is water-filling: with sources ordered by size over weight,
those up to some place are full and all others get one level times their weight, found from running sums.

Within a source, documents stand in the order of md5(doc_id) with a place c (words before them). A target of f
whole passes and r words takes f times each document and once more the words before r. The source's weight over
the training time t in [0, 1] is a line from a to b (`SCHEDULES`, by its rank); its integral, scaled to the target, is
the source's demand of words up to t, and inverting it at c gives the time at which the document is due. The position is the
demand of all sources up to that time, as a share of all words taken: equal steps of it are equal shares of training, in
which the sources' shares add up to 1. Rows are range-sorted by position.

Places are prefix sums in two levels: in buckets of a source (many, so that no source, however large, is one group) and over
the buckets' totals. Each bucket holds a range of the order.

Defined cases: null text has size 0; null source is a source; null doc_id is ordered as ''; repeated rows are
documents of their own (their order doesn't matter, being equal); size 0 takes 0; a table without words takes nothing;
without rows there are none; other columns are kept out, or kept by `mix_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
#: Weight at the beginning and the end of training, by rank of the source, repeating.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
#: Rows of a bucket, and how many buckets a source has at least.
BUCKET_ROWS, BUCKETS = 20_000, 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_rank(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, rank, target from source, source_size: one row a source."""
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(everyone) - 1).withColumn("weight", by_rank(WEIGHTS, F.col("rank")))
    s = s.withColumn("most", MOST * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    up = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("pool", SHARE * F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    # The level if all sources before this one are full and it and all after it are not.
    level = (F.col("pool") - F.coalesce(F.sum("most").over(up), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(up), F.lit(0.0)))
    s = s.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)
    s = s.withColumn("found", found)
    target = F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("most", F.col("weight") * F.col("found.level")))
    s = s.select("source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))
    # All sources' demand up to t is linear * t + square * t^2 words; summed in the order of ranks, so that reruns agree.
    whole = everyone.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    a, b = ends(F.col("rank"))
    share = F.col("target") / F.nullif(F.sum("target").over(whole), F.lit(0.0))
    s = s.withColumn("_linear", share * a / ((a + b) / 2)).withColumn("_square", share * (b - a) / (a + b))
    return s.select("source", "source_size", "rank", "target", *(F.coalesce(F.sum(f"_{x}").over(whole), F.lit(0.0)).alias(x) for x in ("linear", "square")))


def ends(rank: Column) -> tuple[Column, Column]:
    """The weight of a source at the beginning and the end of training."""
    return by_rank(tuple(x for x, _ in SCHEDULES), rank), by_rank(tuple(x for _, x in SCHEDULES), rank)


def due(place: Column, target: Column, rank: Column) -> Column:
    """The time at which a source's integrated weight schedule has asked for `place` words of `target`."""
    a, b = ends(rank)
    y = F.when(target > 0, place / target).otherwise(0.0) * (a + b) / 2
    # a t + (b - a) t^2 / 2 = y, in the form that also holds where b = a
    return 2 * y / (a + F.sqrt(F.greatest(a * a + 2 * (b - a) * y, F.lit(0.0))))


def position(place: Column) -> Column:
    """The share of all training words before the time at which a row of placed() is due."""
    t = due(place, F.col("target"), F.col("rank"))
    return t * (F.col("linear") + F.col("square") * t)


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """The kept columns and, under names of our own, each row's source key, size and order."""
    md5 = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    order = F.conv(F.substring(md5, 1, 13), 16, 10).cast("long")  # 52 bits
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.select(*keep, key.alias("_source"), n_words(F.col("text")).alias("_size"), order.alias("_order"))


def placed(docs: DataFrame, whole_rows: bool) -> DataFrame:
    """Each row of docs with _size, source_size, rank, target, linear, square, and place: the words of its source before it.

    Its columns are `doc_id`, or `doc`, a struct of the whole row. Texts are measured first, into a narrow table; whole rows
    are then shuffled once, by source and bucket.
    """
    sized = common.cut(measured(docs, F.col("doc_id")), "sizes")
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count("*").alias("n"))
    # Buckets by the rows of the largest source, so that one bucket holds some BUCKET_ROWS.
    most = totals.agg(F.max("n")).first()[0] or 1
    wide = float(2**52 // max(BUCKETS, -(-most // BUCKET_ROWS)) + 1)
    bucket = F.floor(F.col("_order") / F.lit(wide)).cast("int")
    sources = totals.select(F.when(F.col("_source") != "", F.expr("substring(_source, 2)")).alias("source"), "source_size")
    targets = source_targets(sources).withColumn("_source", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("words")).withColumn("start", F.coalesce(F.sum("words").over(before), F.lit(0)))
    starts = starts.join(targets, "_source").drop("words")
    rows = measured(docs, F.struct("*").alias("doc"), F.col("doc_id")) if whole_rows else sized
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_bucket", bucket).withColumn("inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    return rows.join(starts, ["_source", "_bucket"]).withColumn("place", F.col("start") + F.col("inside"))


def taken(size: Column, place: Column, source_size: Column, target: Column) -> Column:
    whole = F.floor(target).cast("long")
    passes = F.when(source_size > 0, F.floor(whole / source_size)).otherwise(0).cast("long")
    rest = whole - passes * source_size
    return passes * size + F.least(F.greatest(rest - place, F.lit(0)), size)


def words_taken() -> Column:
    return taken(*map(F.col, ("_size", "place", "source_size", "target"))).cast("long")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, position and last_position (of its first and its last pass; null if nothing is taken),
    sorted by position."""
    out = placed(docs, False).withColumn("taken", words_taken())
    again = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("_size")) - 1)
    at = [F.when(F.col("taken") > 0, position(F.col("place") + n * F.col("source_size"))).alias(name) for name, n in (("position", F.lit(0)), ("last_position", again))]
    out = out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", *at)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents themselves, all their columns, in training order, whole, as often as the mix takes them (0, 1 or 2 times).

    A document's last, partial pass counts if at least half of its words are taken.
    """
    times = F.when(F.col("_size") > 0, F.floor(words_taken() / F.col("_size") + 0.5)).otherwise(0).cast("int")
    p = placed(docs, True).withColumn("times", times).where("times > 0")
    p = p.select("*", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("pass"))
    at = position(F.col("place") + F.col("pass") * F.col("source_size"))
    return p.select(at.alias("at"), "doc").orderBy("at", "doc.doc_id").select("doc.*")
