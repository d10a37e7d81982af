"""Latency percentiles and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(samples: DataFrame, shares: dict[str, float]) -> DataFrame:
    """op, n, mean and, for each share q, the value at place floor(n * q) of its sorted samples (op, ms).

    Equal values are counted first, so that what is sorted is one row for each different value, not each sample.
    """
    per = samples.groupBy("op", "ms").agg(F.count("*").alias("c"))
    upto = Window.partitionBy("op").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("op")
    per = per.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(every))
    out = [F.max("n").alias("n"), (F.sum(F.col("ms") * F.col("c")) / F.sum("c")).alias("mean")]
    for name, q in shares.items():
        place = F.least(F.floor(F.col("n") * F.lit(q)), F.col("n") - 1)
        out.append(F.min(F.when(F.col("upto") > place, F.col("ms"))).alias(name))
    return per.groupBy("op").agg(*out)


def history(samples: DataFrame, width_ms: int) -> DataFrame:
    """slot_ms, n, total: figures of each stretch of time (ms, value)."""
    return samples.groupBy((F.floor(F.col("ms") / width_ms) * width_ms).cast("long").alias("slot_ms")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def health_score(error_rate: Column, imbalance: Column, healthy: Column, shards: Column) -> Column:
    """1 is best: falls with errors (none left at half), imbalance (none left at 3) and the share of unhealthy shards."""
    errors = F.greatest(1 - F.least(error_rate, F.lit(0.5)) * 2, F.lit(0.0))
    even = F.greatest(1 - F.least(imbalance - 1, F.lit(2.0)) / 2, F.lit(0.0))
    return errors * even * F.when(shards > 0, healthy / shards).otherwise(1.0)


def health(per_shard: DataFrame) -> DataFrame:
    """score, status, healthy, shards of (shard, ops, errors); a shard is healthy within half and twice the mean load."""
    mean = per_shard.agg(F.avg("ops").alias("mean"), F.max("ops").alias("most"), F.min("ops").alias("least"), F.sum("ops").alias("all"), F.sum("errors").alias("errors_all"))
    s = per_shard.crossJoin(F.broadcast(mean))
    ok = F.col("ops").between(F.col("mean") * 0.5, F.col("mean") * 2.0)
    s = s.groupBy("mean", "most", "least", "all", "errors_all").agg(F.count_if(ok).alias("healthy"), F.count("*").alias("shards"))
    imbalance = F.when(F.col("least") == 0, 1.0).otherwise(F.col("most") / F.col("least"))
    s = s.select("healthy", "shards", health_score(F.col("errors_all") / F.col("all"), imbalance, F.col("healthy"), F.col("shards")).alias("score"))
    return s.withColumn("status", F.when(F.col("score") > 0.8, "healthy").when(F.col("score") > 0.6, "warning").otherwise("critical"))


def load_variance(per_shard: DataFrame) -> DataFrame:
    """variance (population) and mean of the loads (shard, load); without shards it is 0."""
    return per_shard.agg(F.coalesce(F.var_pop("load"), F.lit(0.0)).alias("variance"), F.avg("load").alias("mean"))


def slow_share(samples: DataFrame, above: float) -> DataFrame:
    """op, n, slow, percent of samples (op, ms) that took longer."""
    slow = F.count_if(F.col("ms") > above)
    return samples.groupBy("op").agg(F.count("*").alias("n"), slow.alias("slow"), (slow * 100.0 / F.count("*")).alias("percent"))


def slow_log(samples: DataFrame, above: float, *order: str) -> DataFrame:
    """The samples that took longer than that, with all their columns (client, slot, key, result), slowest first."""
    return samples.where(F.col("ms") > above).orderBy(F.desc("ms"), *order)


def sliding_history(samples: DataFrame, width_ms: int, step_ms: int) -> DataFrame:
    """end_ms, n, total of the stretch of width_ms before each step: sums of steps first, so a sample is sent on once, not once a window."""
    steps = samples.groupBy((F.floor(F.col("ms") / step_ms) * step_ms).cast("long").alias("slot")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    ends = steps.select(F.explode(F.sequence(F.col("slot") + step_ms, F.col("slot") + width_ms, F.lit(step_ms).cast("long"))).alias("end_ms"), "n", "total")
    return ends.groupBy("end_ms").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def recent(samples: DataFrame, duration_ms: int, now: int) -> DataFrame:
    """Samples (ms, ...) of the time before now, the cutoff itself not among them."""
    return samples.where((F.col("ms") > now - duration_ms) & (F.col("ms") <= now))
