"""Telemetry: means, running averages, percentiles, rates, scores and evictions over samples (series, seq, x).

Running averages depend on order. They are linear, so each sample has a weight that its place from the end decides, and
weights fall so fast that beyond a few hundred samples the rest is below the precision of a double. So they too are sums
over the newest samples, of which Spark keeps only as many a task, and no series is sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOW = 100
HISTORY = 10_000
PRECISION = 1e-18
#: percentile_approx gives ranks to one part in ACCURACY; the exact search looks at a band of twice that around.
ACCURACY = 10_000


def newest(samples: DataFrame, n: int) -> DataFrame:
    """The last n samples of each series, with back, their place from the end, from 0."""
    place = F.row_number().over(W.partitionBy("series").orderBy(F.desc("seq")))
    return samples.withColumn("place_", place).where(F.col("place_") <= n).withColumn("back", F.col("place_") - 1).drop("place_")


def last_mean(samples: DataFrame, n: int = WINDOW) -> DataFrame:
    """series and the mean of its last n samples."""
    return newest(samples, n).groupBy("series").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))


def ewma(samples: DataFrame, share: float) -> DataFrame:
    """series and its average where each sample counts share and the first one is the start."""
    n = math.ceil(math.log(PRECISION) / math.log(1 - share))
    counts = samples.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    weight = F.pow(F.lit(1 - share), F.col("back")) * F.when(F.col("back") == F.col("n") - 1, 1.0).otherwise(share)
    return newest(samples, n).join(counts, "series").groupBy("series").agg(F.sum(F.col("x") * weight).alias("ewma"))


def halving(samples: DataFrame, n: int = HISTORY) -> DataFrame:
    """series and the average that halves itself with each sample, from 0 on, over the last n."""
    n = min(n, math.ceil(-math.log2(PRECISION)))
    return newest(samples, n).groupBy("series").agg(F.sum(F.col("x") * F.pow(F.lit(0.5), F.col("back") + 1)).alias("average"))


def percentile_floor(samples: DataFrame, q: float) -> DataFrame:
    """series and the sample at place floor(n q), from 0, of its sorted ones.

    Approximate percentiles on both sides bound where it is; only the distinct values between them are sorted, with their
    counts, after all samples below are counted.
    """
    sides = [max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY)]
    bounds = samples.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", sides, ACCURACY).alias("b")).select("series", F.least(F.floor(F.col("n") * q), F.col("n") - 1).alias("wanted"), F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    placed = samples.join(bounds, "series").where(F.col("x") <= F.col("high"))
    counted = placed.groupBy("series", "wanted", F.greatest("x", "low").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy("series").orderBy("x"))
    return counted.withColumn("upto", upto).where("upto > wanted").groupBy("series").agg(F.min("x").alias("value"))


def success_rate(attempts: DataFrame, ok: Column) -> DataFrame:
    """Percent of attempts that went well; 0 if there are none."""
    return attempts.agg(F.coalesce(100.0 * F.avg(ok.cast("int")), F.lit(0.0)).alias("rate"), F.count(F.lit(1)).alias("n"))


def percentage(part: Column, whole: Column) -> Column:
    """Percent, 0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100.0)


def health_score(connected: Column, latency_ms: Column, age_s: Column, idle_s: Column, errors: Column) -> Column:
    """A score from 0 to 1 of a connection's state, latency, age, use and errors."""
    latency = F.greatest(F.lit(0.0), 1 - latency_ms / 1000.0)
    age = F.least(F.lit(1.0), age_s / 3600.0)
    use = F.greatest(F.lit(0.0), 1 - idle_s / 300.0)
    clean = 1 / (1 + errors)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * connected + 0.25 * latency + 0.15 * age + 0.15 * use + 0.05 * clean))


def eviction_score(age_s: Column, accesses: Column, priority: Column) -> Column:
    return 0.4 * age_s + 0.3 / (accesses + 1) + 0.3 * (10 - priority)


def evicted(items: DataFrame, score: Column, key: str = "key", share: float = 0.2) -> DataFrame:
    """The share of items, rounded up, with the greatest scores; of equal scores, the least keys.

    Items that score above an approximate percentile are taken as they are, and only a band around it is sorted.
    """
    scored = items.withColumn("score", score)
    n = items.count()
    most = -(-n * round(share * 1000) // 1000)
    if most == 0:
        return scored.limit(0)
    low, high = scored.agg(F.percentile_approx("score", [max(0.0, 1 - share - 2 / ACCURACY), min(1.0, 1 - share + 2 / ACCURACY)], ACCURACY)).first()[0]
    sure = scored.where(F.col("score") > high)
    rest = scored.where(F.col("score").between(low, high)).orderBy(F.desc("score"), key).limit(most - sure.count())
    return sure.unionByName(rest)


def batch_efficiency(batches: DataFrame) -> DataFrame:
    """Share of operations that went in batches of more than one."""
    total = F.sum("n_ops")
    return batches.agg(total.alias("n_ops"), F.when(total > 0, F.sum(F.when(F.col("n_ops") > 1, F.col("n_ops")).otherwise(0)) / total).otherwise(0.0).alias("efficiency"))


def cache_hit_rate(hits: Column, misses: Column) -> Column:
    return F.when(hits + misses > 0, hits / (hits + misses)).otherwise(0.0)


def thresholds(rate: Column, good: float = 0.95, fair: float = 0.80) -> Column:
    return F.when(rate >= good, "healthy").when(rate >= fair, "degraded").otherwise("unhealthy")


def priority_batch(queue: DataFrame, size: int) -> DataFrame:
    """The first operations by priority, then by arrival; the rest stays in the queue."""
    return queue.orderBy(F.desc("priority"), "seq").limit(size)


def bounded_history(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows of each series."""
    return newest(rows, n).drop("back")


def memory_estimate(pins: Column, cached_bytes: Column, peers: Column) -> Column:
    return 64 * pins + cached_bytes + 256 * peers


def last_value(rows: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, ts).alias(value))
