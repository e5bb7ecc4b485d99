"""Values that run over the rows of a group in an order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 64


def ranged(rows: DataFrame, order: str, ranges: int = RANGES) -> DataFrame:
    """rows with range_, which follows the order (a column of numbers, dates or timestamps) and splits the rows about
    evenly. Equal values are in one range; nulls are in the first."""
    cuts = rows.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10_000).alias("at")).first()["at"] or []
    kind, cuts = rows.schema[order].dataType, sorted(set(cuts))

    def place(low: int, high: int) -> Column:
        """How many of the cuts from low to high are less, by halves. No lambda function: from one, Spark infers filters on
        the other side of a self-join that name columns which aren't there."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(order) > F.lit(cuts[middle]).cast(kind), place(middle + 1, high)).otherwise(place(low, middle))

    return rows.withColumn("range_", place(0, len(cuts)))


def before_each(rows: DataFrame, keys: list[str], order: str, of: Callable[[Column], Column], value: Column, merge: Callable[[Column, Column], Column], ranges: int = RANGES) -> DataFrame:
    """rows with before_: the aggregate of value over the rows of the same keys that come before, null where there are none.

    The ranges of a group are taken by tasks of their own, and what the ranges before give is merged in: at most as many rows
    a group as there are ranges. Null keys are a group like any other.
    """
    parts = ranged(rows, order, ranges).withColumn("value_", value).withColumn("group_", F.struct(*keys))  # of nulls, it isn't null
    earlier = W.partitionBy("group_").orderBy("range_").rowsBetween(W.unboundedPreceding, -1)
    totals = parts.groupBy("group_", "range_").agg(of(F.col("value_")).alias("total_"))
    totals = totals.select("group_", "range_", of(F.col("total_")).over(earlier).alias("earlier_"))
    own = of(F.col("value_")).over(W.partitionBy("group_", "range_").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    found = parts.withColumn("own_", own).join(totals, ["group_", "range_"])
    merged = F.when(F.col("own_").isNull(), F.col("earlier_")).when(F.col("earlier_").isNull(), F.col("own_")).otherwise(merge(F.col("own_"), F.col("earlier_")))
    return found.select(*rows.columns, merged.alias("before_"))
