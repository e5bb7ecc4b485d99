"""Folds of an operation log into its current state, one row a key.

Every fold is a latest-per-key aggregate with partial aggregation before the shuffle, so a hot key costs no more than others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PUT, DEL, PUTALL = "PUT", "DEL", "PUTALL"


def winners(ops: DataFrame, keys: list[str], order: list[str | Column], kept: list[str]) -> DataFrame:
    """kept columns of each key's last row in the order."""
    last = F.max_by(F.struct(*kept), F.struct(*order)).alias("w_")
    return ops.groupBy(*keys).agg(last).select(*keys, "w_.*")


def _has_value() -> Column:
    return F.coalesce(F.octet_length("value"), F.lit(0)) > 0


def _named() -> Column:
    return F.coalesce(F.col("key"), F.lit("")) != ""


def current(ops: DataFrame) -> DataFrame:
    """key and value after replaying all operations: puts without a value and unknown operations change nothing."""
    effective = ops.where(_named() & ((F.col("op") == DEL) | ((F.col("op") == PUT) & _has_value())))
    return winners(effective, ["key"], ["time", "clock_id", "hash"], ["op", "value"]).where(F.col("op") == PUT).select("key", "value")


def single_pass(ops: DataFrame) -> DataFrame:
    """key and value after one pass from the newest operation on: the newest one of a key decides, even if it is a put
    without a value or unknown, which leave the key absent."""
    found = winners(ops.where(_named()), ["key"], ["time", "clock_id", "hash"], ["op", "value"])
    return found.where((F.col("op") == PUT) & _has_value()).select("key", "value")


def with_batches(ops: DataFrame) -> DataFrame:
    """Single operations and the documents of PUTALL as rows of order (time, hash, doc_pos), key, op, value."""
    singles = ops.where((F.col("op") == DEL) | ((F.col("op") == PUT) & _has_value())).select("time", "hash", F.lit(0).alias("doc_pos"), "key", "op", "value")
    batches = ops.where(F.col("op") == PUTALL).select("time", "hash", F.posexplode("docs").alias("doc_pos", "doc")).select("time", "hash", "doc_pos", "doc.key", F.lit(PUT).alias("op"), "doc.value")
    return singles.unionByName(batches)


def document_state(ops: DataFrame) -> DataFrame:
    """key and value of a document store: ops has time, hash, op, key, value and docs."""
    found = winners(with_batches(ops), ["key"], ["time", "hash", "doc_pos"], ["op", "value"])
    return found.where(F.col("op") == PUT).select("key", "value")


def facade_state(ops: DataFrame) -> DataFrame:
    """key and value as the facade folds a log: the newest time wins and of equal times the first; unknown operations with
    a value count as puts, and empty keys are keys. ops has time, pos, key, op, value."""
    last = F.max_by(F.struct("op", "value"), F.struct(F.col("time"), -F.col("pos"))).alias("w_")
    found = ops.groupBy("key").agg(last).select("key", "w_.*")
    return found.where((F.col("op") != DEL) & F.col("value").isNotNull()).select("key", "value")


def facade_get(ops: DataFrame, key: str) -> DataFrame:
    """One key as the facade reads it from the log: only PUT and DEL after time 0 are seen, and the first of equal times."""
    seen = ops.where((F.col("key") == key) & F.col("op").isin(PUT, DEL) & (F.col("time") > 0))
    last = F.max_by(F.struct("op", "value"), F.struct(F.col("time"), -F.col("pos"))).alias("w_")
    return seen.groupBy("key").agg(last).where(F.col("w_.op") == PUT).select("key", "w_.value")


def latest_entries(entries: DataFrame) -> DataFrame:
    """Replicated documents: the latest entry of each key (ts, hash, content_len), without tombstones."""
    return winners(entries, ["key"], ["ts", "hash"], ["hash", "content_len"]).where("content_len > 0")
