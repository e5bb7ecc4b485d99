"""Content-addressed blobs, tags and pins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.running import before_each

PIN = "pin-"


def addressed(content: DataFrame) -> DataFrame:
    """content with its hash and size; null content has neither."""
    return content.withColumn("hash", F.sha2("content", 256)).withColumn("size", F.octet_length("content").cast("long"))


def stored(content: DataFrame) -> DataFrame:
    """hash, size and n_refs of each distinct content. Only hashes are shuffled, not contents."""
    return addressed(content).groupBy("hash").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("n_refs"))


def tagged(tags: DataFrame, prefix: str) -> DataFrame:
    return tags.where(F.col("tag").startswith(prefix))


def pinned(tags: DataFrame) -> DataFrame:
    return tagged(tags, PIN)


def pin(tags: DataFrame, wanted: DataFrame, blobs: DataFrame) -> DataFrame:
    """Tags with pins for the wanted hashes that exist."""
    new = wanted.select("hash").join(blobs.select("hash"), "hash", "left_semi").select(F.concat(F.lit(PIN), F.col("hash")).alias("tag"), "hash")
    return tags.select("tag", "hash").unionByName(new).distinct()


def unpin(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone.select(F.concat(F.lit(PIN), F.col("hash")).alias("tag")), "tag", "left_anti")


def collectable(blobs: DataFrame, tags: DataFrame) -> DataFrame:
    """Blobs that no tag protects."""
    return blobs.join(tags.select("hash").distinct(), "hash", "left_anti")


def fetched(wanted: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """hash, content and origin: from here, else from the first provider (rank) that has it."""
    first = remote.groupBy("hash").agg(F.min_by("content", "rank").alias("far"))
    found = wanted.join(local.select("hash", F.col("content").alias("near")), "hash", "left").join(first, "hash", "left")
    return found.select("hash", F.coalesce("near", "far").alias("content"), F.when(F.col("near").isNotNull(), "local").when(F.col("far").isNotNull(), "remote").alias("origin"))


def combined(parts: DataFrame, group: str = "batch", seq: str = "seq", size: str = "size") -> DataFrame:
    """Where each part starts in the blob that its group is combined to."""
    placed = before_each(parts, [group], seq, F.sum, F.col(size), lambda x, y: x + y)
    return placed.withColumn("offset", F.coalesce("before_", F.lit(0)).cast("long")).drop("before_")


def repository_stats(blobs: DataFrame) -> DataFrame:
    return blobs.agg(F.count(F.lit(1)).alias("n_blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))
