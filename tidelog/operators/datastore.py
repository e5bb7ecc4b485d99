"""Operators on a byte-ordered key-value datastore: key and value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.functions.keys import has_prefix, is_descendant, normalised


def get(store: DataFrame, key: str) -> DataFrame:
    return store.where(F.col("key") == key)


def has(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Those of keys that the store has."""
    return keys.join(store.select("key"), "key", "left_semi")


def value_size(store: DataFrame, key: str) -> DataFrame:
    return get(store, key).select("key", F.octet_length("value").cast("long").alias("size"))


def page(store: DataFrame, prefix: str = "", limit: int | None = None, offset: int = 0, descending: bool = False) -> DataFrame:
    """Keys with a prefix of bytes. The page is cut in ascending order and only then turned round; a limit of 0 gives one row."""
    found = (store.where(has_prefix(F.col("key"), prefix)) if prefix else store).orderBy("key")
    if offset:
        found = found.offset(offset)
    if limit is not None:
        found = found.limit(max(limit, 1))
    return found.orderBy(F.desc("key")) if descending else found


def keys(store: DataFrame, prefix: str = "") -> DataFrame:
    """Keys with the prefix as it is."""
    return store.where(has_prefix(F.col("key"), prefix)).select("key")


def keys_under(store: DataFrame, prefix: str) -> DataFrame:
    """Keys with the prefix, normalised to a path first."""
    return store.where(has_prefix(F.col("key"), normalised(F.lit(prefix)))).select("key")


def descendants(store: DataFrame, key: str) -> DataFrame:
    """Rows strictly below the key, by segments."""
    return store.where(is_descendant(F.col("key"), F.lit(key)))


def at_least(store: DataFrame, size: int) -> DataFrame:
    return store.where(F.octet_length("value") >= size)


def totals(store: DataFrame) -> DataFrame:
    return store.agg(F.count(F.lit(1)).alias("n_keys"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0)).alias("n_bytes"))


def upserted(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after changes (seq, key, op, value): the last change of a key counts, and a DEL removes it."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("op", "value"), "seq").alias("c_")).select("key", "c_.op", "c_.value")
    kept = store.join(last.select("key"), "key", "left_anti")
    return kept.select("key", "value").unionByName(last.where(F.col("op") == "PUT").select("key", "value"))
