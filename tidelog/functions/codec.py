"""Hashes and encodings of entries and operations, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATION = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("op", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("docs", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))),
])
ENTRY = T.StructType([
    T.StructField("hash", T.StringType()), T.StructField("log_id", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("next", T.ArrayType(T.StringType())),
    T.StructField("v", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("clock_id", T.StringType()),
])


def content_hash(*fields: Column) -> Column:
    """The hash of an entry's content. Its own hash and its writer's identity are no part of it."""
    return F.sha2(F.concat_ws("|", *fields), 256)


def entry_hash(log_id: Column, payload: Column, next_: Column, v: Column, time: Column, clock_id: Column) -> Column:
    """The hash of an entry over its canonical JSON."""
    return F.sha2(F.to_json(F.struct(log_id.alias("id"), payload.alias("payload"), next_.alias("next"), v.alias("v"), F.struct(clock_id.alias("id"), time.alias("time")).alias("clock"))), 256)


def operation(key: Column, op: Column, value: Column, docs: Column | None = None) -> Column:
    """An operation; docs: the pairs of a batch, else none."""
    empty = F.array().cast(OPERATION["docs"].dataType)
    return F.struct(key.alias("key"), op.alias("op"), value.alias("value"), (empty if docs is None else docs).alias("docs"))


def packed(op: Column) -> Column:
    """An operation as the text that an entry carries."""
    return F.base64(F.encode(F.to_json(op), "utf-8"))


def unpacked(payload: Column) -> Column:
    """The operation of a payload; null if it can't be read."""
    return F.from_json(F.decode(F.try_to_binary(payload, F.lit("base64")), "utf-8"), OPERATION)


def bounded(value: Column, most_bytes: int) -> Column:
    """The value, if it has at most so many bytes; else the query fails."""
    too_long = F.raise_error(F.concat(F.lit("value is longer than "), F.lit(str(most_bytes)), F.lit(" bytes")))
    return F.when(F.octet_length(value) > most_bytes, too_long.cast("string")).otherwise(value)


def canonical_map(entries: Column) -> Column:
    """A map as text that doesn't depend on the order of insertion."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def size_ratio(a: Column, b: Column) -> Column:
    return F.octet_length(a) / F.octet_length(b)


def error_class(message: Column) -> Column:
    """network, timeout, not_found or other, by the words of the message."""
    low = F.lower(message)
    return F.when(low.rlike("timed? ?out"), "timeout").when(low.rlike("network|connection|peer|dial"), "network").when(low.rlike("not found|missing|no such"), "not_found").otherwise("other")


def is_recoverable(kind: Column) -> Column:
    return kind.isin("network", "timeout")
