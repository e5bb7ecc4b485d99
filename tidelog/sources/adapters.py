"""The supplied tables as the stores of an op-log engine: pure projections, pushed down to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.codec import content_hash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _event_hash() -> Column:
    return content_hash(F.col("event_id"), F.col("user_id"), F.col("event_type"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, clock_id, hash, payload: one ADD entry an event."""
    return table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("time"), F.col("user_id").cast("string").alias("clock_id"), _event_hash().alias("hash"), F.col("props").alias("payload"), "event_id", "event_type")


def kv_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, clock_id, hash, key, op, value: a PUT or, for every seventh event, a DEL of the user's key for the type."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("time"), F.col("user_id").cast("string").alias("clock_id"), _event_hash().alias("hash"),
        F.concat(F.lit("u"), F.col("user_id"), F.lit("/"), F.col("event_type")).alias("key"), F.when(F.col("event_id") % 7 == 0, "DEL").otherwise("PUT").alias("op"), F.col("props").alias("value"),
    )


def replicas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two copies of the event log that have seen different entries, with a common part."""
    log = event_log(spark, sf_dir)
    return log.where("event_id % 3 != 0"), log.where("event_id % 3 != 1")


def dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, hash, next, time, clock_id: each turn of a conversation refers to the one before, twice, and to the one
    before that, as entries with skip pointers do."""
    name = lambda back: F.sha2(F.concat_ws("|", F.col("conv_id"), F.col("turn") - back), 256)
    known = lambda back: F.when(F.col("turn") - back >= F.col("first"), name(back))
    turns = table(spark, sf_dir, "conversations")
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("first"))
    joined = turns.join(first, "conv_id")
    return joined.select(F.col("conv_id").alias("log_id"), name(0).alias("hash"), F.array_compact(F.array(known(1), known(1), known(2))).alias("next"), (F.col("turn") + 1).alias("time"), F.col("role").alias("clock_id"), "turn")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and body: a JSON document for each row, under source.lang.id."""
    key = F.concat_ws(".", "source", "lang", "doc_id")
    return table(spark, sf_dir, "documents").select(key.alias("key"), F.to_json(F.struct(key.alias("_id"), "lang", "source", "n_chars")).alias("body"), "doc_id")


def order_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """time, hash, op, docs: one PUTALL an order, with a document for each of its lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("part/"), F.col("l_partkey")).alias("key"), F.concat(F.lit("order "), F.col("l_orderkey"), F.lit(" line "), F.col("l_linenumber")).alias("value")))).alias("lines")
    )
    return lines.select(F.col("l_orderkey").alias("time"), F.sha2(F.col("l_orderkey").cast("string"), 256).alias("hash"), F.lit("PUTALL").alias("op"), F.transform("lines", lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value"))).alias("docs"))


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tag and content of every document."""
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("tag"), F.col("text").alias("content"), "doc_id")


def acl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """role and key: segments of customers stand for roles."""
    role = F.when(F.col("c_mktsegment") == "BUILDING", "write").when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("read")
    return table(spark, sf_dir, "customer").select(role.alias("role"), F.col("c_custkey").cast("string").alias("key"))


def datastore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key and value of a hierarchical datastore."""
    return table(spark, sf_dir, "events").select(F.concat(F.lit("/ev/"), F.col("event_type"), F.lit("/"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("key"), F.col("props").alias("value"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, seq, x: a latency sample an event."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), F.col("event_id").alias("seq"), F.col("value").alias("x"))


def key_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_id, key_id, version, operation, ts: key synchronisation messages."""
    kind = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "view", "MetadataSync").otherwise("Update")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("message_id"), F.col("user_id").cast("string").alias("key_id"), F.floor(F.col("event_id") / 10).cast("long").alias("version"), kind.alias("operation"), "ts")
