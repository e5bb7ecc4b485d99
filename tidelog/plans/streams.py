"""Queries that run a stream over the events that there are, and what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.plans.registry import EVENT_LOG, query
from tidelog.shared import shared_dir
from tidelog.sources.store import OpLogTable
from tidelog.streaming import replication

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _folder(spark: SparkSession) -> str:
    """A new folder that executors share."""
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return replication.event_stream(spark, f"{d}/events.parquet*", EVENTS)


def _ran(spark: SparkSession, stream: DataFrame, mode: str = "append") -> DataFrame:
    out = _folder(spark)
    sink = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/data/batch={n}")  # noqa: E731  run again, it writes the same
    replication.run_available(stream, sink, f"{out}/checkpoint", mode)
    return spark.read.schema(stream.schema).parquet(f"{out}/data").select(*stream.columns)


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first message of each user and type; all are within the watermark of the one batch."""
    events = _events(spark, d).select("ts", "user_id", "event_type", F.concat_ws("/", "user_id", "event_type").alias("message_id"))
    return _ran(spark, replication.deduplicated(events, age="3650 days")).select("user_id", "event_type")


@query("SELECT date_trunc('day', ts) AS began, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_rates(spark: SparkSession, d: str) -> DataFrame:
    found = _ran(spark, replication.rates(_events(spark, d), "event_type", "1 day"), "complete")
    return found.select(F.col("began").cast("timestamp_ntz").alias("began"), "event_type", "n")


@query("WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum(CASE WHEN b IS NULL OR ts >= b + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM l) SELECT CAST(user_id AS VARCHAR) AS peer, min(ts) AS began, count(*) AS n FROM s GROUP BY user_id, g")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).select("ts", F.col("user_id").cast("string").alias("peer"))
    found = _ran(spark, replication.heartbeats(events, gap="6 hours"), "complete")
    return found.select("peer", F.col("began").cast("timestamp_ntz").alias("began"), "n")


@query(f"WITH {EVENT_LOG} SELECT hash, time, clock_id FROM elog")
def stream_replicate(spark: SparkSession, d: str) -> DataFrame:
    """Entries appended by a stream to a log that already has a third of them; each is there once."""
    table = OpLogTable(spark, f"{_folder(spark)}/log")
    n = F.col("event_id")
    entries = lambda df: df.select(F.sha2(F.concat_ws("|", "event_id", "user_id", "event_type"), 256).alias("hash"), (n + 1).alias("time"), F.col("user_id").cast("string").alias("clock_id"), F.col("props").alias("payload"))
    table.append(entries(spark.read.parquet(f"{d}/events.parquet").where("event_id % 3 = 0")))
    replication.run_available(entries(_events(spark, d)), replication.append_new(table), f"{_folder(spark)}/checkpoint")
    return table.read().select("hash", "time", "clock_id")


_VERSIONED = """WITH RECURSIVE m AS (SELECT event_id AS message_id, CAST(user_id AS VARCHAR) AS key_id, CASE WHEN event_id % 5 = 0 THEN event_id // 10 - 3 ELSE event_id // 10 END AS version,
  CASE event_type WHEN 'signup' THEN 'C' WHEN 'error' THEN 'D' WHEN 'view' THEN 'M' ELSE 'U' END AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
r(key_id, n, message_id, version, held, outcome) AS (
  SELECT DISTINCT key_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM m
  UNION ALL
  SELECT m.key_id, m.n, m.message_id, m.version,
    CASE op WHEN 'C' THEN CASE WHEN held >= m.version THEN held ELSE m.version END WHEN 'U' THEN CASE WHEN held IS NULL THEN NULL WHEN held > m.version THEN held ELSE m.version END WHEN 'D' THEN NULL ELSE greatest(coalesce(held, m.version), m.version) END,
    CASE op WHEN 'C' THEN CASE WHEN held >= m.version THEN 'ignored' ELSE 'created' END WHEN 'U' THEN CASE WHEN held IS NULL THEN 'missing' WHEN held > m.version THEN 'conflict' ELSE 'updated' END WHEN 'D' THEN 'deleted' ELSE 'metadata' END
  FROM r JOIN m ON m.key_id = r.key_id AND m.n = r.n + 1)
SELECT key_id, message_id, version, outcome FROM r WHERE n > 0"""


@query(_VERSIONED)
def stream_versioned_keys(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "Create").when(F.col("event_type") == "error", "Delete").when(F.col("event_type") == "view", "MetadataSync").otherwise("Update")
    messages = _events(spark, d).select(F.col("event_id").alias("message_id"), F.col("user_id").cast("string").alias("key_id"), F.when(F.col("event_id") % 5 == 0, F.floor(F.col("event_id") / 10) - 3).otherwise(F.floor(F.col("event_id") / 10)).cast("long").alias("version"), kind.alias("operation"))
    return _ran(spark, replication.versioned_keys(messages))
