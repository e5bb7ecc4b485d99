"""Queries on appended entries, exported lists, replication state and catalogs of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec, keys
from tidelog.operators import acl, blobs, datastore, documents, fold, log, sync, telemetry
from tidelog.plans.registry import ACL, DAG, EVENT_LOG, STORE, query
from tidelog.sources import adapters


@query("WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) AS n, (SELECT max(event_id) FROM events) + 1 AS base, (SELECT count(*) FROM events) AS heads FROM events) SELECT n, base + n AS time, sha256(concat_ws('|', 'events', base + n, 'w', props)) AS hash, CASE WHEN n = 1 THEN heads ELSE least(CAST(floor(log2(n - 1)) AS BIGINT) + 1, 7) END AS n_refs FROM e")
def log_append(spark: SparkSession, d: str) -> DataFrame:
    """An entry for every event after the whole log, whose entries are all heads; each refers to ones before it by powers
    of two, up to 64."""
    entries = adapters.event_log(spark, d).select(F.lit("events").alias("log_id"), "hash", F.array().cast("array<string>").alias("next"), "time", "clock_id", "payload")
    new = adapters.table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), F.lit("events").alias("log_id"), F.lit("w").alias("clock_id"), F.col("props").alias("payload"))
    made, links = log.appended_apart(entries, new)
    named = F.broadcast(links.groupBy(F.col("child").alias("hash")).agg(F.count("parent").alias("heads_")))  # one row, of the first entry
    made = made.join(named, "hash", "left").join(log.clock_time(entries).withColumnRenamed("time", "base_"))
    return made.select((F.col("time") - F.col("base_")).alias("n"), "time", "hash", (F.size("next") + F.coalesce("heads_", F.lit(0))).alias("n_refs"))


@query(f"WITH {DAG}, a AS (SELECT hash FROM dag WHERE log_id = 3 AND turn = 1) SELECT dag.hash, dag.time FROM dag, a WHERE list_contains(dag.next, a.hash)")
def log_children(spark: SparkSession, d: str) -> DataFrame:
    graph = adapters.dag(spark, d)
    return log.children(graph, graph.where("log_id = 3 and turn = 1").first()["hash"]).select("hash", "time")


@query(f"WITH {ACL}, r AS (SELECT role, '[\"' || array_to_string(list(DISTINCT key ORDER BY key), '\",\"') || '\"]' AS keys FROM acl GROUP BY role) SELECT '{{' || array_to_string(list('\"' || role || '\":' || keys ORDER BY role), ',') || '}}' AS access FROM r")
def acl_export(spark: SparkSession, d: str) -> DataFrame:
    """Roles with their keys, as one JSON map."""
    return acl.exported(adapters.acl(spark, d)).select(F.to_json("access").alias("access"))


@query(f"WITH {ACL} SELECT role, CASE WHEN role = 'read' THEN 0 ELSE count(DISTINCT key) END AS n_keys FROM acl GROUP BY role")
def acl_clear(spark: SparkSession, d: str) -> DataFrame:
    """A cleared role stays, without keys."""
    return acl.cleared(acl.by_role(adapters.acl(spark, d)), "read").select("role", F.size("keys").cast("long").alias("n_keys"))


@query("SELECT count(DISTINCT text) AS n_blobs, CAST((SELECT sum(s) FROM (SELECT DISTINCT text, strlen(text) AS s FROM documents) t) AS BIGINT) AS n_bytes FROM documents")
def blob_stats(spark: SparkSession, d: str) -> DataFrame:
    return blobs.repository_stats(blobs.stored(adapters.blobs(spark, d)))


@query(f"WITH {STORE}, asked AS (SELECT '/ev/view/' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS key FROM events) SELECT key FROM asked WHERE key IN (SELECT key FROM store)")
def ds_has(spark: SparkSession, d: str) -> DataFrame:
    """Asks for a key of every event."""
    asked = adapters.table(spark, d, "events").select(F.concat(F.lit("/ev/view/"), F.lpad(F.col("event_id").cast("string"), 8, "0")).alias("key"))
    return datastore.has(adapters.datastore(spark, d), asked)


@query("SELECT source AS key, arg_max(doc_id, doc_id) AS hash, max_by(n_chars, doc_id) AS content_len FROM documents GROUP BY source HAVING max_by(n_chars, doc_id) % 2 = 1")
def doc_replicated_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest entry of each key; one with an even length stands for a tombstone."""
    entries = adapters.table(spark, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("ts"), F.col("doc_id").alias("hash"), (F.col("n_chars") * (F.col("n_chars") % 2)).alias("content_len"))
    return fold.latest_entries(entries).select("key", "hash", "content_len")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def doc_readable(spark: SparkSession, d: str) -> DataFrame:
    """Bodies that are JSON; every third one is cut short."""
    docs = adapters.documents(spark, d).withColumn("body", F.when(F.col("doc_id") % 3 == 0, F.substring("body", 1, 5)).otherwise(F.col("body")))
    return documents.readable(docs).select("doc_id")


@query("SELECT event_id, CASE WHEN event_id % 50 > 0 AND event_id % 60 >= event_id % 50 THEN 'Completed' WHEN event_id % 60 > 0 THEN 'Replicating' ELSE 'Loading' END AS state, round(CASE WHEN event_id % 50 = 0 THEN 0 ELSE (event_id % 60) / CAST(event_id % 50 AS DOUBLE) * 100 END, 6) AS percent FROM events")
def sync_progress(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    percent = telemetry.percentage((n % 60).cast("double"), n % 50)
    return adapters.table(spark, d, "events").select("event_id", sync.sync_state(n % 60, n % 50).alias("state"), F.round(percent, 6).alias("percent"))


@query("WITH c AS (SELECT user_id, CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS hits, CAST(sum(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) AS BIGINT) AS misses, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, round(CASE WHEN hits + misses > 0 THEN hits / CAST(hits + misses AS DOUBLE) ELSE 0 END, 6) AS hit_rate, CASE WHEN hits >= 95e-2 * n THEN 'healthy' WHEN hits >= 8e-1 * n THEN 'degraded' ELSE 'unhealthy' END AS health, 64 * hits + misses + 256 * n AS memory FROM c")
def cache_stats(spark: SparkSession, d: str) -> DataFrame:
    """A miss of both tiers counts twice."""
    kind, n = F.col("event_type"), F.col("n")
    counted = adapters.table(spark, d, "events").groupBy("user_id").agg(F.sum(F.when(kind.isin("view", "click"), 1).otherwise(0)).alias("hits"), F.sum(F.when(kind == "error", 2).otherwise(0)).alias("misses"), F.count(F.lit(1)).alias("n"))
    hits, misses = F.col("hits"), F.col("misses")
    return counted.select("user_id", F.round(telemetry.cache_hit_rate(hits, misses), 6).alias("hit_rate"), telemetry.thresholds(hits / n).alias("health"), telemetry.memory_estimate(hits, misses, n).alias("memory"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'network' WHEN contains(source, '1') THEN 'store' ELSE 'simple' END AS kind, source AS topic FROM documents")
def controller_types(spark: SparkSession, d: str) -> DataFrame:
    """The declared type counts; else one that the address names."""
    n = F.col("doc_id")
    address = F.concat(F.when(F.col("source").contains("1"), "/STORE/").otherwise("/x/"), F.col("source"))
    return adapters.table(spark, d, "documents").select("doc_id", keys.controller_type(F.when(n % 2 == 0, " Network "), address).alias("kind"), keys.topic(address).alias("topic"))


@query("SELECT user_id, '{' || array_to_string(list('\"' || k || '\":' || n ORDER BY k), ',') || '}' AS snapshot FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY 1, 2) t GROUP BY user_id")
def snapshot_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Maps as text that doesn't depend on the order in which they were filled."""
    counted = adapters.table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m")).select("user_id", codec.canonical_map(F.col("m")).alias("snapshot"))


@query(f"WITH {EVENT_LOG} SELECT clock_id, count(*) AS n, max(time) AS latest FROM elog GROUP BY clock_id")
def log_by_writer(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_log(spark, d).groupBy("clock_id").agg(F.count(F.lit(1)).alias("n"), F.max("time").alias("latest"))
