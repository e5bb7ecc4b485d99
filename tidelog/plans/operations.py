"""Queries on telemetry, batches, caches, channels, addresses and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import codec, keys
from tidelog.operators import telemetry
from tidelog.plans.registry import SAMPLES, query
from tidelog.sources import adapters


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return adapters.samples(spark, d)


_ORDERED = f"WITH {SAMPLES}, o AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY seq DESC) - 1 AS back, count(*) OVER (PARTITION BY series) AS n FROM samples)"


@query(f"{_ORDERED} SELECT series, round(avg(x), 6) AS mean, count(*) AS n FROM o WHERE back < 100 GROUP BY series")
def metric_last100_mean(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.last_mean(_samples(spark, d)).select("series", F.round("mean", 6).alias("mean"), "n")


@query(f"WITH {SAMPLES}, l AS (SELECT series, list(x ORDER BY seq) AS xs FROM samples GROUP BY series) SELECT series, round(list_reduce(xs, lambda a, x: a * 0.9 + x * 0.1), 6) AS ewma FROM l")
def metric_ewma(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.ewma(_samples(spark, d), 0.1).select("series", F.round("ewma", 6).alias("ewma"))


@query(f"WITH {SAMPLES}, l AS (SELECT series, list(x ORDER BY seq) AS xs FROM samples GROUP BY series) SELECT series, round(list_reduce(list_prepend(0.0::DOUBLE, xs), lambda a, x: (a + x) / 2), 6) AS average FROM l")
def metric_halving(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.halving(_samples(spark, d)).select("series", F.round("average", 6).alias("average"))


def _percentile(q: float) -> str:
    return f"WITH {SAMPLES}, l AS (SELECT series, list_sort(list(x)) AS xs FROM samples GROUP BY series) SELECT series, xs[CAST(least(floor(len(xs) * {q}), len(xs) - 1) AS BIGINT) + 1] AS value FROM l"


@query(_percentile(0.95))
def metric_p95_nearest(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.percentile_floor(_samples(spark, d), 0.95)


@query(_percentile(0.99))
def metric_p99_nearest(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.percentile_floor(_samples(spark, d), 0.99)


@query("SELECT round(100.0 * avg(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END), 6) AS rate, count(*) AS n FROM events")
def metric_success_rate(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.success_rate(adapters.table(spark, d, "events"), F.col("event_type") != "error").select(F.round("rate", 6).alias("rate"), "n")


_HEALTH = "round(least(1e0, greatest(0e0, 4e-1 * CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END + 25e-2 * greatest(0e0, 1 - value / 1e3) + 15e-2 * least(1e0, (event_id % 5000) / 36e2) + 15e-2 * greatest(0e0, 1 - (event_id % 400) / 3e2) + 5e-2 * (1e0 / (1 + event_id % 3)))), 9)"


@query(f"SELECT event_id, CAST({_HEALTH} AS DOUBLE) AS health FROM events")
def metric_health(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    score = telemetry.health_score((F.col("event_type") != "error").cast("int"), F.col("value"), n % 5000, n % 400, n % 3)
    return adapters.table(spark, d, "events").select("event_id", F.round(score.cast("double"), 9).alias("health"))


@query("SELECT user_id AS node, round(100.0 * CASE WHEN count(*) = 0 THEN 0 ELSE sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*) END, 6) AS percent FROM events GROUP BY user_id")
def metric_replication_percent(spark: SparkSession, d: str) -> DataFrame:
    counted = adapters.table(spark, d, "events").groupBy(F.col("user_id").alias("node")).agg(F.sum((F.col("event_type") == "purchase").cast("int")).alias("done"), F.count(F.lit(1)).alias("all"))
    return counted.select("node", F.round(telemetry.percentage(F.col("done"), F.col("all")), 6).alias("percent"))


@query("WITH s AS (SELECT event_id AS key, 0.4 * (event_id % 97) + 0.3 / (event_id % 7 + 1) + 0.3 * (10 - event_id % 10) AS score FROM events), r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, key) AS n, count(*) OVER () AS total FROM s) SELECT key, CAST(round(score, 6) AS DOUBLE) AS score FROM r WHERE n <= ceil(0.2 * total)")
def cache_evict_top20(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    items = adapters.table(spark, d, "events").select(n.alias("key"), (n % 97).cast("double").alias("age"), (n % 7).alias("uses"), (n % 10).alias("priority"))
    score = F.round(telemetry.eviction_score(F.col("age"), F.col("uses"), F.col("priority")).cast("double"), 9)
    return telemetry.evicted(items, score).select("key", F.round("score", 6).alias("score"))


@query("WITH b AS (SELECT user_id, event_id // 10 AS batch, count(*) AS n_ops FROM events GROUP BY 1, 2) SELECT CAST(sum(n_ops) AS BIGINT) AS n_ops, round(CAST(sum(CASE WHEN n_ops > 1 THEN n_ops ELSE 0 END) AS DOUBLE) / sum(n_ops), 6) AS efficiency FROM b")
def batch_efficiency(spark: SparkSession, d: str) -> DataFrame:
    batches = adapters.table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 10).alias("batch")).agg(F.count(F.lit(1)).alias("n_ops"))
    return telemetry.batch_efficiency(batches).select("n_ops", F.round("efficiency", 6).alias("efficiency"))


@query("SELECT event_id AS seq, event_id % 10 AS priority FROM events ORDER BY event_id % 10 DESC, event_id LIMIT 50")
def batch_priority(spark: SparkSession, d: str) -> DataFrame:
    queue = adapters.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("event_id") % 10).alias("priority"))
    return telemetry.priority_batch(queue, 50)


@query("SELECT event_type, count(*) AS n_messages, max(event_id) AS last FROM events GROUP BY event_type")
def batch_by_topic(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n_messages"), F.max("event_id").alias("last"))


@query(f"{_ORDERED} SELECT series, seq, x FROM o WHERE back < 20")
def history_bounded(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.bounded_history(_samples(spark, d), 20)


@query("SELECT series, x FROM (SELECT event_type AS series, value AS x, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events) t WHERE n = 1")
def metric_gauges(spark: SparkSession, d: str) -> DataFrame:
    return telemetry.last_value(_samples(spark, d), "series", "x", "seq")


@query("WITH c AS (SELECT a.role AS a, b.role AS b FROM (SELECT DISTINCT role FROM conversations) a CROSS JOIN (SELECT DISTINCT role FROM conversations) b) SELECT a, b, least(a, b) || '/' || greatest(a, b) AS channel, sha256(least(a, b) || greatest(a, b)) AS topic FROM c")
def channel_id(spark: SparkSession, d: str) -> DataFrame:
    roles = adapters.table(spark, d, "conversations").select("role").distinct()
    pairs = roles.agg(F.collect_set("role").alias("all")).select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b"))
    return pairs.select("a", "b", keys.channel_id(F.col("a"), F.col("b")).alias("channel"), keys.channel_topic(F.col("a"), F.col("b")).alias("topic"))


@query("SELECT conv_id, count(*) AS n_messages, CAST(max(turn) AS BIGINT) AS last_turn FROM conversations GROUP BY conv_id")
def channel_activity(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").cast("long").alias("last_turn"))


@query("SELECT doc_id, '/store/' || sha256(CAST(doc_id AS VARCHAR)) || '/' || source AS address, sha256(CAST(doc_id AS VARCHAR)) AS root, source AS path, true AS valid FROM documents")
def address_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    made = adapters.table(spark, d, "documents").select("doc_id", keys.address(F.sha2(F.col("doc_id").cast("string"), 256), F.col("source")).alias("address"))
    parsed = keys.parsed_address(F.col("address"))
    return made.select("doc_id", "address", parsed["root"].alias("root"), parsed["path"].alias("path"), keys.is_address(F.col("address")).alias("valid"))


_NAMES = "CASE doc_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' list ' WHEN 2 THEN 'a/../b' WHEN 3 THEN 'a//b' WHEN 4 THEN repeat('x', 1001) ELSE 'a/b/' END"


@query(f"WITH n AS (SELECT doc_id, {_NAMES} AS a FROM documents) SELECT doc_id, trim(a) <> '' AND strlen(trim(a)) <= 1000 AND NOT contains(a, '..') AND NOT contains(a, '//') AS valid, CASE WHEN ends_with(trim(a), '/') THEN trim(a) || '_access' ELSE trim(a) || '/_access' END AS access FROM n")
def address_acl(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id") % 6
    name = F.when(n == 0, "").when(n == 1, " list ").when(n == 2, "a/../b").when(n == 3, "a//b").when(n == 4, "x" * 1001).otherwise("a/b/")
    named = adapters.table(spark, d, "documents").select("doc_id", name.alias("a"))
    return named.select("doc_id", keys.is_acl_address(F.col("a")).alias("valid"), keys.access_address(F.col("a")).alias("access"))


@query("SELECT event_id, 'u' || user_id AS key, 'PUT' AS op, props AS value FROM events")
def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Operations packed as entries carry them, and read again."""
    packed = adapters.table(spark, d, "events").select("event_id", codec.packed(codec.operation(F.concat(F.lit("u"), F.col("user_id")), F.lit("PUT"), F.col("props"))).alias("payload"))
    return packed.select("event_id", codec.unpacked(F.col("payload")).alias("x")).select("event_id", "x.key", "x.op", "x.value")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'timeout' WHEN 'click' THEN 'network' WHEN 'view' THEN 'not_found' ELSE 'other' END AS kind, event_type IN ('error', 'click') AS recoverable FROM events")
def error_classes(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    message = F.when(kind == "error", "request timed out").when(kind == "click", "Connection refused").when(kind == "view", "blob not found").otherwise("bad input")
    return adapters.table(spark, d, "events").select("event_id", codec.error_class(message).alias("kind")).select("event_id", "kind", codec.is_recoverable(F.col("kind")).alias("recoverable"))
