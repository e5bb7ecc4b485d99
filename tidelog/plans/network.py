"""Queries on fields of messages and identities, signatures, channels, queues and connections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import fields, signing
from tidelog.operators import network
from tidelog.plans.registry import query
from tidelog.sources import adapters


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "events")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type END AS strict_text, CASE WHEN event_id % 4 = 0 THEN event_type || chr(65533) ELSE event_type END AS lossy_text FROM events")
def payload_text(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth payload ends in a byte that isn't UTF-8."""
    data = F.concat(F.encode("event_type", "utf-8"), F.when(F.col("event_id") % 4 == 0, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    return _events(spark, d).select("event_id", fields.strict_text(data).alias("strict_text"), fields.lossy_text(data).alias("lossy_text"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS size FROM events")
def message_size(spark: SparkSession, d: str) -> DataFrame:
    """Every third size isn't a number, shown as -1."""
    text = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 3 == 0, " B").otherwise(""))
    return _events(spark, d).select("event_id", F.coalesce(fields.size_of(text), F.lit(-1)).alias("size"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN NULL ELSE sha256(CAST(event_id AS VARCHAR)) END AS pub_key, CAST((CASE WHEN event_id % 5 = 0 THEN 0 ELSE 1 END) + 1 AS INTEGER) AS n_signatures, event_id % 5 <> 0 AS listed FROM events")
def identity_fields(spark: SparkSession, d: str) -> DataFrame:
    """Keys of which every fifth isn't hexadecimal and every seventh is a byte short."""
    n = F.col("event_id")
    key = F.sha2(n.cast("string"), 256)
    text = F.when(n % 5 == 0, F.concat(F.lit("zz"), key)).when(n % 7 == 0, F.substring(key, 3, 62)).otherwise(key)
    found = fields.signatures(key, text)
    return _events(spark, d).select("event_id", F.lower(F.hex(fields.public_key(text))).alias("pub_key"), F.size(found).alias("n_signatures"), fields.hex_list(F.array(key, text)).isNotNull().alias("listed"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Loading' WHEN 1 THEN 'Loading' WHEN 2 THEN 'Completed' WHEN 3 THEN 'Replicating' ELSE 'Failed' END AS state FROM events")
def sync_event_state(spark: SparkSession, d: str) -> DataFrame:
    event = F.get(F.array(*map(F.lit, fields.STATES)), (F.col("event_id") % 5).cast("int"))
    return _events(spark, d).select("event_id", fields.event_state(event).alias("state"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2000 BETWEEN 1 AND 1023 THEN 'port' WHEN c_custkey % 3 = 0 THEN 'path' WHEN c_custkey % 4 = 0 THEN 'cache' END AS error FROM customer")
def config_check(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_custkey")
    return adapters.table(spark, d, "customer").select(n, fields.config_error(n % 2000, F.when(n % 3 == 0, "").when(n % 3 == 1, "/data"), n % 4).alias("error"))


@query("SELECT a.doc_id, a.source = b.source AND a.lang IS NOT DISTINCT FROM b.lang AS same FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1")
def address_equality(spark: SparkSession, d: str) -> DataFrame:
    """Each document's address with the next one's: source as root, lang as path."""
    docs = adapters.table(spark, d, "documents")
    other = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("source").alias("root_"), F.col("lang").alias("path_"))
    return docs.join(other, "doc_id").select("doc_id", fields.same_address(F.col("source"), F.col("lang"), F.col("root_"), F.col("path_")).alias("same"))


@query("SELECT s_suppkey, s_suppkey % 4 <> 3 AS trusted, s_suppkey % 4 = 0 AS valid FROM supplier")
def signature_check(spark: SparkSession, d: str) -> DataFrame:
    """Signed messages: of four, one is valid, one changed on its way, one malformed, and one from an unknown sender."""
    n, body = F.col("s_suppkey"), F.encode("s_name", "utf-8")
    made = adapters.table(spark, d, "supplier").select(n, body.alias("body"), signing.signed(F.unhex(F.sha2(n.cast("string"), 256)), body).alias("s_"))
    sent = made.select(
        n, n.alias("sender"), F.col("s_.key").alias("key"), F.when(n % 4 == 1, F.concat("body", F.encode(F.lit("!"), "utf-8"))).otherwise(F.col("body")).alias("body"),
        F.when(n % 4 == 2, F.substring("s_.signature", 1, 63)).otherwise(F.col("s_.signature")).alias("signature"),
    )
    return network.verified(sent, made.where(n % 4 != 3).select(n.alias("sender"))).select("s_suppkey", "trusted", "valid")


_KINDS = {"signup": "connected", "error": "timeout", "purchase": "heartbeat"}


@query(
    "WITH e AS (SELECT user_id AS peer, event_id AS seq, CASE WHEN event_id % 40 = 0 THEN 'disconnected' WHEN event_type = 'signup' THEN 'connected' WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'purchase' THEN 'heartbeat' ELSE 'message' END AS kind, event_id % 100 AS bytes FROM events), "
    "s AS (SELECT * FROM e WHERE kind <> 'message' OR bytes <= 90) SELECT peer, CASE arg_max(kind, seq) FILTER (WHERE kind IN ('connected', 'disconnected', 'timeout')) WHEN 'timeout' THEN 'error' ELSE arg_max(kind, seq) FILTER (WHERE kind IN ('connected', 'disconnected', 'timeout')) END AS status, "
    "count(*) FILTER (WHERE kind = 'message') AS messages, max(seq) FILTER (WHERE kind IN ('message', 'connected', 'heartbeat')) AS last_activity, max(seq) FILTER (WHERE kind IN ('connected', 'heartbeat')) AS last_heartbeat FROM s GROUP BY peer"
)
def channel_states(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 40 == 0, "disconnected")
    for name, what in _KINDS.items():
        kind = kind.when(F.col("event_type") == name, what)
    events = _events(spark, d).select(F.col("user_id").alias("peer"), F.col("event_id").alias("seq"), kind.otherwise("message").alias("kind"), (F.col("event_id") % 100).alias("bytes"))
    return network.channel_states(events, 90)


_OPS = {"view": "Get", "click": "Add", "purchase": "Pin", "signup": "Unpin", "error": "PubSubPublish"}
_OPS_SQL = "o AS (SELECT event_id AS seq, CASE event_type WHEN 'view' THEN 'Get' WHEN 'click' THEN 'Add' WHEN 'purchase' THEN 'Pin' WHEN 'signup' THEN 'Unpin' WHEN 'error' THEN 'PubSubPublish' END AS kind, CASE event_type WHEN 'view' THEN 'get' WHEN 'click' THEN 'add' WHEN 'error' THEN 'pubsub' ELSE 'pin' END AS queue, CASE event_type WHEN 'view' THEN 50 WHEN 'click' THEN 25 WHEN 'error' THEN 16 END AS size FROM events)"


def _ops(spark: SparkSession, d: str) -> DataFrame:
    kind = F.lit(None).cast("string")
    for name, op in _OPS.items():
        kind = F.when(F.col("event_type") == name, op).otherwise(kind)
    return _events(spark, d).select(F.col("event_id").alias("seq"), kind.alias("kind"))


@query(f"WITH {_OPS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY seq) - 1 AS n, count(*) OVER (PARTITION BY queue) AS length FROM o) SELECT seq, kind, queue, CAST(coalesce(n // size, -1) AS BIGINT) AS batch, coalesce((n // size + 1) * size <= length, false) AS flushed FROM n")
def batch_typed(spark: SparkSession, d: str) -> DataFrame:
    """Queues that are never cut have batch -1."""
    return network.typed_batches(_ops(spark, d), 100).withColumn("batch", F.coalesce("batch", F.lit(-1).cast("long")))


@query(f"WITH {_OPS_SQL} SELECT queue FROM o GROUP BY queue HAVING (SELECT max(seq) FROM o) - min(seq) > 2 * 50")
def batch_overdue(spark: SparkSession, d: str) -> DataFrame:
    """Operations are a millisecond apart."""
    ops = _ops(spark, d)
    now = ops.agg(F.max("seq").alias("now")).first()["now"]
    return network.overdue(network.typed_batches(ops, 100).select("queue", F.col("seq").alias("created")), F.lit(now), 50)


_CONNECTIONS = "c AS (SELECT user_id AS peer, max(event_id) AS last_used, avg(value) AS latency, bool_or(event_type = 'purchase') AS in_use, NOT bool_or(event_type = 'error') AS healthy FROM events GROUP BY user_id)"


def _connections(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    return _events(spark, d).groupBy(F.col("user_id").alias("peer")).agg(F.max("event_id").alias("last_used"), F.avg("value").alias("latency"), F.bool_or(kind == "purchase").alias("in_use"), (~F.bool_or(kind == "error")).alias("healthy"))


@query(f"WITH {_CONNECTIONS} SELECT peer, last_used FROM c WHERE (SELECT max(event_id) FROM events) - last_used > 20")
def connections_stale(spark: SparkSession, d: str) -> DataFrame:
    own = _connections(spark, d)
    now = own.agg(F.max("last_used").alias("now")).first()["now"]
    return network.stale(own, F.lit(now), 20).select("peer", "last_used")


@query(f"WITH {_CONNECTIONS} SELECT count(*) AS total, count(*) FILTER (WHERE in_use) AS in_use, count(*) FILTER (WHERE healthy) AS healthy, round(avg(latency), 6) AS latency FROM c")
def pool_stats(spark: SparkSession, d: str) -> DataFrame:
    return network.pool_stats(_connections(spark, d)).withColumn("latency", F.round("latency", 6))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE NOT cancelled) AS active FROM (SELECT user_id, bool_or(event_type = 'error') AS cancelled FROM events GROUP BY user_id) t")
def topic_stats(spark: SparkSession, d: str) -> DataFrame:
    """A user stands for a topic, an error for its end."""
    return network.topic_stats(_events(spark, d).groupBy("user_id").agg(F.bool_or(F.col("event_type") == "error").alias("cancelled")))


@query("SELECT user_id AS node, bool_and(event_type <> 'error' OR value < 50) AS healthy FROM events GROUP BY user_id")
def node_health(spark: SparkSession, d: str) -> DataFrame:
    checks = _events(spark, d).select(F.col("user_id").alias("node"), ((F.col("event_type") != "error") | (F.col("value") < 50)).alias("passed"))
    return network.health(checks)
