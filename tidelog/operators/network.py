"""State of channels, connections, topics and queues, folded from rows of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.signing import is_signed
from tidelog.operators.log import _numbered

MOST_MESSAGE_BYTES = 1 << 20
#: The queue of each kind of operation, and the part of the greatest batch at which a queue is flushed. Pins are queued only.
QUEUES = {"Add": "add", "Get": "get", "Pin": "pin", "Unpin": "pin", "PubSubPublish": "pubsub"}
PARTS = {"add": 4, "get": 2, "pubsub": 6}


def channel_states(events: DataFrame, most_bytes: int = MOST_MESSAGE_BYTES) -> DataFrame:
    """peer, status, messages, last_activity, last_heartbeat after all events (peer, seq, kind, bytes): kind is connected,
    disconnected, timeout, heartbeat or message. A message that is too long changes nothing."""
    kind = F.col("kind")
    seen = events.where((kind != "message") | (F.col("bytes") <= most_bytes))
    status = F.when(kind == "connected", "connected").when(kind == "disconnected", "disconnected").when(kind == "timeout", "error")
    moment = lambda *kinds: F.max(F.when(kind.isin(*kinds), F.col("seq")))
    return seen.groupBy("peer").agg(
        F.max_by(status, F.when(status.isNotNull(), F.col("seq"))).alias("status"), F.count(F.when(kind == "message", 1)).alias("messages"),
        moment("message", "connected", "heartbeat").alias("last_activity"), moment("connected", "heartbeat").alias("last_heartbeat"),
    )


def typed_batches(ops: DataFrame, most: int) -> DataFrame:
    """ops (seq, kind) with queue, batch and flushed: each queue is cut into batches of its part of most, in order of
    arrival; those that are full are flushed."""
    queue, size = F.lit(None).cast("string"), F.lit(None).cast("int")
    for kind, name in QUEUES.items():
        queue = F.when(F.col("kind") == kind, name).otherwise(queue)
    for name, part in PARTS.items():
        size = F.when(F.col("log_id") == name, max(1, most // part)).otherwise(size)
    placed = _numbered(ops.withColumn("log_id", queue).where("log_id is not null")).withColumn("size_", size)
    batch = F.floor((F.col("n_") - 1) / F.col("size_"))
    batched = placed.withColumn("batch", batch)
    lengths = placed.groupBy("log_id").agg(F.max("n_").alias("length_"))
    full = F.coalesce((F.col("batch") + 1) * F.col("size_") <= F.col("length_"), F.lit(False))
    return batched.join(F.broadcast(lengths), "log_id").select("seq", "kind", F.col("log_id").alias("queue"), "batch", full.alias("flushed"))  # a row a queue


def overdue(queues: DataFrame, now: Column, most_wait_ms: int) -> DataFrame:
    """The queues whose oldest operation (created, in ms) has waited for over twice the longest wait."""
    oldest = queues.groupBy("queue").agg(F.min("created").alias("oldest"))
    return oldest.where(now - F.col("oldest") > 2 * most_wait_ms).select("queue")


def stale(connections: DataFrame, now: Column, most_idle: int) -> DataFrame:
    """Connections that were not used for longer than most_idle."""
    return connections.where(now - F.col("last_used") > most_idle)


def topic_stats(topics: DataFrame) -> DataFrame:
    """How many topics there are, and how many aren't cancelled."""
    return topics.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~F.col("cancelled"), 1)).alias("active"))


def pool_stats(connections: DataFrame) -> DataFrame:
    """Connections in all, in use and healthy, and their mean latency."""
    return connections.agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("in_use"), 1)).alias("in_use"), F.count(F.when(F.col("healthy"), 1)).alias("healthy"), F.avg("latency").alias("latency"))


def health(checks: DataFrame) -> DataFrame:
    """Whether all checks (name, passed) of a node pass."""
    return checks.groupBy("node").agg(F.bool_and("passed").alias("healthy"))


def verified(messages: DataFrame, trusted: DataFrame) -> DataFrame:
    """messages (sender, key, body, signature) with trusted and valid: a signature counts only from a trusted sender, whose
    key is looked at before anything is verified."""
    known = trusted.select(F.col("sender").alias("sender_"), F.lit(True).alias("trusted_")).distinct()
    marked = messages.join(known, F.col("sender") == F.col("sender_"), "left").withColumn("trusted", F.coalesce("trusted_", F.lit(False)))
    # A null key is malformed, so nothing is computed for those that aren't trusted.
    valid = is_signed(F.when(F.col("trusted"), F.col("key")), F.col("body"), F.col("signature"))
    return marked.withColumn("valid", valid).drop("sender_", "trusted_")
