"""Queries on access lists and on taking in entries and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import acl, sync
from tidelog.plans.registry import ACL, EVENT_LOG, MESSAGES, query
from tidelog.sources import adapters


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return adapters.table(spark, d, "customer").select(F.col("c_custkey").alias("request"), F.col("c_custkey").cast("string").alias("pub_key"))


_REQUESTS = "req AS (SELECT c_custkey AS request, CAST(c_custkey AS VARCHAR) AS pub_key FROM customer)"


@query(f"WITH {ACL}, {_REQUESTS} SELECT request FROM req WHERE pub_key IN (SELECT key FROM acl WHERE role = 'write')")
def acl_can_write(spark: SparkSession, d: str) -> DataFrame:
    return acl.allowed(_requests(spark, d), adapters.acl(spark, d), ["write"], ["pub_key"]).select("request")


@query(f"WITH {ACL}, {_REQUESTS} SELECT request FROM req WHERE pub_key IN (SELECT key FROM acl WHERE role IN ('write', 'admin'))")
def acl_can_append(spark: SparkSession, d: str) -> DataFrame:
    return acl.allowed(_requests(spark, d), adapters.acl(spark, d), ["write", "admin"], ["pub_key"]).select("request")


@query(f"WITH {ACL}, {_REQUESTS} SELECT request FROM req WHERE pub_key IN (SELECT key FROM acl WHERE role = 'read')")
def acl_can_read(spark: SparkSession, d: str) -> DataFrame:
    return acl.can_read(_requests(spark, d), adapters.acl(spark, d)).select("request")


@query(f"WITH {_REQUESTS} SELECT request FROM req")
def acl_wildcard(spark: SparkSession, d: str) -> DataFrame:
    """A list that is open to anyone."""
    grants = adapters.acl(spark, d).where("role != 'write'").unionByName(spark.createDataFrame([("write", "*")], "role string, key string"))
    return acl.allowed(_requests(spark, d), grants, ["write"], ["pub_key"]).select("request")


@query(f"WITH {ACL} SELECT role, key FROM acl UNION SELECT 'admin', key FROM acl WHERE role = 'write'")
def acl_effective_admin(spark: SparkSession, d: str) -> DataFrame:
    return acl.effective(adapters.acl(spark, d))


@query(f"WITH {ACL} SELECT role, key FROM acl UNION SELECT 'write', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 10 = 0")
def acl_grant(spark: SparkSession, d: str) -> DataFrame:
    new = adapters.table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.lit("write").alias("role"), F.col("c_custkey").cast("string").alias("key"))
    blank = spark.createDataFrame([("write", "")], "role string, key string")
    return acl.granted(adapters.acl(spark, d), new.unionByName(blank))


@query(f"WITH {ACL} SELECT role, key FROM acl WHERE NOT (role = 'read' AND CAST(key AS BIGINT) % 2 = 0)")
def acl_revoke(spark: SparkSession, d: str) -> DataFrame:
    gone = adapters.table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.lit("read").alias("role"), F.col("c_custkey").cast("string").alias("key"))
    return acl.revoked(adapters.acl(spark, d), gone)


@query(f"WITH {ACL} SELECT role, count(DISTINCT key) AS n_keys FROM acl GROUP BY role")
def acl_stats(spark: SparkSession, d: str) -> DataFrame:
    return acl.stats(adapters.acl(spark, d))


@query(f"WITH {ACL} SELECT role, array_to_string(list(DISTINCT key ORDER BY key), ',') AS keys FROM acl GROUP BY role")
def acl_by_role(spark: SparkSession, d: str) -> DataFrame:
    return acl.by_role(adapters.acl(spark, d)).select("role", F.array_join("keys", ",").alias("keys"))


@query(f"WITH {ACL} SELECT role, key FROM acl WHERE role <> 'admin' UNION SELECT 'admin', key FROM acl WHERE role = 'write'")
def acl_clone(spark: SparkSession, d: str) -> DataFrame:
    return acl.to_grants(acl.cloned(acl.by_role(adapters.acl(spark, d)), "write", "admin"))


def _incoming(spark: SparkSession, d: str) -> DataFrame:
    """Entries as another replica sends them: some without hash, payload or identity."""
    log = adapters.event_log(spark, d)
    n = F.col("event_id")
    return log.select(
        F.when(n % 11 == 0, "0" * 64).otherwise(F.col("hash")).alias("hash"), F.when(n % 13 == 0, "").otherwise(F.col("payload")).alias("payload"), F.lit("events").alias("log_id"),
        F.when(n % 17 == 0, None).otherwise(F.col("clock_id")).alias("identity_id"), F.concat(F.lit("k"), F.col("clock_id")).alias("pub_key"), n.alias("event_id"),
    )


_INCOMING = EVENT_LOG + f", inc AS (SELECT CASE WHEN event_id % 11 = 0 THEN repeat('0', 64) ELSE hash END AS hash, CASE WHEN event_id % 13 = 0 THEN '' ELSE payload END AS payload, CASE WHEN event_id % 17 = 0 THEN NULL ELSE clock_id END AS identity_id, 'k' || clock_id AS pub_key, event_id FROM elog), {ACL}, known AS (SELECT hash FROM elog WHERE event_id % 3 = 0)"


def _known(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_log(spark, d).where("event_id % 3 = 0")


@query(f"WITH {_INCOMING} SELECT hash, event_id FROM inc WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND identity_id IS NOT NULL AND identity_id IN (SELECT key FROM acl WHERE role = 'write') AND hash NOT IN (SELECT hash FROM known)")
def sync_accept(spark: SparkSession, d: str) -> DataFrame:
    return sync.accepted_facade(_incoming(spark, d), _known(spark, d), adapters.acl(spark, d)).select("hash", "event_id")


@query(f"WITH {_INCOMING} SELECT hash, event_id FROM inc WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND identity_id IN (SELECT key FROM acl WHERE role IN ('write', 'admin')) AND hash NOT IN (SELECT hash FROM known)")
def sync_accept_store(spark: SparkSession, d: str) -> DataFrame:
    """The store lets admins append as well."""
    return sync.accepted_store(_incoming(spark, d), _known(spark, d), adapters.acl(spark, d)).select("hash", "event_id")


@query(f"WITH {_INCOMING} SELECT CASE WHEN event_id % 11 = 0 THEN 'zero hash' WHEN event_id % 13 = 0 THEN 'empty payload' WHEN identity_id IS NULL THEN 'no identity' WHEN identity_id NOT IN (SELECT key FROM acl WHERE role = 'write') THEN 'not authorised' WHEN hash IN (SELECT hash FROM known) THEN 'already known' ELSE 'accepted' END AS reason, count(*) AS n FROM inc GROUP BY 1")
def sync_reject_reason(spark: SparkSession, d: str) -> DataFrame:
    return sync.rejection(_incoming(spark, d), _known(spark, d), adapters.acl(spark, d)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY version DESC, message_id DESC) AS n FROM msg) SELECT key_id, version, operation FROM r WHERE n = 1")
def keysync_latest_version(spark: SparkSession, d: str) -> DataFrame:
    return sync.latest_versions(adapters.key_messages(spark, d))


_TURNED = "t AS (SELECT message_id, key_id, CASE WHEN message_id % 5 = 0 THEN version - 3 ELSE version END AS version, operation FROM msg), s AS (SELECT *, max(version) OVER (PARTITION BY key_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM t)"


@query(f"WITH {MESSAGES}, {_TURNED} SELECT message_id, key_id, version, seen FROM s WHERE operation = 'Update' AND seen > version")
def keysync_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Some messages bring an older version than what is there."""
    messages = adapters.key_messages(spark, d).withColumn("version", F.when(F.col("message_id") % 5 == 0, F.col("version") - 3).otherwise(F.col("version")))
    return sync.conflicts(messages).select("message_id", "key_id", "version", "seen")


@query(f"WITH {MESSAGES}, m AS (SELECT max(ts) AS top FROM msg) SELECT message_id FROM msg, m WHERE epoch(top) - epoch(ts) BETWEEN 0 AND 3600")
def keysync_fresh(spark: SparkSession, d: str) -> DataFrame:
    """Messages of the last hour before the newest one."""
    messages = adapters.key_messages(spark, d)
    top = messages.agg(F.max("ts").alias("top"))
    return sync.fresh(messages.join(F.broadcast(top)), F.col("top"), 3600).select("message_id")


@query(f"WITH {MESSAGES} SELECT key_id AS message_id, CAST(min(message_id) AS BIGINT) AS first FROM msg GROUP BY key_id")
def keysync_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Messages of one key stand for repeated ones: the earliest stays."""
    messages = adapters.key_messages(spark, d).select(F.col("key_id").alias("message_id"), F.col("message_id").alias("first"))
    return sync.first_of_each(messages, "message_id", "first")


@query("WITH a AS (SELECT DISTINCT user_id || '/' || (event_id // 100) AS peer FROM events WHERE event_type = 'signup'), b AS (SELECT DISTINCT user_id || '/' || (event_id // 100) AS peer FROM events WHERE event_type = 'purchase') SELECT coalesce(a.peer, b.peer) AS peer, CASE WHEN a.peer IS NULL THEN 'joined' ELSE 'left' END AS change FROM a FULL OUTER JOIN b ON a.peer = b.peer WHERE a.peer IS NULL OR b.peer IS NULL")
def members_diff(spark: SparkSession, d: str) -> DataFrame:
    """A user in each hundred events stands for a peer."""
    of = lambda kind: adapters.table(spark, d, "events").where(F.col("event_type") == kind).select(F.concat("user_id", F.lit("/"), F.floor(F.col("event_id") / 100)).alias("peer"))
    return sync.membership_changes(of("signup"), of("purchase"))


_BREAKER = """WITH o AS (SELECT user_id AS node, event_id AS seq, event_type NOT IN ('error', 'view') AS ok FROM events),
l AS (SELECT node, coalesce(max(CASE WHEN ok THEN seq END), -1) AS last_ok FROM o GROUP BY node)
SELECT node, CASE WHEN count(*) FILTER (WHERE seq > last_ok) >= 5 THEN 'open' ELSE 'closed' END AS mode, count(*) FILTER (WHERE seq > last_ok) AS failures FROM o JOIN l USING (node) GROUP BY node"""


@query(_BREAKER)
def breaker_state(spark: SparkSession, d: str) -> DataFrame:
    outcomes = adapters.table(spark, d, "events").select(F.col("user_id").alias("node"), F.col("event_id").alias("seq"), (~F.col("event_type").isin("error", "view")).alias("ok"))
    return sync.breaker(outcomes)
