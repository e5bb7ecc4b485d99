"""Taking in entries and keys from other replicas: validity, authorisation, deduplication, versions, membership."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.operators.acl import allowed
from tidelog.operators.running import before_each

MOST_AGE_S = 300
#: Breaker settings: failures that open it, successes that close it half-open.
OPENS_AFTER, CLOSES_AFTER = 5, 3


def _some(name: str) -> Column:
    return F.coalesce(F.octet_length(name), F.lit(0)) > 0


def well_formed(entries: DataFrame) -> DataFrame:
    """Entries with a hash that isn't all zero, and with a payload."""
    return entries.where(_some("hash") & ~F.col("hash").rlike("^0+$") & _some("payload"))


def accepted_store(entries: DataFrame, log: DataFrame, grants: DataFrame) -> DataFrame:
    """New entries that the store takes: well formed, their writer's id granted write or admin, and not in the log."""
    return allowed(well_formed(entries), grants, ["write", "admin"], ["identity_id"]).join(log.select("hash"), "hash", "left_anti")


def accepted_facade(entries: DataFrame, log: DataFrame, grants: DataFrame) -> DataFrame:
    """New entries that the facade takes: an identity with id and key, one of them granted write; an admin alone isn't."""
    whole = well_formed(entries).where(_some("log_id") & _some("identity_id") & _some("pub_key"))
    return allowed(whole, grants, ["write"], ["pub_key", "identity_id"]).join(log.select("hash"), "hash", "left_anti")


def rejection(entries: DataFrame, log: DataFrame, grants: DataFrame) -> DataFrame:
    """hash and reason for each entry: the first check that fails, or accepted."""
    writer = allowed(entries, grants, ["write"], ["pub_key", "identity_id"]).select(F.col("hash").alias("h1_")).distinct()
    known = log.select(F.col("hash").alias("h2_")).distinct()
    marked = entries.join(writer, F.col("hash") == F.col("h1_"), "left").join(known, F.col("hash") == F.col("h2_"), "left")
    reason = (
        F.when(~_some("hash") | F.col("hash").rlike("^0+$"), "zero hash").when(~_some("payload"), "empty payload").when(~_some("log_id"), "no log id")
        .when(~_some("identity_id") | ~_some("pub_key"), "no identity").when(F.col("h1_").isNull(), "not authorised").when(F.col("h2_").isNotNull(), "already known").otherwise("accepted")
    )
    return marked.select("hash", reason.alias("reason"))


def fresh(messages: DataFrame, now: Column, most_age_s: int = MOST_AGE_S) -> DataFrame:
    """Messages that are neither from the future nor too old, by ages to the microsecond. Times without a zone are compared
    as they stand, whatever the session's zone."""
    if messages.schema["ts"].dataType.typeName() == "timestamp_ntz":
        return messages.where((now.cast("timestamp_ntz") - F.col("ts")).between(F.lit(timedelta()), F.lit(timedelta(seconds=most_age_s))))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return messages.where(age.between(0, most_age_s * 1_000_000))


def first_of_each(messages: DataFrame, id_: str = "message_id", order: str = "ts") -> DataFrame:
    """Each message once: the earliest."""
    names = [c for c in messages.columns if c != id_]
    return messages.groupBy(id_).agg(F.min_by(F.struct(*names), order).alias("m_")).select(id_, "m_.*").select(*messages.columns)


def latest_versions(messages: DataFrame) -> DataFrame:
    """key_id, version, operation: the greatest version of each key; of equal versions the later message."""
    top = messages.groupBy("key_id").agg(F.max_by(F.struct("version", "operation"), F.struct("version", "message_id")).alias("v_"))
    return top.select("key_id", "v_.version", "v_.operation")


def conflicts(messages: DataFrame) -> DataFrame:
    """Updates whose key already had a greater version when they came."""
    seen = before_each(messages, ["key_id"], "message_id", F.max, F.col("version"), F.greatest).withColumnRenamed("before_", "seen")
    return seen.where((F.col("operation") == "Update") & (F.col("seen") > F.col("version")))


def membership_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """peer and change: joined or left."""
    a, b = before.select("peer").distinct().withColumn("was_", F.lit(True)), after.select("peer").distinct().withColumn("is_", F.lit(True))
    both = a.join(b, "peer", "full_outer").where("was_ is null or is_ is null")
    return both.select("peer", F.when(F.col("was_").isNull(), "joined").otherwise("left").alias("change"))


def sync_state(processed: Column, total: Column) -> Column:
    return F.when((total > 0) & (processed >= total), "Completed").when(processed > 0, "Replicating").otherwise("Loading")


def breaker_step(state: Column, ok: Column) -> Column:
    """The breaker after one outcome: struct(mode, failures, successes). Closed, it opens after OPENS_AFTER failures in a
    row; half-open, it closes after CLOSES_AFTER successes and opens at a failure; open, a success closes it at once."""
    make = lambda mode, f, s: F.struct(F.lit(mode).alias("mode") if isinstance(mode, str) else mode.alias("mode"), f.cast("int").alias("failures"), s.cast("int").alias("successes"))
    zero, one = F.lit(0), F.lit(1)
    on_ok = (
        F.when(state["mode"] == "closed", make("closed", zero, state["successes"] + one)).when(state["mode"] == "open", make("closed", zero, zero))
        .when(state["successes"] + 1 >= CLOSES_AFTER, make("closed", zero, zero)).otherwise(make("half_open", zero, state["successes"] + one))
    )
    on_fail = F.when((state["mode"] != "closed") | (state["failures"] + 1 >= OPENS_AFTER), make("open", state["failures"] + one, zero)).otherwise(make("closed", state["failures"] + one, zero))
    return F.when(ok, on_ok).otherwise(on_fail)


def breaker(outcomes: DataFrame) -> DataFrame:
    """node, mode and failures after all outcomes (node, seq, ok) in order. From a closed start breaker_step never comes to
    half-open, and a success closes, so the state follows from the number of failures after a node's last success."""
    ok = F.coalesce("ok", F.lit(False))
    last = outcomes.groupBy(F.col("node").alias("of_")).agg(F.max(F.when(ok, F.col("seq"))).alias("last_"))
    after = ~ok & (F.col("last_").isNull() | (F.col("seq") > F.col("last_")))
    counted = outcomes.join(last, F.col("node").eqNullSafe(F.col("of_"))).groupBy("node").agg(F.count(F.when(after, 1)).alias("failures"))
    return counted.select("node", F.when(F.col("failures") >= OPENS_AFTER, "open").otherwise("closed").alias("mode"), "failures")
