"""Streams over small folders."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidelog.sources.store import OpLogTable
from tidelog.streaming import replication

ENTRY = "hash string, time long, clock_id string, payload string"
START = datetime(2024, 1, 1)


def folder(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_append_is_idempotent(spark, tmp_path):
    table = OpLogTable(spark, str(tmp_path / "log"))
    folder(spark, tmp_path / "in", [(f"h{k % 4}", k % 4, "w", "p") for k in range(8)], ENTRY)
    sink = replication.append_new(table)
    replication.run_available(replication.event_stream(spark, str(tmp_path / "in"), ENTRY), sink, str(tmp_path / "c1"))
    sink(spark.read.parquet(str(tmp_path / "in")), 0)
    assert sorted(r["hash"] for r in table.read().collect()) == ["h0", "h1", "h2", "h3"]
    folder(spark, tmp_path / "in", [("h9", 9, "w", "p")], ENTRY)
    replication.run_available(replication.event_stream(spark, str(tmp_path / "in"), ENTRY), sink, str(tmp_path / "c1"))
    assert table.read().count() == 5


def test_only_authorised_entries_are_taken(spark, tmp_path):
    table = OpLogTable(spark, str(tmp_path / "log"))
    rows = [("h1", 1, "x", "w", "p", "a", "ka"), ("h2", 2, "x", "w", "p", "b", "kb"), ("0" * 64, 3, "x", "w", "p", "a", "ka"), ("h4", 4, "x", "w", "", "a", "ka")]
    schema = "hash string, time long, log_id string, clock_id string, payload string, identity_id string, pub_key string"
    folder(spark, tmp_path / "in", rows, schema)
    grants = spark.createDataFrame([("write", "ka"), ("admin", "kb")], "role string, key string")
    replication.run_available(replication.event_stream(spark, str(tmp_path / "in"), schema), replication.append_new(table, grants), str(tmp_path / "c"))
    assert [r["hash"] for r in table.read().collect()] == ["h1"]


def test_unreadable_messages_are_dropped(spark):
    df = spark.createDataFrame([("t", json.dumps({"hash": "h", "time": 1})), ("t", "{nope"), ("t", None)], "topic string, content string")
    assert [r["hash"] for r in replication.decoded(df, "hash string, time long").where("hash is not null").collect()] == ["h"]


def test_late_duplicates_and_sessions(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [("a", at(0)), ("a", at(10)), ("b", at(20)), ("a", at(100)), ("a", at(105))]
    folder(spark, tmp_path / "in", rows, "message_id string, ts timestamp_ntz")
    out = {}
    stream = replication.event_stream(spark, str(tmp_path / "in"), "message_id string, ts timestamp_ntz")
    replication.run_available(replication.deduplicated(stream), lambda b, n: out.setdefault("dedup", []).extend(r["message_id"] for r in b.collect()), str(tmp_path / "c1"))
    assert sorted(out["dedup"]) == ["a", "b"]
    sessions = replication.heartbeats(stream.withColumnRenamed("message_id", "peer"))
    replication.run_available(sessions, lambda b, n: out.update(s=[(r["peer"], r["n"]) for r in b.collect()]), str(tmp_path / "c2"), "complete")
    assert sorted(out["s"]) == [("a", 2), ("a", 2), ("b", 1)]


def test_events_are_told(spark, tmp_path):
    told = []
    listener = replication.SyncEvents(lambda kind, what: told.append(kind))
    spark.streams.addListener(listener)
    try:
        folder(spark, tmp_path / "in", [("a", START)], "message_id string, ts timestamp_ntz")
        replication.run_available(replication.event_stream(spark, str(tmp_path / "in"), "message_id string, ts timestamp_ntz").select(F.col("message_id")), lambda b, n: None, str(tmp_path / "c"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert told[0] == "started" and "progress" in told
