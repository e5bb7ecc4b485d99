"""Named queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with its oracle."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# Fixed parts of the oracles: the virtual stores.
EVENT_LOG = "elog AS (SELECT event_id + 1 AS time, CAST(user_id AS VARCHAR) AS clock_id, sha256(concat_ws('|', event_id, user_id, event_type)) AS hash, props AS payload, event_id, event_type FROM events)"
KV_OPS = "kv AS (SELECT event_id + 1 AS time, CAST(user_id AS VARCHAR) AS clock_id, sha256(concat_ws('|', event_id, user_id, event_type)) AS hash, 'u' || user_id || '/' || event_type AS key, CASE WHEN event_id % 7 = 0 THEN 'DEL' ELSE 'PUT' END AS op, props AS value FROM events)"
KV_STATE = KV_OPS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time DESC, clock_id DESC, hash DESC) AS r FROM kv), state AS (SELECT key, value FROM ranked WHERE r = 1 AND op = 'PUT')"
POSITIONS = EVENT_LOG + ", p AS (SELECT *, row_number() OVER (ORDER BY time, clock_id, hash) AS pos FROM elog)"
DAG = "dag AS (SELECT c.conv_id AS log_id, sha256(concat_ws('|', c.conv_id, c.turn)) AS hash, list_filter([CASE WHEN c.turn - 1 >= f THEN sha256(concat_ws('|', c.conv_id, c.turn - 1)) END, CASE WHEN c.turn - 2 >= f THEN sha256(concat_ws('|', c.conv_id, c.turn - 2)) END], lambda x: x IS NOT NULL) AS next, c.turn + 1 AS time, c.role AS clock_id, c.turn FROM conversations c JOIN (SELECT conv_id, min(turn) AS f FROM conversations GROUP BY conv_id) m ON c.conv_id = m.conv_id)"
DOCS = "docs AS (SELECT concat_ws('.', source, lang, doc_id) AS key, lang, source, n_chars, doc_id FROM documents)"
STORE = "store AS (SELECT '/ev/' || event_type || '/' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS key, props AS value FROM events)"
ACL = "acl AS (SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'write' WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'read' END AS role, CAST(c_custkey AS VARCHAR) AS key FROM customer)"
SAMPLES = "samples AS (SELECT event_type AS series, event_id AS seq, value AS x FROM events)"
MESSAGES = "msg AS (SELECT event_id AS message_id, CAST(user_id AS VARCHAR) AS key_id, event_id // 10 AS version, CASE event_type WHEN 'signup' THEN 'Create' WHEN 'error' THEN 'Delete' WHEN 'view' THEN 'MetadataSync' ELSE 'Update' END AS operation, ts FROM events)"

from tidelog.plans import access, collections, keyvalue, logs, network, operations, states, streams  # noqa: E402, F401  they register themselves
