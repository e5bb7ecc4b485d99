"""Queries on event logs and on the graphs of their entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import clock
from tidelog.operators import log
from tidelog.plans.registry import DAG, EVENT_LOG, POSITIONS, query
from tidelog.sources import adapters

COLUMNS = ["time", "clock_id", "hash", "payload"]
_SHOWN = "time, clock_id, hash, payload"
_A = "(SELECT * FROM elog WHERE event_id % 3 <> 0)"
_B = "(SELECT * FROM elog WHERE event_id % 3 <> 1)"


def _hash_at(spark: SparkSession, d: str, event_id: int) -> str:
    return adapters.event_log(spark, d).where(F.col("event_id") == event_id).select("hash").first()["hash"]


def _events(spark: SparkSession, d: str) -> DataFrame:
    return adapters.event_log(spark, d)


@query(f"WITH {POSITIONS} SELECT {_SHOWN}, pos FROM p")
def log_values(spark: SparkSession, d: str) -> DataFrame:
    return log.with_positions(_events(spark, d)).select(*COLUMNS, "pos")


@query(f"WITH {EVENT_LOG} SELECT {_SHOWN} FROM elog WHERE event_id = 77")
def log_get(spark: SparkSession, d: str) -> DataFrame:
    return log.get(_events(spark, d), _hash_at(spark, d, 77)).select(*COLUMNS)


@query(f"WITH {EVENT_LOG} SELECT {_SHOWN} FROM elog ORDER BY time DESC, clock_id DESC, hash DESC LIMIT 10")
def log_list_store_last_n(spark: SparkSession, d: str) -> DataFrame:
    return log.list_store(_events(spark, d), amount=10).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos > (SELECT pos FROM p WHERE event_id = 100) ORDER BY pos LIMIT 20")
def log_list_store_gt(spark: SparkSession, d: str) -> DataFrame:
    return log.list_store(_events(spark, d), amount=20, gt=_hash_at(spark, d, 100)).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos >= (SELECT pos FROM p WHERE event_id = 100) ORDER BY pos LIMIT 20")
def log_list_store_gte(spark: SparkSession, d: str) -> DataFrame:
    """The upper bound is ignored, because there is a lower one."""
    return log.list_store(_events(spark, d), amount=20, gte=_hash_at(spark, d, 100), lt=_hash_at(spark, d, 103)).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos < (SELECT pos FROM p WHERE event_id = 100) ORDER BY pos DESC LIMIT 20")
def log_list_store_lt(spark: SparkSession, d: str) -> DataFrame:
    return log.list_store(_events(spark, d), amount=20, lt=_hash_at(spark, d, 100)).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos <= (SELECT pos FROM p WHERE event_id = 100) ORDER BY pos DESC LIMIT 20")
def log_list_store_lte(spark: SparkSession, d: str) -> DataFrame:
    return log.list_store(_events(spark, d), amount=20, lte=_hash_at(spark, d, 100)).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos >= (SELECT pos FROM p WHERE event_id = 50) ORDER BY pos LIMIT 5")
def log_list_store_gt_and_gte(spark: SparkSession, d: str) -> DataFrame:
    """Given with gte, gt includes its own entry."""
    return log.list_store(_events(spark, d), amount=5, gt=_hash_at(spark, d, 50), gte=_hash_at(spark, d, 60)).select(*COLUMNS)


@query(f"WITH {EVENT_LOG} SELECT {_SHOWN} FROM elog WHERE false")
def log_list_unknown_anchor(spark: SparkSession, d: str) -> DataFrame:
    return log.list_store(_events(spark, d), amount=5, gte="0" * 64).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos <= 10")
def log_list_facade_first_n(spark: SparkSession, d: str) -> DataFrame:
    return log.list_facade(_events(spark, d), amount=10).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos >= (SELECT pos FROM p WHERE event_id = 100) AND pos < (SELECT pos FROM p WHERE event_id = 150) ORDER BY pos LIMIT 30")
def log_list_facade_range(spark: SparkSession, d: str) -> DataFrame:
    return log.list_facade(_events(spark, d), amount=30, gte=_hash_at(spark, d, 100), lt=_hash_at(spark, d, 150)).select(*COLUMNS)


@query(f"WITH {POSITIONS} SELECT {_SHOWN} FROM p WHERE pos > 20 AND pos <= 35")
def log_slice(spark: SparkSession, d: str) -> DataFrame:
    return log.positions_between(_events(spark, d), 20, 35).select(*COLUMNS)


@query(f"WITH {EVENT_LOG} SELECT {_SHOWN} FROM {_A} WHERE hash NOT IN (SELECT hash FROM {_B})")
def log_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = adapters.replicas(spark, d)
    return log.difference(a, b).select(*COLUMNS)


@query(f"WITH {EVENT_LOG} SELECT DISTINCT {_SHOWN} FROM (SELECT * FROM {_A} UNION ALL SELECT * FROM {_B}) u")
def log_join(spark: SparkSession, d: str) -> DataFrame:
    return log.joined(*adapters.replicas(spark, d)).select(*COLUMNS)


@query(f"WITH {EVENT_LOG} SELECT DISTINCT {_SHOWN} FROM (SELECT * FROM {_A} UNION ALL SELECT * FROM {_B}) u ORDER BY time DESC, clock_id DESC, hash DESC LIMIT 25")
def log_join_truncate(spark: SparkSession, d: str) -> DataFrame:
    return log.join_truncated(*adapters.replicas(spark, d), 25).select(*COLUMNS)


@query(f"WITH {EVENT_LOG} SELECT max(time) AS time FROM elog")
def log_clock(spark: SparkSession, d: str) -> DataFrame:
    return log.clock_time(_events(spark, d))


@query(f"WITH {EVENT_LOG} SELECT count(*) AS n_entries, CAST(sum(strlen(payload)) AS BIGINT) AS n_bytes FROM elog")
def log_stats(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d).agg(F.count(F.lit(1)).alias("n_entries"), F.sum(F.octet_length("payload")).alias("n_bytes"))


_GRAPH = "log_id, hash, time, clock_id"


@query(f"WITH {DAG} SELECT {_GRAPH} FROM dag WHERE hash NOT IN (SELECT unnest(next) FROM dag)")
def log_heads(spark: SparkSession, d: str) -> DataFrame:
    return log.heads(adapters.dag(spark, d)).select("log_id", "hash", "time", "clock_id")


@query(f"WITH {DAG}, part AS (SELECT * FROM dag WHERE turn % 4 <> 1), e AS (SELECT hash AS child, unnest(next) AS parent FROM part) SELECT {_GRAPH} FROM part WHERE len(next) = 0 OR hash IN (SELECT child FROM e WHERE parent NOT IN (SELECT hash FROM part))")
def log_tails(spark: SparkSession, d: str) -> DataFrame:
    """Some turns are taken out, so that entries refer to parents that aren't there."""
    return log.tails(adapters.dag(spark, d).where("turn % 4 != 1")).select("log_id", "hash", "time", "clock_id")


@query(f"WITH {DAG}, part AS (SELECT * FROM dag WHERE turn % 4 <> 1), e AS (SELECT DISTINCT hash AS child, unnest(next) AS parent FROM part) SELECT child, parent FROM e WHERE parent NOT IN (SELECT hash FROM part)")
def log_dangling(spark: SparkSession, d: str) -> DataFrame:
    return log.dangling(adapters.dag(spark, d).where("turn % 4 != 1"))


@query(f"WITH RECURSIVE {DAG}, m AS (SELECT log_id, min(turn) + max(turn) AS span FROM dag GROUP BY log_id), c AS (SELECT dag.log_id, max(turn) AS turn FROM dag JOIN m ON m.log_id = dag.log_id WHERE 2 * turn <= span GROUP BY dag.log_id), r AS (SELECT hash, next FROM dag JOIN c ON c.log_id = dag.log_id AND c.turn = dag.turn UNION SELECT g.hash, g.next FROM r, unnest(r.next) AS t(parent) JOIN dag g ON g.hash = t.parent) SELECT {_GRAPH} FROM dag WHERE hash IN (SELECT hash FROM r)")
def log_traverse(spark: SparkSession, d: str) -> DataFrame:
    """From the middle turn of every conversation, or the one before it."""
    graph = adapters.dag(spark, d)
    span = graph.groupBy("log_id").agg(F.min("turn").alias("from_"), F.max("turn").alias("to_"))
    chosen = graph.join(span, "log_id").where(2 * F.col("turn") <= F.col("from_") + F.col("to_")).groupBy("log_id").agg(F.max_by("hash", "turn").alias("hash"))
    return log.traverse(graph, chosen).select("log_id", "hash", "time", "clock_id")


@query(f"WITH {DAG}, e AS (SELECT DISTINCT hash AS child, unnest(next) AS parent FROM dag), r AS (SELECT parent, child, row_number() OVER (PARTITION BY parent ORDER BY g.time, g.clock_id, g.hash) AS n FROM e JOIN dag g ON g.hash = e.child) SELECT parent AS hash, child FROM r WHERE n = 1")
def log_first_children(spark: SparkSession, d: str) -> DataFrame:
    return log.first_children(adapters.dag(spark, d))


@query(f"WITH {DAG} SELECT hash, CAST(len(list_distinct(next)) AS BIGINT) AS n_parents FROM dag")
def log_parents(spark: SparkSession, d: str) -> DataFrame:
    return log.parents_of(adapters.dag(spark, d))


@query(f"WITH {DAG}, h AS (SELECT * FROM dag WHERE hash NOT IN (SELECT unnest(next) FROM dag)) SELECT log_id, '{{\"id\":' || log_id || ',\"heads\":[\"' || array_to_string(list(hash ORDER BY hash DESC), '\",\"') || '\"]}}' AS record FROM h GROUP BY log_id")
def log_json(spark: SparkSession, d: str) -> DataFrame:
    return log.head_record(adapters.dag(spark, d))


@query(f"WITH {POSITIONS}, n AS (SELECT count(*) AS n FROM p) SELECT a.hash AS a, b.hash AS b, CAST(CASE WHEN a.time < b.time THEN -1 WHEN a.time > b.time THEN 1 WHEN a.clock_id < b.clock_id THEN -1 WHEN a.clock_id > b.clock_id THEN 1 ELSE 0 END AS INTEGER) AS ordering, greatest(a.time, b.time) + 1 AS merged FROM p a, p b, n WHERE b.pos = n.n + 1 - a.pos")
def log_clock_compare(spark: SparkSession, d: str) -> DataFrame:
    """Every entry with the one as far from the end as it is from the start."""
    placed = log.with_positions(_events(spark, d).select("hash", "time", "clock_id"))
    n = placed.count()
    a = placed.select(F.col("pos").alias("i"), F.col("hash").alias("a"), F.col("time").alias("ta"), F.col("clock_id").alias("ca"))
    b = placed.select((F.lit(n + 1) - F.col("pos")).alias("i"), F.col("hash").alias("b"), F.col("time").alias("tb"), F.col("clock_id").alias("cb"))
    return a.join(b, "i").select("a", "b", clock.compare(F.col("ta"), F.col("ca"), F.col("tb"), F.col("cb")).cast("int").alias("ordering"), clock.tick(clock.merge(F.col("ta"), F.col("tb"))).alias("merged"))
