"""Queries on key-value stores and datastores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.operators import datastore, fold
from tidelog.plans.registry import KV_OPS, KV_STATE, STORE, query
from tidelog.sources import adapters


def _state(spark: SparkSession, d: str) -> DataFrame:
    return fold.current(adapters.kv_ops(spark, d))


@query(f"WITH {KV_STATE} SELECT key, value FROM state")
def kv_all_lww(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d)


@query(f"WITH {KV_STATE} SELECT key, value FROM state WHERE key = (SELECT min(key) FROM state)")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    """The first key that there is."""
    key = _state(spark, d).agg(F.min("key").alias("key")).first()["key"]
    return fold.current(adapters.kv_ops(spark, d).where(F.col("key") == key))


@query(f"WITH {KV_STATE}, asked(key) AS (VALUES ('u1/view'), ('u2/click'), ('nobody/view')) SELECT asked.key, state.key IS NOT NULL AS present FROM asked LEFT JOIN state USING (key)")
def kv_contains(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("u1/view",), ("u2/click",), ("nobody/view",)], "key string")
    state = _state(spark, d).select("key", F.lit(True).alias("p_"))
    return asked.join(state, "key", "left").select("key", F.coalesce("p_", F.lit(False)).alias("present"))


@query(f"WITH {KV_STATE} SELECT key FROM state")
def kv_keys(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("key")


@query(f"WITH {KV_STATE} SELECT count(*) AS n_keys, CAST(sum(strlen(value)) AS BIGINT) AS n_bytes FROM state")
def kv_len(spark: SparkSession, d: str) -> DataFrame:
    return datastore.totals(_state(spark, d))


@query(f"WITH {KV_OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time // 10 DESC, time ASC) AS n FROM kv) SELECT key, value FROM r WHERE n = 1 AND op <> 'DEL'")
def kv_all_facade_ties(spark: SparkSession, d: str) -> DataFrame:
    """Clocks are made coarse so that they tie; the first operation of equal times wins."""
    ops = adapters.kv_ops(spark, d)
    return fold.facade_state(ops.select(F.floor(F.col("time") / 10).alias("time"), F.col("time").alias("pos"), "key", "op", "value"))


@query(f"WITH {KV_STATE}, r AS (SELECT *, row_number() OVER (ORDER BY time DESC) AS n FROM kv WHERE key = (SELECT max(key) FROM state)) SELECT key, value FROM r WHERE n = 1 AND op = 'PUT'")
def kv_facade_get(spark: SparkSession, d: str) -> DataFrame:
    """The last key that there is."""
    key = _state(spark, d).agg(F.max("key").alias("key")).first()["key"]
    return fold.facade_get(adapters.kv_ops(spark, d).withColumn("pos", F.col("time")), key)


@query(f"WITH {KV_OPS}, r AS (SELECT *, CASE WHEN time % 5 = 0 THEN '' ELSE value END AS v, row_number() OVER (PARTITION BY key ORDER BY time DESC, clock_id DESC, hash DESC) AS n FROM kv) SELECT key, v AS value FROM r WHERE n = 1 AND op = 'PUT' AND v <> ''")
def idx_fold_base(spark: SparkSession, d: str) -> DataFrame:
    """One pass: a put without a value uses its key up."""
    ops = adapters.kv_ops(spark, d).withColumn("value", F.when(F.col("time") % 5 == 0, "").otherwise(F.col("value")))
    return fold.single_pass(ops)


@query(f"WITH {KV_OPS}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time DESC, clock_id DESC, hash DESC) AS n FROM kv WHERE op = 'DEL' OR time % 5 <> 0) SELECT key, value FROM r WHERE n = 1 AND op = 'PUT'")
def idx_fold_incremental(spark: SparkSession, d: str) -> DataFrame:
    """Steady state: a put without a value changes nothing."""
    ops = adapters.kv_ops(spark, d).withColumn("value", F.when(F.col("time") % 5 == 0, "").otherwise(F.col("value")))
    return fold.current(ops)


_LINES = "l AS (SELECT l_orderkey AS time, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'part/' || l_partkey, 'order ' || l_orderkey || ' line ' || l_linenumber) AS pos, 'part/' || l_partkey AS key, 'order ' || l_orderkey || ' line ' || l_linenumber AS value FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY time DESC, pos DESC) AS n FROM l)"


@query(f"WITH {_LINES} SELECT key, value FROM r WHERE n = 1")
def idx_fold_putall(spark: SparkSession, d: str) -> DataFrame:
    """Documents out of batches: the last document of a key in its last batch."""
    batches = adapters.order_batches(spark, d).withColumns({"key": F.lit(None).cast("string"), "value": F.lit(None).cast("string")})
    return fold.document_state(batches)


@query(f"WITH {STORE} SELECT key, value FROM store WHERE key = '/ev/error/00000042' OR key = '/ev/view/00000100'")
def ds_get(spark: SparkSession, d: str) -> DataFrame:
    store = adapters.datastore(spark, d)
    return datastore.get(store, "/ev/error/00000042").unionByName(datastore.get(store, "/ev/view/00000100"))


@query(f"WITH {STORE} SELECT key, value FROM (SELECT * FROM store WHERE starts_with(key, '/ev/click') ORDER BY key LIMIT 10 OFFSET 5) t")
def ds_prefix_page_asc(spark: SparkSession, d: str) -> DataFrame:
    return datastore.page(adapters.datastore(spark, d), "/ev/click", limit=10, offset=5)


@query(f"WITH {STORE} SELECT key, value FROM (SELECT * FROM store WHERE starts_with(key, '/ev/view') ORDER BY key LIMIT 7) t ORDER BY key DESC")
def ds_prefix_page_desc(spark: SparkSession, d: str) -> DataFrame:
    return datastore.page(adapters.datastore(spark, d), "/ev/view", limit=7, descending=True)


@query(f"WITH {STORE} SELECT key, value FROM store WHERE starts_with(key, '/ev/error') ORDER BY key LIMIT 1")
def ds_limit_zero(spark: SparkSession, d: str) -> DataFrame:
    """A limit of 0 gives one row."""
    return datastore.page(adapters.datastore(spark, d), "/ev/error", limit=0)


@query(f"WITH {STORE} SELECT key FROM store WHERE starts_with(key, '/ev/pur')")
def ds_keys(spark: SparkSession, d: str) -> DataFrame:
    return datastore.keys(adapters.datastore(spark, d), "/ev/pur")


@query(f"WITH {STORE} SELECT key FROM store WHERE starts_with(key, '/ev/signup')")
def ds_keys_normalised(spark: SparkSession, d: str) -> DataFrame:
    return datastore.keys_under(adapters.datastore(spark, d), " ev // signup ")


@query(f"WITH {STORE} SELECT key, value FROM store WHERE starts_with(key, '/ev/error/')")
def ds_descendants(spark: SparkSession, d: str) -> DataFrame:
    return datastore.descendants(adapters.datastore(spark, d), "/ev/error")


@query(f"WITH {STORE} SELECT key, value FROM store WHERE strlen(value) >= 9")
def ds_min_size(spark: SparkSession, d: str) -> DataFrame:
    return datastore.at_least(adapters.datastore(spark, d), 9)


@query(f"WITH {STORE} SELECT count(*) AS n_keys, CAST(sum(strlen(value)) AS BIGINT) AS n_bytes FROM store")
def ds_total_size(spark: SparkSession, d: str) -> DataFrame:
    return datastore.totals(adapters.datastore(spark, d))


@query(f"WITH {STORE} SELECT key, CAST(strlen(value) AS BIGINT) AS size FROM store WHERE key = '/ev/view/00000100'")
def ds_value_size(spark: SparkSession, d: str) -> DataFrame:
    return datastore.value_size(adapters.datastore(spark, d), "/ev/view/00000100")


@query(f"WITH {STORE}, c AS (SELECT event_id AS seq, '/ev/' || event_type || '/' || lpad(CAST(event_id // 2 AS VARCHAR), 8, '0') AS key, CASE WHEN event_id % 3 = 0 THEN 'DEL' ELSE 'PUT' END AS op, 'new' AS value FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM c) SELECT key, value FROM store WHERE key NOT IN (SELECT key FROM c) UNION ALL SELECT key, value FROM l WHERE n = 1 AND op = 'PUT'")
def ds_upsert(spark: SparkSession, d: str) -> DataFrame:
    store = adapters.datastore(spark, d)
    half = F.lpad(F.floor(F.col("event_id") / 2).cast("string"), 8, "0")
    changes = adapters.table(spark, d, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("/ev/"), "event_type", F.lit("/"), half).alias("key"), F.when(F.col("event_id") % 3 == 0, "DEL").otherwise("PUT").alias("op"), F.lit("new").alias("value"))
    return datastore.upserted(store, changes)


@query(f"WITH {STORE} SELECT key, '/ev/' || split_part(key, '/', 3) AS parent, split_part(key, '/', 4) AS name, CAST(3 AS BIGINT) AS depth, key || '/x' AS child FROM store")
def ds_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("key")
    return adapters.datastore(spark, d).select(key, keys.parent(key).alias("parent"), keys.last_segment(key).alias("name"), keys.depth(key).cast("long").alias("depth"), keys.child(key, "x").alias("child"))
