"""Replication as streams: entries and key messages that arrive, in micro-batches.

Stateful steps use watermarks, so that state is bounded; sinks run once per batch id and may be run again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidelog.operators import log, sync
from tidelog.sources.store import OpLogTable

AGE = "300 seconds"


def event_stream(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream, with ts as a timestamp that watermarks take."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in rows.columns else rows


def decoded(messages: DataFrame, schema: str, content: str = "content") -> DataFrame:
    """Messages whose content is JSON of the schema; others are dropped."""
    read = messages.withColumn("m_", F.from_json(content, schema, {"mode": "PERMISSIVE"}))
    return read.where("m_ is not null").select(*[c for c in messages.columns if c != content], "m_.*")


def deduplicated(messages: DataFrame, id_: str = "message_id", age: str = AGE) -> DataFrame:
    """The first of each id; an id is remembered for age of event time."""
    return messages.withWatermark("ts", age).dropDuplicatesWithinWatermark([id_])


def heartbeats(messages: DataFrame, peer: str = "peer", gap: str = "30 seconds", age: str = AGE) -> DataFrame:
    """Sessions of a peer: spans without a gap between messages."""
    window = F.session_window("ts", gap)
    return messages.withWatermark("ts", age).groupBy(peer, window.alias("session")).agg(F.count(F.lit(1)).alias("n")).select(peer, F.col("session.start").alias("began"), F.col("session.end").alias("ended"), "n")


def rates(messages: DataFrame, kind: str, width: str = "1 minute", age: str = AGE) -> DataFrame:
    """Messages of each kind in windows of time."""
    return messages.withWatermark("ts", age).groupBy(F.window("ts", width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("began"), kind, "n")


def append_new(table: OpLogTable, grants: DataFrame | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that appends entries which the log lacks; with grants, only authorised ones.

    Appending is idempotent: entries are told apart by hash, so a batch that is run again adds nothing.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        new = batch.dropDuplicates(["hash"])
        known = table.read()
        taken = log.missing_from(new, known) if grants is None else sync.accepted_facade(new, known, grants)
        table.append(taken)

    return sink


def versioned_keys(messages: DataFrame) -> DataFrame:
    """key_id, version, outcome of each message against the key's state: a create below or at the version is ignored, an
    update of a missing key is missing, one below the version a conflict; a delete always applies. State is one version a key; a key's messages of one trigger, which files_a_trigger bounds, are put in order."""

    def apply(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        version = state.get[0] if state.exists else None
        out = []
        for r in pd.concat(list(batches)).sort_values("message_id").itertuples():
            version, outcome = versioned(version, int(r.version), r.operation)
            out.append((key[0], int(r.message_id), int(r.version), outcome))
        if version is None:
            if state.exists:
                state.remove()
        else:
            state.update((version,))
        yield pd.DataFrame(out, columns=["key_id", "message_id", "version", "outcome"])

    return messages.groupBy("key_id").applyInPandasWithState(apply, "key_id string, message_id long, version long, outcome string", "version long", "append", "NoTimeout")


def versioned(held: int | None, version: int, operation: str) -> tuple[int | None, str]:
    """The version that a key has after a message, and what became of the message."""
    if operation == "Create":
        return (held, "ignored") if held is not None and held >= version else (version, "created")
    if operation == "Update":
        if held is None:
            return None, "missing"
        return (held, "conflict") if held > version else (version, "updated")
    if operation == "Delete":
        return None, "deleted"
    return (version if held is None else max(held, version)), "metadata"


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Runs the stream over what there is, then stops."""
    query = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


class SyncEvents(StreamingQueryListener):
    """Started, progress, ready and error events of replication, for those who subscribe."""

    def __init__(self, tell: Callable[[str, dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.tell("started", {"id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.tell("progress", {"id": str(event.progress.id), "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self.tell("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.tell("error" if event.exception else "ready", {"id": str(event.id), "exception": event.exception})
