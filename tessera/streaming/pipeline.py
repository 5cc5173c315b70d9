"""Ingest as Structured Streaming: deduplication, stages, publication, stateful retries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import embed, text
from ..operators import graphbuild
from ..policy import with_retry
from ..sources.store import SnapshotStore, VersionMismatch

#: How long an idempotency key is remembered.
KEY_MEMORY = "30 days"


def timestamped(events: DataFrame, column: str = "created_at") -> DataFrame:
    """Event time as a timestamp with zone, which watermarks need."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def deduplicated(events: DataFrame, memory: str = KEY_MEMORY) -> DataFrame:
    """The first event of each (key, kind, base) within the memory; events without a key all pass."""
    keyed = F.when(F.coalesce("idempotency_key", F.lit("")) == "", F.col("event_id")).otherwise(F.col("idempotency_key"))
    marked = timestamped(events).withColumn("__key", keyed).withWatermark("created_at", memory)
    return marked.dropDuplicatesWithinWatermark(["__key", "kind", "kb_id"]).drop("__key")


def chunked(documents: DataFrame, size: int = text.DEFAULT_SIZE) -> DataFrame:
    """Stage 1: documents to chunks."""
    return text.chunks(documents, size)


def embedded(chunks: DataFrame, embedder: embed.Embedder | None = None) -> DataFrame:
    """Stage 2: chunks to rows of ``docs``; what can't be embedded keeps its reason."""
    rows = chunks.select(F.col("chunk_id").alias("id"), F.col("text").alias("content"))
    return embed.embedded(rows, embedder)


def graph_extracted(chunks: DataFrame, grapher: graphbuild.Grapher = graphbuild.capitalised) -> DataFrame:
    """Stage 2 with a graph: entities and edges of each chunk."""
    return graphbuild.extract(chunks, grapher)


def publisher(store: SnapshotStore, kb_id: str, attempts: int = 5) -> Callable[[DataFrame, int], None]:
    """Stage 3, for ``foreachBatch``: upsert a micro-batch and publish it, once; of equal ids the last row wins.

    The number of the last batch is part of the published tables, so a batch that is replayed after a failure is
    recognised and changes nothing.
    """
    from ..operators import mutate

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def once(rows: DataFrame):
            now = store.current(kb_id)
            done = spark.createDataFrame([(batch_id,)], "batch_id long")
            if now and "batches" in now.manifest["tables"]:
                done = store.read(kb_id, "batches", now).unionByName(done)
            docs = mutate.upsert(store.read(kb_id, "docs", now), rows, "__order") if now and "docs" in now.manifest["tables"] else mutate.last_of_each(rows, "__order")
            store.publish(kb_id, {"docs": docs.select("id", "content", "embedding"), "batches": done.coalesce(1)}, now.version if now else None)

        def attempt():
            now = store.current(kb_id)
            if now and "batches" in now.manifest["tables"] and not store.read(kb_id, "batches", now).where(F.col("batch_id") == batch_id).isEmpty():
                return
            if not made:  # a batch is planned anew by each action: embed it once
                made.extend(store.staged(kb_id, batch.where("embedding is not null").select("id", "content", "embedding").withColumn("__order", F.monotonically_increasing_id())))
            once(made[0])

        made: list = []
        try:
            with_retry(attempt, attempts, (VersionMismatch,))
        finally:
            if made:
                store.blobs.delete(made[1])

    return publish


def ingest(documents: DataFrame, store: SnapshotStore, kb_id: str, checkpoint: str, size: int = text.DEFAULT_SIZE, embedder: embed.Embedder | None = None):
    """A stream of documents (``id, text``) to a published base; runs over what is there and stops."""
    rows = embedded(chunked(documents, size), embedder)
    query = rows.writeStream.foreachBatch(publisher(store, kb_id)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def retry_states(attempts: DataFrame, max_attempts: int = 3) -> DataFrame:
    """A stream of outcomes (``event_id, ok``) to states: ``event_id, attempt, status``; failures count up to dead."""

    def fold(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        tries, status = state.get if state.exists else (0, "pending")
        for pdf in batches:
            for ok in pdf["ok"]:
                if status in ("done", "dead"):
                    break
                tries += 1
                status = "done" if ok else ("dead" if tries >= max_attempts else "pending")
        state.update((tries, status))
        yield pd.DataFrame({"event_id": [key[0]], "attempt": [tries], "status": [status]})

    return attempts.groupBy("event_id").applyInPandasWithState(fold, "event_id string, attempt int, status string", "attempt int, status string", "update", GroupStateTimeout.NoTimeout)


def activity(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events by kind and event-time window, late ones dropped after the delay."""
    return timestamped(events).withWatermark("created_at", delay).groupBy(F.window("created_at", width), "kind").agg(F.count("*").alias("n")).select("window.start", "window.end", "kind", "n")
