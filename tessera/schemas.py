"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

STR, LONG, INT, DBL, BOOL, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.TimestampType()
VECTOR = T.ArrayType(T.FloatType(), False)


def _table(**columns: T.DataType) -> T.StructType:
    """A schema; a trailing underscore marks a column that is never null."""
    return T.StructType([T.StructField(k.rstrip("_"), v, not k.endswith("_")) for k, v in columns.items()])


LOCATOR = _table(page=INT, byte_start=LONG, byte_end=LONG, time_start_ms=LONG, time_end_ms=LONG, bounding_box=STR)
MEDIA_REF = _table(media_id=STR, blob_key=STR, role=STR, label=STR, locator=LOCATOR, metadata=STR)
MEDIA_REFS = T.ArrayType(MEDIA_REF)
DOCUMENT = _table(id_=STR, text=STR, media_ids=T.ArrayType(STR), media_refs=MEDIA_REFS, metadata=STR)
DOCS = _table(id_=STR, content=STR, embedding_=VECTOR, media_refs=STR)
TOMBSTONES = _table(doc_id_=STR, deleted_at=TS)
ENTITIES = _table(id_=STR, name=STR)
EDGES = _table(src_=STR, dst_=STR, weight=DBL, rel_type=STR, chunk_id=STR)
DOC_ENTITIES = _table(doc_id_=STR, entity_id_=STR, weight=DBL, chunk_id=STR)
CHUNKS = _table(doc_id=STR, chunk_id=STR, text=STR, start=INT, end=INT)
SHARDS = _table(
    shard_id_=STR, key=STR, version=STR, size_bytes=LONG, vector_rows=LONG, created_at=TS, sealed_at=TS, tombstone_ratio=DBL, graph_available=BOOL, centroid=T.ArrayType(T.FloatType()), sha256=STR, media_ids=T.ArrayType(STR)
)
MANIFEST = _table(schema_version=INT, layout=STR, format_kind=STR, format_version=INT, kb_id=STR, created_at=STR, total_size_bytes=LONG, shards=T.ArrayType(SHARDS))
EVENTS = _table(
    event_id_=STR, kb_id=STR, kind_=STR, payload=STR, payload_schema=STR, correlation_id=STR, causation_id=STR, idempotency_key=STR, status_=STR, attempt=INT, max_attempts=INT, claimed_by=STR, claimed_until=TS, created_at=TS, last_error=STR
)
INBOX = _table(worker_id_=STR, idempotency_key_=STR, event_id=STR, processed_at=TS)
MEDIA = _table(
    id_=STR, kb_id=STR, filename=STR, content_type=STR, size_bytes=LONG, blob_key=STR, checksum=STR, source=STR, title=STR, tags=T.ArrayType(STR), created_at_unix_ms=LONG, uploaded_by=STR, metadata=STR, state=STR, tombstoned_at_unix_ms=LONG, idempotency_key=STR
)
GC_QUEUE = _table(kb_id=STR, shard_key=STR, not_before=TS)
CODE_FILES = _table(path_=STR, hash=STR, size_bytes=LONG, language=STR, chunk_ids=T.ArrayType(STR))
CODE_CHUNKS = _table(id_=STR, path=STR, hash=STR, language=STR, symbol=STR, kind=STR, start_line=INT, end_line=INT)
RESULT = _table(id=STR, content=STR, distance=DBL, graph_score=DBL, score=DBL, media_refs=STR)

EVENT_KINDS = ["document.upsert", "document.chunked", "document.embedded", "document.graph_extracted", "kb.published", "worker.failed", "media.upload", "media.uploaded"]
EVENT_STATUSES = ["pending", "claimed", "done", "failed", "dead"]
MEDIA_STATES = ["pending", "active", "tombstoned"]
PAYLOADS = {
    "document.upsert": _table(kb_id=STR, documents=T.ArrayType(DOCUMENT), graph_enabled=BOOL),
    "document.chunked": _table(kb_id=STR, chunks=T.ArrayType(CHUNKS), graph_enabled=BOOL),
    "document.embedded": _table(kb_id=STR, documents=T.ArrayType(DOCS)),
    "document.graph_extracted": _table(kb_id=STR, documents=T.ArrayType(DOCS), entities=T.ArrayType(ENTITIES), edges=T.ArrayType(EDGES)),
    "kb.published": _table(kb_id=STR, version=STR, mutated=LONG),
    "worker.failed": _table(event_id=STR, kind=STR, error=STR, attempt=INT),
}
