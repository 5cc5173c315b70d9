"""Media objects: lifecycle, references and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING_TTL_MS, TOMBSTONE_GRACE_MS = 24 * 3_600_000, 24 * 3_600_000
PAGE, MOST = 500, 5000


def live_references(shards: DataFrame) -> DataFrame:
    """``kb_id, media_id`` that shards of the current manifests name."""
    return shards.select("kb_id", F.explode("media_ids").alias("media_id")).distinct()


def gc_mark(media: DataFrame, live: DataFrame, now_ms: int, ttl_ms: int = PENDING_TTL_MS) -> DataFrame:
    """``media`` with pending objects settled: referenced ones active, unreferenced ones past their time tombstoned."""
    used = live.select("kb_id", F.col("media_id").alias("id")).distinct().withColumn("__used", F.lit(True))
    pending = F.col("state") == "pending"
    old = F.col("created_at_unix_ms") <= now_ms - ttl_ms
    state = F.when(pending & F.coalesce("__used", F.lit(False)), "active").when(pending & old, "tombstoned").otherwise(F.col("state"))
    out = media.join(used, ["kb_id", "id"], "left").withColumn("__new", state)
    if "tombstoned_at_unix_ms" in media.columns:
        out = out.withColumn("tombstoned_at_unix_ms", F.when((F.col("__new") == "tombstoned") & pending, F.lit(now_ms)).otherwise(F.col("tombstoned_at_unix_ms")))
    return out.withColumn("state", F.col("__new")).drop("__used", "__new")


def gc_delete(media: DataFrame, now_ms: int, grace_ms: int = TOMBSTONE_GRACE_MS) -> DataFrame:
    """Objects whose tombstone is past its grace."""
    return media.where((F.col("state") == "tombstoned") & (F.col("tombstoned_at_unix_ms") <= now_ms - grace_ms))


def by_prefix(media: DataFrame, kb_id: str, prefix: str = "") -> DataFrame:
    return media.where((F.col("kb_id") == kb_id) & F.col("filename").startswith(prefix))


def page(media: DataFrame, n: int = PAGE, after: str | None = None) -> DataFrame:
    rows = media if after is None else media.where(F.col("id") > after)
    return rows.orderBy("id").limit(min(n, MOST))


def validated(references: DataFrame, media: DataFrame) -> DataFrame:
    """``references`` (``kb_id, media_id, ...``) with ``error``: missing, of another base, tombstoned, or null."""
    known = media.select(F.col("id").alias("media_id"), F.col("kb_id").alias("__kb"), F.col("state").alias("__state"))
    error = F.when(F.col("__state").isNull(), "missing").when(F.col("__kb") != F.col("kb_id"), "other kb").when(F.col("__state") == "tombstoned", "tombstoned")
    return references.join(known, "media_id", "left").withColumn("error", error).drop("__kb", "__state")


def media_ids(rows: DataFrame, key: str, refs: str = "media_refs") -> DataFrame:
    """``key, media_ids``: distinct ids named in the encoded references of each group, sorted."""
    from ..functions.media_refs import decoded

    ids = rows.where(F.col(refs).isNotNull() & (F.col(refs) != "")).select(key, F.explode(decoded(refs)).alias("r")).where("r.media_id <> ''")
    return ids.groupBy(key).agg(F.array_sort(F.collect_set("r.media_id")).alias("media_ids"))


def content_type_allowed(content_type: Column | str, allowed: list[str]) -> Column:
    """Whether a content type is on a list that may hold ``prefix*`` entries."""
    c = F.lower(F.trim(F.col(content_type) if isinstance(content_type, str) else content_type))
    out = F.lit(not allowed)
    for a in allowed:
        a = a.strip().lower()
        out = out | (c.startswith(a[:-1]) if a.endswith("*") else c == a)
    return out


def abandoned(log: DataFrame, media: DataFrame, before: Column) -> DataFrame:
    """Unfinished uploads from before a time whose object never came."""
    from .eventlog import unfinished_before

    return unfinished_before(log, "media.upload", before).join(media.select("idempotency_key"), "idempotency_key", "left_anti")
