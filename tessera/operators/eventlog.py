"""The event log: idempotent append, the claim state machine, retention, pages and lineage, over one table of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VISIBILITY_SECONDS, SKEW_SECONDS, EVENT_DAYS, INBOX_DAYS = 300, 3600, 30, 7
TERMINAL = ("done", "dead")


def _seconds(n: int) -> Column:
    return F.make_interval(secs=F.lit(n))


def with_defaults(events: DataFrame, now: Column) -> DataFrame:
    return events.withColumn("status", F.coalesce("status", F.lit("pending"))).withColumn("created_at", F.coalesce("created_at", now)).withColumn("max_attempts", F.when(F.coalesce("max_attempts", F.lit(0)) > 0, F.col("max_attempts")).otherwise(3))


def deduplicated(events: DataFrame) -> DataFrame:
    """The first event of each (key, kind, base); an empty key is never a duplicate."""
    keyed = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    first = F.row_number().over(Window.partitionBy("idempotency_key", "kind", "kb_id").orderBy("created_at", "event_id"))
    unique = events.where(keyed).withColumn("__n", first).where("__n = 1").drop("__n")
    return unique.unionByName(events.where(~keyed))


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """The log with those events of the batch that it doesn't hold yet."""
    keyed = F.coalesce(F.col("idempotency_key"), F.lit("")) != ""
    new = deduplicated(batch)
    held = log.where(keyed).select("idempotency_key", "kind", "kb_id").distinct()
    fresh = new.where(keyed).join(held, ["idempotency_key", "kind", "kb_id"], "left_anti").select(*new.columns)
    return log.unionByName(fresh.unionByName(new.where(~keyed)), allowMissingColumns=True)


def find_by_key(log: DataFrame, probes: DataFrame) -> DataFrame:
    """The stored event of each probe (``idempotency_key, kind, kb_id``), null where there is none."""
    first = log.where("coalesce(idempotency_key, '') <> ''").groupBy("idempotency_key", "kind", "kb_id").agg(F.min_by("event_id", F.struct("created_at", "event_id")).alias("event_id"))
    return probes.join(first, ["idempotency_key", "kind", "kb_id"], "left")


def next_pending(log: DataFrame, kind: str, n: int = 1) -> DataFrame:
    """The oldest pending events of a kind."""
    return log.where((F.col("kind") == kind) & (F.col("status") == "pending")).orderBy("created_at", "event_id").limit(n)


def claim(log: DataFrame, kind: str, worker: str, now: Column, n: int = 1, visibility: int = VISIBILITY_SECONDS) -> DataFrame:
    """The log with its next pending events claimed: one more attempt, and a deadline."""
    chosen = next_pending(log, kind, n).select("event_id").withColumn("__claimed", F.lit(True))
    rows = log.join(F.broadcast(chosen), "event_id", "left")
    hit = F.coalesce("__claimed", F.lit(False))
    return (
        rows.withColumn("status", F.when(hit, "claimed").otherwise(F.col("status")))
        .withColumn("attempt", F.when(hit, F.col("attempt") + 1).otherwise(F.col("attempt")))
        .withColumn("claimed_by", F.when(hit, F.lit(worker)).otherwise(F.col("claimed_by") if "claimed_by" in log.columns else F.lit(None)))
        .withColumn("claimed_until", F.when(hit, now + _seconds(visibility)).otherwise(F.col("claimed_until")))
        .drop("__claimed")
    )


def acknowledged(log: DataFrame, ids: DataFrame) -> DataFrame:
    """The log with claimed events of ``ids`` done."""
    done = ids.select("event_id").distinct().withColumn("__done", F.lit(True))
    return log.join(done, "event_id", "left").withColumn("status", F.when(F.col("__done") & (F.col("status") == "claimed"), "done").otherwise(F.col("status"))).drop("__done")


def after_failure(log: DataFrame, failures: DataFrame) -> DataFrame:
    """The log after failures (``event_id, attempt[, error]``): dead at the last attempt, else pending again.

    A failure counts only against the attempt it names, and only while the event is claimed.
    """
    named = failures.select("event_id", F.col("attempt").alias("__attempt"), (F.col("error") if "error" in failures.columns else F.lit(None).cast("string")).alias("__error"))
    hit = (F.col("status") == "claimed") & (F.col("attempt") == F.col("__attempt"))
    new = F.when(F.coalesce(hit, F.lit(False)), F.when(F.col("attempt") >= F.col("max_attempts"), "dead").otherwise("pending")).otherwise(F.col("status"))
    out = log.join(named, "event_id", "left").withColumn("__hit", F.coalesce(hit, F.lit(False))).withColumn("status", new)
    if "last_error" in log.columns:
        out = out.withColumn("last_error", F.when(F.col("__hit"), F.col("__error")).otherwise(F.col("last_error")))
    return out.drop("__attempt", "__error", "__hit")


def stuck(now: Column) -> Column:
    """Claims that ran out, or that end more than an hour ahead (a skewed clock)."""
    return (F.col("status") == "claimed") & ((F.col("claimed_until") < now) | (F.col("claimed_until") > now + _seconds(SKEW_SECONDS)))


def requeued(log: DataFrame, now: Column) -> DataFrame:
    return log.withColumn("status", F.when(F.coalesce(stuck(now), F.lit(False)), "pending").otherwise(F.col("status")))


def retained(log: DataFrame, now: Column, days: int = EVENT_DAYS) -> DataFrame:
    """The log without terminal events older than the retention."""
    old = F.col("status").isin(*TERMINAL) & (F.col("created_at") < now - _seconds(days * 86_400))
    return log.where(~F.coalesce(old, F.lit(False)))


def inbox_retained(inbox: DataFrame, now: Column, days: int = INBOX_DAYS) -> DataFrame:
    return inbox.where(F.col("processed_at") >= now - _seconds(days * 86_400))


def mark_processed(inbox: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The inbox with new records, and the records that lost because their key was there: the first writer wins."""
    keys = ["worker_id", "idempotency_key"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("processed_at", "event_id"))
    ranked = batch.withColumn("__n", first)
    fresh = ranked.where("__n = 1").join(inbox.select(*keys), keys, "left_anti")
    won = inbox.unionByName(fresh.select(*inbox.columns))
    return won, ranked.join(fresh.select(*keys, "event_id", F.lit(1).alias("__n")), [*keys, "event_id", "__n"], "left_anti").select(*batch.columns)


def page(log: DataFrame, n: int = 1000, after: tuple | None = None) -> DataFrame:
    """A page in order of (created_at, event_id), from after a position."""
    if after is not None:
        at, name = F.lit(after[0]).cast(log.schema["created_at"].dataType), F.lit(after[1])
        log = log.where((F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("event_id") > name)))
    return log.orderBy("created_at", "event_id").limit(n)


def unfinished_before(log: DataFrame, kind: str, before: Column) -> DataFrame:
    return log.where((F.col("kind") == kind) & ~F.col("status").isin(*TERMINAL) & (F.col("created_at") <= before))


def oldest_child(log: DataFrame) -> DataFrame:
    """``causation_id, kind, event_id``: the oldest event of each kind that an event caused."""
    return log.where("causation_id is not null").groupBy("causation_id", "kind").agg(F.min_by("event_id", F.struct("created_at", "event_id")).alias("event_id"))


def lineage(log: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """``root, event_id, kind, depth``: what each root caused, step by step.

    ``roots`` holds ``event_id``.  The depth cap ends cycles; each step is one equi-join on the causation.
    """
    level = roots.select(F.col("event_id").alias("root"), "event_id").join(log.select("event_id", "kind"), "event_id").select("root", "event_id", "kind", F.lit(0).alias("depth"))
    every, children = level, log.select("causation_id", F.col("event_id").alias("child"), F.col("kind").alias("child_kind")).where("causation_id is not null")
    for d in range(1, depth + 1):
        level = level.join(children, level["event_id"] == children["causation_id"]).select("root", F.col("child").alias("event_id"), F.col("child_kind").alias("kind"), F.lit(d).alias("depth"))
        every = every.unionByName(level)
    return every


def terminal(log: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """``root, event_id, kind``: the event that ends each operation: published, else media uploaded, else failed."""
    rank = F.when(F.col("kind") == "kb.published", 0).when(F.col("kind") == "media.uploaded", 1).when(F.col("kind") == "worker.failed", 2)
    ends = lineage(log, roots, depth).withColumn("__rank", rank).where("__rank is not null")
    return ends.groupBy("root").agg(F.min_by(F.struct("event_id", "kind"), F.struct("__rank", "depth", "event_id")).alias("x")).select("root", "x.event_id", "x.kind")


STAGES = ["document.upsert", "document.chunked", "document.embedded", "document.graph_extracted", "kb.published"]


def stages(log: DataFrame, roots: DataFrame, depth: int = 8) -> DataFrame:
    """``root, depth, stage, event_id, failed``: the chain of stages of each operation, each with whether a failure hangs on it."""
    walk = lineage(log, roots, depth).where(F.col("kind").isin(*STAGES))
    first = walk.groupBy("root", "depth").agg(F.min_by(F.struct("event_id", "kind"), "event_id").alias("x")).select("root", "depth", "x.event_id", F.col("x.kind").alias("stage"))
    failed = log.where("kind = 'worker.failed'").select(F.col("causation_id").alias("event_id")).distinct().withColumn("failed", F.lit(True))
    return first.join(failed, "event_id", "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def child(parent: DataFrame, kind: str, payload: Column, now: Column) -> DataFrame:
    """An event caused by each parent: same base and correlation, a key made of the parent's id and the kind."""
    name = F.concat(F.lit("evt_"), F.format_string("%013d", F.unix_millis(now.cast("timestamp"))), F.lit("_"), F.left(F.sha2(F.concat_ws("/", "event_id", F.lit(kind)), 256), F.lit(16)))
    return parent.select(
        name.alias("event_id"), "kb_id", F.lit(kind).alias("kind"), payload.alias("payload"), F.coalesce("correlation_id", "event_id").alias("correlation_id"), F.col("event_id").alias("causation_id"),
        F.concat_ws("/", "event_id", F.lit(kind)).alias("idempotency_key"), F.lit("pending").alias("status"), F.lit(0).alias("attempt"), F.lit(3).alias("max_attempts"), now.alias("created_at"),
    )
