"""Compaction of shards and delayed removal of what it replaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..policy import ShardingPolicy


def size_tier(size: Column | str, target: int) -> Column:
    """Distance from the target size in powers of two, halves away from zero."""
    size = F.col(size) if isinstance(size, str) else size
    return F.round(F.log2(size / F.lit(float(target)))).cast("int")


def tiers(shards: DataFrame, target: int) -> DataFrame:
    return shards.where("size_bytes > 0").withColumn("tier", size_tier("size_bytes", target))


def densest(tiered: DataFrame) -> DataFrame:
    """``tier, n``: the tier of most shards; ties by closeness to the target, then the smaller tier."""
    return tiered.groupBy("tier").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.abs("tier"), "tier").limit(1)


def pressured(shards: DataFrame, threshold: float, limit: int = 4) -> DataFrame:
    """Shards with many deleted rows, worst and smallest first."""
    return shards.where((F.col("size_bytes") > 0) & (F.col("tombstone_ratio") >= threshold)).orderBy(F.desc("tombstone_ratio"), "size_bytes", "shard_id").limit(limit)


def candidates(shards: DataFrame, policy: ShardingPolicy, limit: int = 4) -> tuple[DataFrame | None, str]:
    """Shards to merge and why: enough shards at all, then the densest tier, then deleted rows; two at least."""
    if not policy.compaction or shards.count() < policy.compaction_min_shards:
        return None, "no debt"
    tiered = tiers(shards, policy.target_shard_bytes)
    best = densest(tiered).first()
    if best is not None and best["n"] >= 2:
        same = tiered.where(F.col("tier") == best["tier"])
        return same.orderBy(F.desc("tombstone_ratio"), "size_bytes", "shard_id").limit(limit).drop("tier"), "size tier"
    worst = pressured(shards, policy.compaction_tombstone_ratio, limit)
    if worst.count() >= 2:
        return worst, "deleted rows"
    return None, "no candidates"


def replaced(order: list[str], gone: list[str], new: str) -> list[str]:
    """The shard list with the merged one where the first of the replaced stood."""
    out: list[str] = []
    for s in order:
        if s not in gone:
            out.append(s)
        elif new not in out:
            out.append(new)
    return out


def gc_plan(queue: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """What to do with each queued shard: wait, keep (the manifest names it again), or delete."""
    live = active.select("kb_id", "shard_key").distinct().withColumn("live", F.lit(True))
    action = F.when(F.col("not_before") > now, "wait").when(F.col("live"), "keep").otherwise("delete")
    return queue.join(live, ["kb_id", "shard_key"], "left").withColumn("action", action).drop("live")


def gc_tally(plan: DataFrame) -> DataFrame:
    return plan.agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("delete", "keep", "wait")))


def merged_metadata(parts: DataFrame) -> DataFrame:
    """Totals of shards that become one; media ids are kept."""
    return parts.agg(F.sum("size_bytes").alias("size_bytes"), F.sum("vector_rows").alias("vector_rows"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("media_ids", F.array().cast("array<string>")))))).alias("media_ids"))


def lru_evictions(entries: DataFrame, budget: int, ttl_seconds: int, now: Column, protected: list[str] | None = None) -> DataFrame:
    """``entries`` (``kb_id, bytes, last_touch``) with a verdict: expired, over the budget (oldest first until under it), or kept.

    The list holds one row per cached base of a machine, so one ordered window is enough.
    """
    expired = F.col("last_touch") < now - F.make_interval(secs=F.lit(ttl_seconds)) if ttl_seconds > 0 else F.lit(False)
    safe = F.col("kb_id").isin(*(protected or [""]))
    rows = entries.withColumn("expired", expired & ~safe)
    stays = F.when(~F.col("expired"), F.col("bytes")).otherwise(0)
    total = F.sum(stays).over(Window.partitionBy(F.lit(0)))
    before = F.coalesce(F.sum(F.when(safe, 0).otherwise(stays)).over(Window.partitionBy(F.lit(0)).orderBy("last_touch", "kb_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = (total - before > budget) & ~safe if budget > 0 else F.lit(False)
    return rows.withColumn("verdict", F.when(F.col("expired"), "expired").when(over, "over budget").otherwise("kept")).drop("expired")
