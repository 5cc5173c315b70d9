"""The shard planner: which shards a query reads.  It works on the manifest, one small row per shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search, shards
from ..policy import DimensionMismatch, GraphUnavailable, ShardingPolicy


@dataclass(frozen=True)
class QueryPlan:
    shard_ids: list[str]
    fanout: int
    two_phase: bool
    capped: bool


def plan(manifest: DataFrame, query: list[float], k: int, policy: ShardingPolicy, graph: bool = False, exact: bool = False) -> QueryPlan:
    """All shards of a small table, or of any if the answer must be ``exact``; else the nearest ``fanout`` by centroid."""
    found = manifest
    if graph:
        found = found.where("graph_available")
    total = found.count()
    if graph and not total:
        raise GraphUnavailable("no shard of the selection has graph data")
    fanout = total if exact or total <= policy.small_kb_shards else policy.fanout_for(total)
    capped = fanout < total
    best = shards.ranked(found, query).select("shard_id", F.size(F.coalesce("centroid", F.array())).alias("dim"))
    chosen = best.limit(fanout).collect()  # at most the small base's shards, or the fanout; if exact, a small row a shard
    for row in chosen:
        if row["dim"] > 0 and row["dim"] != len(query):
            raise DimensionMismatch(f"query vector has {len(query)} components, shard {row['shard_id']} {row['dim']}")
    return QueryPlan([r["shard_id"] for r in chosen], len(chosen), len(chosen) > 1 and policy.local_top_k(k) > k, capped)


def vector_search(docs: DataFrame, manifest: DataFrame, query: list[float], k: int, policy: ShardingPolicy, max_distance: float | None = None, exact: bool = False) -> DataFrame:
    """Planned top-k: the shard ids become a literal partition filter, which prunes the scan; ``exact`` scans all shards."""
    chosen = plan(manifest, query, k, policy, exact=exact)
    part = docs if exact else docs.where(F.col("shard_id").isin(chosen.shard_ids))
    hits = search.two_phase(part, query, k, multiplier=policy.local_top_k_multiplier) if chosen.two_phase else search.top_k(part, query, k)
    return search.within(search.as_expanded(hits), max_distance)
