"""Options, their defaults and their validation."""

from __future__ import annotations

import random
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

MIB = 1 << 20


class InvalidRequest(ValueError):
    """A request that no plan is built for."""


class GraphUnavailable(RuntimeError):
    """A graph search over data without graph tables."""


class DimensionMismatch(ValueError):
    """A vector of another length than the table's."""


@dataclass(frozen=True)
class ShardingPolicy:
    shard_trigger_bytes: int = 64 * MIB
    shard_trigger_rows: int = 150_000
    target_shard_bytes: int = 32 * MIB
    max_rows_per_shard: int = 75_000
    fanout: int = 4
    adaptive_max_fanout: int = 6
    parallelism: int = 4
    local_top_k_multiplier: int = 2
    small_kb_shards: int = 2
    compaction: bool = True
    compaction_min_shards: int = 8
    compaction_tombstone_ratio: float = 0.20

    def rows_per_shard(self, file_bytes: int, rows: int) -> int:
        """Rows that fit the target size at the present bytes per row, one at least."""
        if rows <= 0 or file_bytes <= 0:
            return 1
        return max(1, self.target_shard_bytes // max(1, file_bytes // rows))

    def fanout_for(self, shards: int) -> int:
        wide = max(1, self.fanout)
        if self.adaptive_max_fanout > 0:
            wide = min(wide, self.adaptive_max_fanout)
        return min(wide, shards)

    def local_top_k(self, k: int) -> int:
        return k * max(1, self.local_top_k_multiplier)


@dataclass(frozen=True)
class Expansion:
    """How far a graph search goes; values out of range fall back to the defaults, zero hops and zero alpha stand."""

    seed_k: int = 0
    hops: int = 2
    max_neighbors: int = 25
    alpha: float = 0.7
    decay: float = 0.7
    max_entities: int = 1000
    edge_types: tuple[str, ...] = ()

    def normalised(self, top_k: int) -> Expansion:
        return replace(
            self,
            seed_k=self.seed_k if self.seed_k > 0 else max(top_k, 10),
            hops=self.hops if self.hops >= 0 else 2,
            max_neighbors=self.max_neighbors if self.max_neighbors > 0 else 25,
            alpha=self.alpha if 0 <= self.alpha <= 1 else 0.7,
            decay=self.decay if 0 < self.decay <= 1 else 0.7,
            max_entities=self.max_entities if self.max_entities > 0 else 1000,
            edge_types=tuple(self.edge_types),
        )


@dataclass(frozen=True)
class SearchOptions:
    mode: str = "vector"
    top_k: int = 10
    max_distance: float | None = None
    expansion: Expansion = field(default_factory=Expansion)
    adaptive_min_similarity: float = 0.35

    def normalised(self) -> SearchOptions:
        if self.top_k <= 0:
            raise InvalidRequest("top_k must be positive")
        if self.max_distance is not None and not self.max_distance > 0:
            raise InvalidRequest("max_distance must be positive when set")
        floor = self.adaptive_min_similarity if 0 < self.adaptive_min_similarity <= 1 else 0.35
        return replace(self, mode=parse_mode(self.mode), expansion=self.expansion.normalised(self.top_k), adaptive_min_similarity=floor)


MODES = ("vector", "graph", "adaptive")


def parse_mode(mode: str | None) -> str:
    name = (mode or "").strip().lower() or "vector"
    if name not in MODES:
        raise InvalidRequest(f"unknown search mode {mode!r}")
    return name


def validate_query(vector: list[float], dimension: int | None = None) -> list[float]:
    if not vector:
        raise InvalidRequest("query vector is empty")
    if dimension is not None and len(vector) != dimension:
        raise DimensionMismatch(f"query vector has {len(vector)} components, the table {dimension}")
    return [float(x) for x in vector]


SAFE = re.compile(r"^[A-Za-z0-9_.-]+$")


def safe_identifier(name: str) -> str:
    if not SAFE.match(name or ""):
        raise InvalidRequest(f"unsafe identifier {name!r}")
    return name


def quadratic_backoff(attempt: int) -> float:
    return attempt * attempt * 0.010


def exponential_backoff(attempt: int, first: float = 0.1, most: float = 2.0) -> float:
    return min(first * 2**attempt, most)


def manifest_backoff(attempt: int) -> float:
    return 0.010 * 2**attempt + random.uniform(0, 0.005)


def with_retry(action: Callable, attempts: int, retryable: tuple[type[Exception], ...], delay: Callable[[int], float] = quadratic_backoff):
    """Call ``action`` up to ``attempts`` times while it raises a retryable error."""
    for attempt in range(1, attempts + 1):
        try:
            return action()
        except retryable:
            if attempt == attempts:
                raise
            time.sleep(delay(attempt))
    raise InvalidRequest("attempts must be positive")
