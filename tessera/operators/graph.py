"""Graph-expanded and adaptive search over documents, entities and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..policy import Expansion, GraphUnavailable, SearchOptions
from . import search


def mapping_weight() -> Column:
    """Weight of a document-entity row: null and non-positive count as one."""
    w = F.coalesce("weight", F.lit(1.0))
    return F.when(w <= 0, 1.0).otherwise(w)


def seeds(docs: DataFrame, query: list[float], k: int) -> DataFrame:
    return search.top_k(docs, query, k, wide=False)


def seed_scores(doc_entities: DataFrame, seed_docs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``node, s``: weight of each entity over the seed documents, which are a bounded number of rows (of each shard, ``by`` its column)."""
    few = seed_docs.select(*by, F.col("id").alias("doc_id"))
    hit = doc_entities.join(few if by else F.broadcast(few), [*by, "doc_id"])
    return hit.where("entity_id <> ''").groupBy(*by, F.col("entity_id").alias("node")).agg(F.sum(mapping_weight()).alias("s"))


def neighbours(edges: DataFrame, cap: int, edge_types: tuple[str, ...] = (), by: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, w``: edges in both directions, the ``cap`` heaviest of each source (in each shard).

    Types are filtered first; weight null counts as one; zero weights count in the cap and are dropped by the walk.
    """
    if edge_types:
        edges = edges.where(F.col("rel_type").isin(*edge_types))
    w = F.coalesce("weight", F.lit(1.0)).alias("w")
    both = edges.select(*by, "src", "dst", w, "rel_type", "chunk_id").unionByName(edges.select(*by, F.col("dst").alias("src"), F.col("src").alias("dst"), w, "rel_type", "chunk_id"))
    rank = F.row_number().over(Window.partitionBy(*by, "src").orderBy(F.desc("w"), "dst", "rel_type", "chunk_id"))
    return both.withColumn("rank", rank).where(F.col("rank") <= cap).select(*by, "src", "dst", "w")


def step(frontier: DataFrame, capped: DataFrame, decay: float, by: tuple[str, ...] = ()) -> DataFrame:
    """One hop: each frontier score times edge weight times decay, summed by target; walks may come back."""
    walk = frontier.where("s > 0").withColumnRenamed("node", "src").join(capped.where("w > 0"), [*by, "src"])
    return walk.groupBy(*by, F.col("dst").alias("node")).agg(F.sum(F.col("s") * F.col("w") * F.lit(float(decay))).alias("s"))


def expand(start: DataFrame, capped: DataFrame, hops: int, decay: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``node, s``: the start's scores and those of all hops, summed."""
    frontier, every = start, start
    for _ in range(hops):
        frontier = step(frontier, capped, decay, by)
        every = every.unionByName(frontier)
    return every.groupBy(*by, "node").agg(F.sum("s").alias("s"))


def top_entities(scores: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    if not by:
        return scores.orderBy(F.desc("s"), "node").limit(n)
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("s"), "node"))).where(F.col("rank") <= n).drop("rank")


def doc_scores(doc_entities: DataFrame, scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``id, g``: each document's entity scores times weights.  ``scores`` is cut to the entity limit, and so is bounded (in each shard)."""
    named = scores.withColumnRenamed("node", "entity_id")
    hit = doc_entities.join(named if by else F.broadcast(named), [*by, "entity_id"])
    return hit.groupBy(*by, F.col("doc_id").alias("id")).agg(F.sum(F.col("s") * mapping_weight()).alias("g"))


def blend(docs: DataFrame, seed_docs: DataFrame, graph_scores: DataFrame, query: list[float], alpha: float, shard: str | None = None) -> DataFrame:
    """``id, distance, graph_score, score`` of seeds and scored documents.

    The graph score is normalised by the largest over all scored ids, also of those without a document; by shard if
    one is named.
    """
    keys = [shard] if shard else []
    top = graph_scores.groupBy(*keys).agg(F.greatest(F.max("g"), F.lit(0.0)).alias("m"))
    ids = seed_docs.select(*keys, "id").union(graph_scores.select(*keys, "id")).distinct()
    near = search.with_distance(docs, query).select(*keys, "id", "distance")
    rows = near.join(ids, [*keys, "id"], "left_semi").join(graph_scores, [*keys, "id"], "left")
    rows = rows.join(F.broadcast(top), keys, "left") if keys else rows.crossJoin(F.broadcast(top))  # one row (a shard)
    g = F.coalesce("g", F.lit(0.0))
    share = F.when(F.col("m") > 0, g / F.col("m")).otherwise(0.0)
    score = F.lit(float(alpha)) * V.similarity("distance") + F.lit(1.0 - float(alpha)) * share
    return rows.select(*keys, "id", "distance", g.alias("graph_score"), score.alias("score"))


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """Best first with scores at six decimals: score, then distance, then id."""
    out = rows.withColumn("graph_score", V.rounded("graph_score", 1e-9)).withColumn("score", V.rounded("score"))
    return out.orderBy(F.desc("score"), "distance", "id").limit(k)


def settled(few: DataFrame) -> DataFrame:
    """A result of bounded size as a local table, so that its later uses don't compute it again."""
    return few.sparkSession.createDataFrame(few.collect(), few.schema)


def graph_search(docs: DataFrame, doc_entities: DataFrame, edges: DataFrame, query: list[float], k: int, expansion: Expansion) -> DataFrame:
    """``id, distance, graph_score, score`` of the ``k`` best.

    Seeds (``seed_k`` rows) and entity scores (``max_entities`` rows) are settled on the way.
    """
    x = expansion.normalised(k)
    found = settled(seeds(docs, query, x.seed_k))
    start = seed_scores(doc_entities, found)
    scores = settled(top_entities(expand(start, neighbours(edges, x.max_neighbors, x.edge_types), x.hops, x.decay), x.max_entities))
    return ranked(blend(docs, found, doc_scores(doc_entities, scores), query, x.alpha), k)


def graph_search_by_shard(docs: DataFrame, doc_entities: DataFrame, edges: DataFrame, query: list[float], k: int, expansion: Expansion, shard: str = "shard_id") -> DataFrame:
    """``shard, id, distance, graph_score, score``: each shard searched on its own, as where shards are files, and the results merged.

    All tables carry the column ``shard``.  One plan searches every shard: its seeds, walks and limits are those of the shard.
    """
    x, by = expansion.normalised(k), (shard,)
    found = search.local_top_k(docs, query, x.seed_k, shard).select(shard, "id", "distance")
    scores = expand(seed_scores(doc_entities, found, by), neighbours(edges, x.max_neighbors, x.edge_types, by), x.hops, x.decay, by)
    best = doc_scores(doc_entities, top_entities(scores, x.max_entities, by), by)
    return ranked(blend(docs, found, best, query, x.alpha, shard), k)


def ensure_ready(doc_entities: DataFrame | None, edges: DataFrame | None) -> None:
    if doc_entities is None or edges is None or doc_entities.isEmpty() or edges.isEmpty():
        raise GraphUnavailable("graph tables are missing or empty")


def run(docs: DataFrame, doc_entities: DataFrame | None, edges: DataFrame | None, query: list[float], options: SearchOptions) -> DataFrame:
    """Dispatch by mode: ``id, distance, graph_score, score``."""
    o = options.normalised()
    vector = search.as_expanded(search.top_k(docs, query, o.top_k, wide=False)).withColumn("score", V.rounded("score"))
    if o.mode == "adaptive":
        best = vector.orderBy("distance", "id").first()
        if best is not None and best["score"] >= o.adaptive_min_similarity:
            return search.within(vector, o.max_distance)
    if o.mode in ("graph", "adaptive"):
        ensure_ready(doc_entities, edges)
        return search.within(graph_search(docs, doc_entities, edges, query, o.top_k, o.expansion), o.max_distance)
    return search.within(vector, o.max_distance)


def shortest_hops(start: DataFrame, edges: DataFrame, hops: int, cap: int, decay: float = 0.7, edge_types: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, hop, s``: fewest hops over undirected edges from each start node, the ``cap`` nearest of each source.

    ``start`` holds ``node, s``; a target's score is the source's times ``decay`` to the power of the hops.
    """
    if edge_types:
        edges = edges.where(F.col("rel_type").isin(*edge_types))
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    reached = start.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(0).alias("hop"))
    frontier = reached
    for h in range(1, hops + 1):
        ahead = frontier.select("src", F.col("dst").alias("via")).join(both.toDF("via", "dst"), "via").select("src", "dst").distinct()
        frontier = ahead.join(reached, ["src", "dst"], "left_anti").withColumn("hop", F.lit(h))
        reached = reached.unionByName(frontier)
    far = reached.where("hop > 0").withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("hop", "dst")))
    near = far.where(F.col("rank") <= cap).drop("rank").join(start.select(F.col("node").alias("src"), F.col("s").alias("s0")), "src")
    return near.select("src", "dst", "hop", (F.col("s0") * F.pow(F.lit(float(decay)), F.col("hop"))).alias("s"))
