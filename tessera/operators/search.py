"""Vector search: exact top-k, batches, shard-local top-k, late materialisation and the code-search filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def with_distance(docs: DataFrame, query: list[float], round_to: int | None = V.ROUND) -> DataFrame:
    """``docs`` and the L2 distance to one query, a literal: no join."""
    d = V.l2("embedding", V.literal(query))
    return docs.withColumn("distance", F.round(d, round_to) if round_to is not None else d)


def top_k(docs: DataFrame, query: list[float], k: int, wide: bool = True) -> DataFrame:
    """The ``k`` nearest rows, ties by id.  Narrow: id and distance only, the first phase of late materialisation."""
    columns = ["id", "content", "distance", "media_refs"] if wide else ["id", "distance"]
    ranked = with_distance(docs, query).orderBy("distance", "id").limit(k)
    return ranked.select(*[c for c in columns if c in ranked.columns])


def as_expanded(hits: DataFrame) -> DataFrame:
    """Vector hits in the shape of graph hits: similarity as score, no graph score."""
    return hits.withColumn("graph_score", F.lit(0.0)).withColumn("score", V.similarity("distance"))


def within(hits: DataFrame, max_distance: float | None) -> DataFrame:
    """The inclusive distance filter, applied after the cut to ``k``."""
    return hits if max_distance is None else hits.where(F.col("distance") <= F.lit(float(max_distance)))


def hydrate(refs: DataFrame, docs: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Payload of ranked references, which are at most k rows; references without a row are dropped, order is kept."""
    payload = docs.select(*keys, *[c for c in ("content", "media_refs") if c in docs.columns])
    return payload.join(F.broadcast(refs), list(keys)).select(*refs.columns, *[c for c in ("content", "media_refs") if c in docs.columns]).orderBy("distance", "id")


def distances_of(docs: DataFrame, ids: DataFrame, query: list[float], payload: bool = False) -> DataFrame:
    """Distances of the documents named in ``ids``, with their payload if asked."""
    chosen = docs.join(ids.select("id").distinct(), "id", "left_semi")
    out = with_distance(chosen, query)
    return out.select("id", "distance", *([c for c in ("content", "media_refs") if c in docs.columns] if payload else []))


def local_top_k(docs: DataFrame, query: list[float], k: int, shard: str = "shard_id") -> DataFrame:
    """The ``k`` nearest of each shard; Spark prunes with a group limit before the shuffle."""
    near = Window.partitionBy(shard).orderBy("distance", "id")
    narrow = with_distance(docs, query).select(shard, "id", "distance")
    return narrow.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)


def merge(parts: DataFrame, k: int, order: tuple[str | Column, ...] = ("distance", "id")) -> DataFrame:
    return parts.orderBy(*order).limit(k)


def two_phase(docs: DataFrame, query: list[float], k: int, shard: str = "shard_id", multiplier: int = 2) -> DataFrame:
    """Shard-local references, global merge, then the payload of the winners."""
    refs = merge(local_top_k(docs, query, k * multiplier, shard).drop("rank"), k)
    return hydrate(refs, docs, (shard, "id"))


def _blocks(rows: DataFrame, name: str, blocks: int) -> DataFrame:
    """``<name>b, <name>_ids, <name>_vectors``: rows of ``id, embedding`` gathered by a hash of the id in so many blocks."""
    dealt = rows.select("id", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias(f"{name}b"))
    return dealt.groupBy(f"{name}b").agg(F.collect_list("id").alias(f"{name}_ids"), F.collect_list("embedding").alias(f"{name}_vectors"))


def _nearest(x, q, k: int, cells: int = 1 << 22):
    """(rows of ``q``, rows of ``x``, distances) of what may be among each query's ``k`` nearest, rounded, ties included.

    A matrix product gives distances up to its rounding error; pairs within that error of the kth are computed anew.
    """
    import numpy as np

    xx, k = (x * x).sum(axis=1), min(k, len(x))
    longest = np.sqrt(xx.max())
    step = max(1, cells // len(x))
    for a in range(0, len(q), step):
        part = q[a : a + step]
        qq = (part * part).sum(axis=1)
        near = qq[:, None] + xx - 2 * (part @ x.T)
        slack = 1e-12 * (np.sqrt(qq) + longest) ** 2  # far above the error of sums of double products
        kth = np.maximum(np.partition(near, k - 1, axis=1)[:, k - 1] + slack, 0)
        most = (np.sqrt(kth) + 2 * 10.0**-V.ROUND) ** 2 + slack
        for b in range(0, len(part), 64):
            i, j = np.nonzero(near[b : b + 64] <= most[b : b + 64, None])
            yield a + b + i, j, np.round(np.sqrt(((x[j] - part[b + i]) ** 2).sum(axis=1)), V.ROUND)


def knn(docs: DataFrame, queries: DataFrame, k: int, docs_per_block: int = 8192, queries_per_block: int = 1024) -> DataFrame:
    """``query_id, id, distance, rank``: the ``k`` nearest documents of each query of a batch.

    ``queries`` holds ``query_id, embedding``.  Both sides are gathered in bounded blocks and each pair of blocks is
    one matrix product; only each query's best of a block leave a task.  Rows without a vector take no part.
    """
    import numpy as np
    import pandas as pd

    docs, queries = (t.where(F.col("embedding").isNotNull()) for t in (docs, queries))
    sides = docs.select(F.lit(1).alias("d")).unionByName(queries.select(F.lit(0).alias("d"))).agg(F.count_if(F.col("d") == 1), F.count_if(F.col("d") == 0)).first()
    nd, nq = (max(1, -(-n // size)) for n, size in zip(sides, (docs_per_block, queries_per_block), strict=True))
    cores = docs.sparkSession.sparkContext.defaultParallelism
    nd = max(nd, min(-(-cores // nq), -(-sides[0] // 1024)))  # small tables: a block for each core, if it is worth one
    d, q = _blocks(docs, "d", nd), _blocks(queries.select(F.col("query_id").alias("id"), "embedding"), "q", nq)
    pairs = d.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    kind = queries.schema["query_id"].dataType.simpleString()

    def scan(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                ids, names = np.asarray(r.d_ids), np.asarray(r.q_ids)
                x, v = (np.array(list(m), dtype=np.float64) for m in (r.d_vectors, r.q_vectors))
                for i, j, distance in _nearest(x, v, k):
                    found = pd.DataFrame({"query_id": names[i], "id": ids[j], "distance": distance}).sort_values(["query_id", "distance", "id"])
                    yield found.groupby("query_id", sort=False).head(k)

    found = pairs.join(q, "qb").repartition("db", "qb").mapInPandas(scan, f"query_id {kind}, id string, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def code_fanout(k: int) -> int:
    """How many hits a code search fetches before it filters them."""
    return max(200, 20 * k)


def _code_filter(path: str | None, language: str | None) -> Column:
    keep = F.lit(True)
    if path and path.strip():
        keep = keep & (F.instr("path", path.strip()) > 0)
    if language and language.strip():
        keep = keep & (F.lower("language") == language.strip().lower())
    return keep


def code_hits(hits: DataFrame, chunks: DataFrame, k: int, path: str | None = None, language: str | None = None) -> DataFrame:
    """The ``k`` nearest of ``hits``, at most a fanout of rows, that are code chunks under a path and of a language."""
    return chunks.join(F.broadcast(hits), "id").where(_code_filter(path, language)).orderBy("distance", "id").limit(k)


def code_search(docs: DataFrame, chunks: DataFrame, query: list[float], k: int, path: str | None = None, language: str | None = None, exact: bool = False) -> DataFrame:
    """Nearest code chunks under a path and a language.

    As retrieved: the nearest ``max(200, 20 k)`` first, then the filters, then ``k``.  Exact: the filters first.
    """
    if exact:
        chosen = chunks.where(_code_filter(path, language))
        return top_k(docs.join(chosen, "id", "left_semi"), query, k, wide=False).join(chunks, "id").orderBy("distance", "id")
    return code_hits(top_k(docs, query, code_fanout(k), wide=False), chunks, k, path, language)
