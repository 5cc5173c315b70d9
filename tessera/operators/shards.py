"""Key-range shards: assignment, metadata, ranking, graph subsets, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def shard_name(number: Column) -> Column:
    return F.format_string("shard-%05d", number.cast("int"))


def assign(docs: DataFrame, rows_per_shard: int, ranges: int | None = None) -> DataFrame:
    """``docs`` and ``shard_id``: contiguous ranges of ids, ``rows_per_shard`` rows each.

    Rows are range-partitioned, counted by partition, and ranked inside their partition from the count before it, so
    no task sees all rows.
    """
    parts = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = docs.repartitionByRange(parts, "id").withColumn("__part", F.spark_partition_id())
    sizes = cut.groupBy("__part").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = sizes.select("low", before.alias("before")).orderBy("low").collect()  # one row a partition
    if not start:
        return docs.withColumn("shard_id", F.lit(None).cast("string"))
    lows, offsets = F.array(*(F.lit(r.low) for r in start)), F.array(*(F.lit(r.before) for r in start))
    slot = F.size(F.filter(lows, lambda x: x <= F.col("id"))) - 1
    placed = docs.withColumn("__slot", slot)
    rank = F.get(offsets, F.col("__slot")) + F.row_number().over(Window.partitionBy("__slot").orderBy("id")) - 1
    return placed.withColumn("shard_id", shard_name(F.floor(rank / rows_per_shard))).drop("__slot")


def summary(sharded: DataFrame) -> DataFrame:
    return sharded.groupBy("shard_id").agg(F.count("*").alias("vector_rows"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def health(sharded: DataFrame, tombstoned: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """``shard_id, tombstone_ratio, graph_available``: the share of deleted rows, and whether any row has a mapping in ``graph``.

    Reads ids only, so a delete settles it without touching the vectors.
    """
    rows = sharded.select("id", "shard_id").withColumn("dead", F.lit(False)).withColumn("mapped", F.lit(False))
    for name, table in (("dead", tombstoned), ("mapped", graph)):
        if table is not None:
            named = table.select(F.col("doc_id").alias("id")).distinct().withColumn("__in", F.lit(True))
            rows = rows.join(named, "id", "left").withColumn(name, F.coalesce("__in", F.lit(False))).drop("__in")
    return rows.groupBy("shard_id").agg((F.count_if("dead") / F.count("*")).alias("tombstone_ratio"), F.max("mapped").alias("graph_available"))


def metadata(sharded: DataFrame, tombstoned: DataFrame | None = None, graph: DataFrame | None = None, media: DataFrame | None = None) -> DataFrame:
    """A row per shard: rows, bytes, centroid, share of deleted rows, whether it has graph rows, media it names."""
    size = F.octet_length(F.coalesce("content", F.lit(""))) + F.size("embedding") * 4 + F.octet_length("id")
    out = sharded.groupBy("shard_id").agg(F.count("*").alias("vector_rows"), F.sum(size).alias("size_bytes"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))
    out = out.join(V.centroids(sharded), "shard_id", "left").join(health(sharded, tombstoned, graph), "shard_id")
    return out.join(media, "shard_id", "left") if media is not None else out


def ranked(shards: DataFrame, query: list[float]) -> DataFrame:
    """``shards`` with ``rank_score``, best first.

    Squared distance to the centroid; a shard without a usable centroid scores minus its rows, and so comes first.
    Ties: more rows, then shard id.
    """
    usable = F.size(F.coalesce("centroid", F.array())) == len(query)
    score = F.when(usable, V.squared_l2("centroid", V.literal(query))).otherwise(-F.col("vector_rows").cast("double"))
    return shards.withColumn("rank_score", F.round(score, 6)).orderBy("rank_score", F.desc("vector_rows"), "shard_id")


def graph_subset(docs: DataFrame, doc_entities: DataFrame, entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph of one shard: mappings of its documents, their entities once each, and the distinct edges of their chunks.

    Edges without a chunk, or of another shard's chunk, are not part of it.
    """
    own = doc_entities.join(docs.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    named = entities.join(own.select(F.col("entity_id").alias("id")), "id", "left_semi").dropDuplicates(["id"])
    linked = edges.join(own.select("chunk_id"), "chunk_id", "left_semi").select(*edges.columns).distinct()
    return own, named, linked


def graph_subsets(docs: DataFrame, doc_entities: DataFrame, entities: DataFrame, edges: DataFrame, shard: str = "shard_id") -> dict[str, DataFrame]:
    """The tables of all shards in one pass, as ``graph_subset`` cuts them, each row with its ``shard``; ``docs`` carry it."""
    own = doc_entities.join(docs.select(F.col("id").alias("doc_id"), shard), "doc_id")
    named = entities.join(own.select(F.col("entity_id").alias("id"), shard).distinct(), "id")
    linked = edges.join(own.select("chunk_id", shard).distinct(), "chunk_id").select(*edges.columns, shard).distinct()
    return {"docs": docs, "doc_entities": own, "entities": named.dropDuplicates(["id", shard]), "edges": linked}


def reconstruct(parts: dict[str, DataFrame], shard: str = "shard_id") -> dict[str, DataFrame]:
    """One snapshot from the tables of all shards: entities once by id, the first shard's name; all other rows as they are."""
    out = {name: rows.drop(shard) for name, rows in parts.items() if name != "entities"}
    if "entities" in parts:
        out["entities"] = parts["entities"].groupBy("id").agg(F.min_by("name", shard).alias("name"))
    return out
