"""Upserts, deletes and graph maintenance as anti-joins and unions over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..policy import InvalidRequest


def last_of_each(batch: DataFrame, order: str, key: str = "id") -> DataFrame:
    """The last row of each key of a batch, by its ordinal column, which is dropped."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return batch.withColumn("__last", last).where("__last = 1").drop("__last", order)


def upsert(docs: DataFrame, batch: DataFrame, order: str | None = None) -> DataFrame:
    """``docs`` with the batch's rows in place of those with the same ids.

    With ``order``, the last of equal ids in the batch wins; without, all of them stay, as in a bulk load.
    """
    rows = last_of_each(batch, order) if order else batch
    return docs.join(batch.select("id").distinct(), "id", "left_anti").unionByName(rows, allowMissingColumns=True)


def clear_tombstones(tombstones: DataFrame, batch: DataFrame) -> DataFrame:
    """Tombstones but those of ids that are written again."""
    return tombstones.join(batch.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_anti")


def soft_delete(tombstones: DataFrame, doc_entities: DataFrame | None, ids: DataFrame, now) -> tuple[DataFrame, DataFrame | None]:
    """Tombstones with the ids stamped ``now``, and the mappings without them; edges and entities stay."""
    named = ids.select(F.col("id").alias("doc_id")).distinct()
    stamped = tombstones.join(named, "doc_id", "left_anti").unionByName(named.withColumn("deleted_at", F.lit(now).cast("timestamp")), allowMissingColumns=True)
    return stamped, doc_entities.join(named, "doc_id", "left_anti") if doc_entities is not None else None


def active(docs: DataFrame, tombstones: DataFrame) -> DataFrame:
    return docs.join(tombstones.select(F.col("doc_id").alias("id")), "id", "left_anti")


def hard_delete(docs: DataFrame, tombstones: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and tombstones without the ids."""
    return docs.join(ids.select("id"), "id", "left_anti"), tombstones.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")


def prune_graph(doc_entities: DataFrame, edges: DataFrame, entities: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The graph without some documents: their mappings, the edges of their chunks, and entities that nothing names any more."""
    gone = doc_entities.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select("chunk_id").distinct()
    kept = doc_entities.join(ids.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
    left = edges.join(gone, "chunk_id", "left_anti").select(*edges.columns)
    return kept, left, entities.join(orphans(entities, kept, left).select("id"), "id", "left_anti")


def orphans(entities: DataFrame, doc_entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities with neither a mapping nor an edge: two anti-joins, not one over an OR."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()
    return entities.join(doc_entities.select(F.col("entity_id").alias("id")), "id", "left_anti").join(ends, "id", "left_anti")


def refresh_graph(tables: tuple[DataFrame, DataFrame, DataFrame], batch: tuple[DataFrame, DataFrame, DataFrame], ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mappings, edges and entities with those of some documents replaced; an entity's first name stays."""
    mapped, edges, entities = prune_graph(*tables, ids)
    new_mapped, new_edges, new_entities = batch
    named = entities.unionByName(new_entities.join(entities.select("id"), "id", "left_anti").dropDuplicates(["id"]))
    weight = F.when(F.coalesce("weight", F.lit(1.0)) <= 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    clean = new_edges.where("src <> '' and dst <> ''").withColumn("weight", weight)
    return mapped.unionByName(new_mapped.where("entity_id <> ''")), edges.unionByName(clean), named.where("id <> ''")


def checked_ids(ids: list[str]) -> list[str]:
    """Trimmed ids; an empty one is an error."""
    out = [i.strip() for i in ids]
    if not out or any(not i for i in out):
        raise InvalidRequest("ids must not be empty")
    return out
