"""Incremental indexing: the difference of two file lists, and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, change`` of a full outer join on the path: new, changed (hash or language), unchanged, deleted."""
    a, b = (t.select("path", F.col("hash").alias(f"hash_{s}"), F.coalesce("language", F.lit("")).alias(f"language_{s}")) for t, s in ((old, "old"), (new, "new")))
    change = (
        F.when(F.col("hash_old").isNull(), "new")
        .when(F.col("hash_new").isNull(), "deleted")
        .when((F.col("hash_old") == F.col("hash_new")) & (F.col("language_old") == F.col("language_new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, "path", "full_outer").select("path", change.alias("change"))


def tally(changes: DataFrame) -> DataFrame:
    return changes.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("new", "changed", "unchanged", "deleted")))


def stale_chunks(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Chunks of deleted and changed files."""
    return files.join(changes.where(F.col("change").isin("deleted", "changed")), "path", "left_semi").select(F.explode("chunk_ids").alias("id"))


def status(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(F.size("chunk_ids")), F.lit(0)).alias("chunks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))


def refreshed(files: DataFrame, chunks: DataFrame, found: DataFrame, changes: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The file list and the chunk list after a scan.

    ``files`` and ``chunks`` are the lists before, ``found`` the scan (``path, hash, language, size_bytes``), ``changes``
    their difference and ``fresh`` the chunks of new and changed files.  Unchanged files keep their rows and chunks; a
    file without chunks stays in the list, with none.
    """
    ids = fresh.groupBy("path").agg(F.array_sort(F.collect_list("id")).alias("chunk_ids"))
    touched = found.join(changes.where(F.col("change").isin("new", "changed")), "path", "left_semi").join(ids, "path", "left")
    touched = touched.withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>"))).select(*files.columns)
    kept = files.join(changes.where("change = 'unchanged'"), "path", "left_semi").unionByName(touched)
    return kept, chunks.join(stale_chunks(files, changes), "id", "left_anti").unionByName(fresh.select(*chunks.columns))
