"""Vector tables as blocks: bounded groups of rows, each one binary value, searched block against block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK_ROWS, QUERY_ROWS = 16_384, 2_048


def usable(vectors: DataFrame, key: str, embedding: str, zero: bool) -> DataFrame:
    """``id, v`` of rows with a key whose vector is not null or empty and has finite components only; all-zero ones only if ``zero``."""
    odd = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(key).isNotNull() & (F.size(embedding) > 0) & ~odd)
    if not zero:
        rows = rows.where(F.exists(embedding, lambda x: x != 0))
    return rows.select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a group, one row per id (the smallest vector of a repeated one), by id."""
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    x = flat.reshape(len(ids), -1)
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = ids[1:] != ids[:-1]
    return ids[new], x[new]


def blocked(rows: DataFrame, size: int, build: Callable[[np.ndarray, np.ndarray], bytes], name: str) -> DataFrame:
    """Rows ``dim, block, data``: vectors of one length, dealt by a hash of their id to blocks of about ``size`` rows."""
    n = max(1, -(-rows.count() // size))

    def run(table: pa.Table) -> pa.Table:
        data = build(*matrix(table))
        return pa.table({"dim": table.column("dim").slice(0, 1), "block": table.column("block").slice(0, 1), "data": pa.array([data], pa.binary())})

    dealt = rows.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block"))
    return stored(dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, data binary"), name)


def searched(queries: DataFrame, index: DataFrame, search: Callable[[bytes, bytes], tuple], score: str, k: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query block against each index block of its length, then each query's best.

    ``search`` gives arrays of query ids, vector ids and scores, the best ``k`` of each query at least.
    """
    kind = pa.int64() if score == "long" else pa.float64()

    def run(batches):
        for batch in batches:
            for q, d in zip(batch.column("q").to_pylist(), batch.column("d").to_pylist(), strict=True):
                a, b, s = search(q, d)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, kind)], names=["query_id", "vec_id", "score"])

    # One row per pair of blocks; blocks are bounded, so their ids pair up here and the data follow by key.
    pairs = queries.select("dim", F.col("block").alias("qb")).join(index.select("dim", F.col("block").alias("db")), "dim")
    pairs = pairs.join(queries.select("dim", F.col("block").alias("qb"), F.col("data").alias("q")), ["dim", "qb"])
    pairs = pairs.join(index.select("dim", F.col("block").alias("db"), F.col("data").alias("d")), ["dim", "db"])
    found = pairs.repartition("dim", "qb", "db").select("q", "d").mapInArrow(run, f"query_id long, vec_id long, score {score}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
