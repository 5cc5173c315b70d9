"""Connected components by alternating large-star and small-star steps on DataFrames.

Labels are the smallest node of a component.  Links stay distributed: only a
count and a checksum per round come to the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_table, stored


def _forest(batches):
    """A spanning forest of the links of one partition, each node linked to its smallest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` of every node that some link of ``edges`` (its first two columns, long) touches.

    Links with a null end and links of a node to itself say nothing.  Without links there are no rows.
    """
    u, v = edges.columns[:2]
    links = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    links = stored(links.mapInArrow(_forest, "u long, v long").distinct(), "links")
    seen = None
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), "u")
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = F.min("v").over(Window.partitionBy("u"))
        ends = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v"))))
        small = large.withColumn("m", low).select(ends.alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        after = stored(small, "links")
        drop_table(links.sparkSession, links)
        links = after
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v"), F.col("v")).distinct().toDF("node", "component"))
