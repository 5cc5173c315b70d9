"""Conflict-constrained best-fit packing of documents into fixed-length sequences.

Documents are cut into pieces of at most ``capacity`` tokens.  Pieces, longest
first, go to open bins ordered by residual room: the search starts at the
tightest bin with room and goes on to its successors until it meets one whose
bitmaps carry neither the piece's source nor its duplicate cluster.  So it is
the tightest compatible bin; without one, a new bin opens.

Documents are dealt to independent packing groups of bounded size by a hash of
their key (of the row, where many rows share a key or have none), or with an
order column in ranges of that order; a bin never spans groups, so the
constraints hold everywhere and no task grows with the input or with a hot
source or cluster.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD

GROUP_ROWS = 8192


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each (length, source bit, cluster bit) in the given order.

    Bits are masks: 0 conflicts with nothing.
    """
    order: list[tuple[int, int]] = []  # (residual, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    placed = []
    for length, source, cluster in items:
        at, n = bisect_left(order, (length, -1)), len(order)
        while at < n and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < n:
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= source
        clusters[b] |= cluster
        placed.append((b, capacity - residual))
        insort(order, (residual - length, b))
    return placed


def measured(docs: DataFrame, text: str = "text", cluster: str | None = None) -> DataFrame:
    """``docs`` with ``__tokens`` and ``__cluster`` in place of the text: all that ``pack`` needs of it."""
    body = F.coalesce(F.col(text), F.lit(""))
    same = F.col(cluster).cast("string") if cluster else F.when(F.trim(body) != "", F.md5(F.trim(F.regexp_replace(F.lower(body), r"\s+", " ")).cast("binary")))
    return docs.withColumns({"__tokens": F.regexp_count(body, F.lit(WORD)).cast("long"), "__cluster": same}).drop(text)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    capacity: int = 2048,
    group_rows: int = GROUP_ROWS,
    order: str | None = None,
) -> DataFrame:
    """Rows ``key, piece, bin_id, bin_offset, n_tokens``: each piece of each document and its place.

    Tokens are words.  Without a ``cluster`` column the cluster is the text itself, up to case and white space.
    Pieces of one document never share a bin.  Null and empty texts have one piece of no tokens and no cluster; it
    takes a place in a bin like any other.  A null source, and a null cluster, conflicts with nothing.  Repeated rows
    are packed one by one.  An empty table gives no rows.  ``docs`` may be ``measured`` before.

    With an ``order`` column of distinct positions from 0, a group is a range of ``group_rows`` positions (gaps leave it
    smaller) and bin ids follow the ranges; within a group bins are numbered by the first position in them.
    """
    if "__tokens" not in docs.columns:
        docs = measured(docs, text, cluster)
    if order:
        place = F.col(order).cast("long")
        group = F.floor(place / group_rows).cast("int")
    else:
        groups = max(1, -(-docs.count() // group_rows))
        docs = docs.withColumn("__k", F.coalesce(F.col(key).cast("string"), F.lit("")))
        # A key with a good part of a group's rows (no key counts as one) is dealt by rows; there are at most 16 such keys a group.
        hot = docs.groupBy("__k").agg(F.count("*").alias("__rows")).where(F.col("__rows") > group_rows // 16)
        docs = docs.withColumn("__salt", F.monotonically_increasing_id()).join(F.broadcast(hot), "__k", "left")
        salt = F.when(F.col("__rows").isNotNull(), F.col("__salt"))
        group, place = F.pmod(F.xxhash64("__k", salt), F.lit(groups)).cast("int"), F.lit(0).cast("long")
    rows = docs.select(F.col(key).alias("k"), F.col("__tokens").alias("n"), F.col(source).cast("string").alias("s"), F.col("__cluster").alias("c"), group.alias("g"), place.alias("p"))

    def run(table: pa.Table) -> pa.Table:
        # Keys stay in Arrow: in pandas a null among them would make doubles of integers.
        table = table.take(pc.sort_indices(table, sort_keys=[("n", "descending"), ("k", "ascending"), ("p", "ascending"), ("s", "ascending"), ("c", "ascending")]))
        pdf = table.drop_columns(["k"]).to_pandas()
        source_bit = {s: 1 << i for i, s in enumerate(sorted(pdf["s"].dropna().unique()))}
        counts = pdf["c"].value_counts()
        cluster_bit = {c: 1 << i for i, c in enumerate(sorted(counts.index[counts > 1]))}
        whole, tails, out = 0, [], []
        for i, (n, s, c) in enumerate(zip(pdf["n"], pdf["s"], pdf["c"], strict=True)):
            full, rest = divmod(int(n), capacity)
            if n and not rest:
                full, rest = full - 1, capacity
            for piece in range(full):
                out.append((i, piece, whole, 0, capacity))
                whole += 1
            tails.append((rest, source_bit.get(s, 0), cluster_bit.get(c, 0), i, full))
        tails.sort(key=lambda x: -x[0])
        for (b, offset), (rest, _, _, i, piece) in zip(best_fit([t[:3] for t in tails], capacity), tails, strict=True):
            out.append((i, piece, whole + b, offset, rest))
        got = pd.DataFrame(out, columns=["i", "piece", "bin", "bin_offset", "n_tokens"])
        if order:
            first = pd.Series(pdf["p"].to_numpy()[got["i"]]).groupby(got["bin"]).min().sort_values(kind="stable")
            got["bin"] = got["bin"].map(pd.Series(range(len(first)), index=first.index))
        return pa.table(
            {
                "key": table.column("k").take(pa.array(got["i"], pa.int64())),
                "piece": pa.array(got["piece"], pa.int32()),
                "bin_id": pa.array((int(pdf["g"].iloc[0]) << 32) + got["bin"], pa.int64()),
                "bin_offset": pa.array(got["bin_offset"], pa.int64()),
                "n_tokens": pa.array(got["n_tokens"], pa.int64()),
            }
        )

    kind = docs.schema[key].dataType.simpleString()
    packed = rows.groupBy("g").applyInArrow(run, f"key {kind}, piece int, bin_id long, bin_offset long, n_tokens long")
    return packed.withColumnRenamed("key", key)
