"""Metric roll-ups and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT = 200


def _at_least_zero(c: str) -> Column:
    return F.greatest(F.col(c), F.lit(0))


def routes(requests: DataFrame) -> DataFrame:
    """Count, errors and latencies of each route."""
    ms = _at_least_zero("latency_ms")
    return requests.groupBy("route").agg(
        F.count("*").alias("count"), F.sum(F.when(F.col("status") >= 400, 1).otherwise(0)).alias("errors"), F.sum(ms).alias("latency_sum"), F.min(ms).alias("latency_min"), F.max(ms).alias("latency_max")
    )


def by_key(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Count, and sum and maximum of each value, negatives counting as zero."""
    aggs = [F.count("*").alias("count")]
    for v in values:
        aggs += [F.sum(_at_least_zero(v)).alias(f"{v}_sum"), F.max(_at_least_zero(v)).alias(f"{v}_max")]
    return rows.groupBy(*keys).agg(*aggs)


def gauges(rows: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, at).alias(value))


def outcomes(log: DataFrame) -> DataFrame:
    """Events by kind and outcome, and attempts."""
    outcome = F.when(F.col("status") == "done", "success").when(F.col("status") == "dead", "dead").when(F.col("status") == "claimed", "running").otherwise("waiting")
    return log.groupBy("kind", outcome.alias("outcome")).agg(F.count("*").alias("count"), F.sum("attempt").alias("attempts"))


def recent(requests: DataFrame, n: int = RECENT, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The last ``n`` rows, newest first."""
    return requests.orderBy(*(F.desc(c) for c in order)).limit(n)


def percentiles(rows: DataFrame, value: str, points: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    """Exact order statistics at index ``n * p / 100``."""
    cuts = rows.groupBy().agg(F.count(value).alias("n"))
    ranked = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(F.lit(0)).orderBy(value))
    counted = ranked.withColumn("upto", upto).crossJoin(F.broadcast(cuts))  # cuts is one row
    at = {p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1) for p in points}
    return counted.agg(*(F.min(F.when(F.col("upto") > at[p], F.col(value))).alias(f"p{p}") for p in points))


def label_escaped(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def open_metrics(rows: DataFrame, name: str, label: str, value: str, kind: str = "counter") -> DataFrame:
    """Lines of the OpenMetrics text format: a type line, then one sample a row by label."""
    line = F.concat(F.lit(f"{name}{{{label}=\""), label_escaped(label), F.lit('"} '), F.col(value).cast("string"))
    head = rows.sparkSession.createDataFrame([("", f"# TYPE {name} {kind}")], "ord string, line string")
    return head.unionByName(rows.select(F.col(label).alias("ord"), line.alias("line"))).orderBy("ord").select("line")


def rate_limited(requests: DataFrame, rate: float = 10.0, burst: float = 20.0, key: str = "ip", at: str = "ts") -> DataFrame:
    """``requests`` with ``allowed``: a token bucket per key, replayed in time order.

    Keys are sorted in the exchange and folded batch by batch: a task holds one batch and one bucket, however long a
    key's history is.  A null key is a key; rows without a time come first and cost a token each.
    """
    seconds = F.coalesce(F.col(at).cast("timestamp").cast("double"), F.lit(float("-inf")))
    marked = requests.withColumn("__k", F.struct(F.col(key).isNull().alias("none"), F.col(key).cast("string").alias("k")).cast("string")).withColumn("__s", seconds)

    def fold(batches):
        import pandas as pd

        current, tokens, last = None, burst, None
        for pdf in batches:
            out = []
            for k, s in zip(pdf["__k"], pdf["__s"], strict=True):
                if k != current:
                    current, tokens, last = k, burst, s
                if s > last:
                    tokens = min(burst, tokens + (s - last) * rate)
                    last = s
                out.append(tokens >= 1)
                tokens -= out[-1]
            yield pdf.assign(allowed=pd.Series(out, index=pdf.index, dtype="bool")).drop(columns=["__k", "__s"])

    schema = requests.withColumn("allowed", F.lit(True)).schema
    return marked.repartition("__k").sortWithinPartitions("__k", "__s").mapInPandas(fold, schema)
