"""Vector expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUND = 6


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    """Sum of squared differences in double precision; null if the lengths differ."""
    a, b = _col(a), _col(b)
    gap = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x)


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(squared_l2(a, b))


def similarity(distance: Column | str) -> Column:
    return 1 / (1 + _col(distance))


def rounded(x: Column | str, nudge: float = 0.0) -> Column:
    """Six decimals; graph sums that land on half-way decimals take a nudge so that every engine rounds them alike."""
    return F.round(_col(x) + F.lit(nudge), ROUND)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x))


def normalised(v: Column | str) -> Column:
    """Unit length; null for a zero vector."""
    v = _col(v)
    return F.when(norm(v) > 0, F.transform(v, lambda x: (x.cast("double") / norm(v)).cast("float")))


def added(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x + y)


def scaled(v: Column | str, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(factor)
    return F.transform(_col(v), lambda x: (x * factor).cast("float"))


def to_float(v: Column | str) -> Column:
    return _col(v).cast("array<float>")


def rounded_signed(x: Column, digits: int) -> Column:
    """Half away from zero; as in IEEE arithmetic, and unlike ``round``, negative numbers that round to zero give -0.0."""
    return F.signum(x) * F.round(F.abs(x), digits)


def to_text(v: Column | str) -> Column:
    """``[a, b]`` with six decimals, halves to even as ``printf`` in C has it: Java's format rounds them up.

    A single-precision number lies half-way between six decimals only if it is an odd multiple of 1/128.
    """

    def decimals(x: Column) -> Column:
        x = x.cast("double")
        return F.format_string(f"%.{ROUND}f", F.when(F.abs(x * 128) % 2 == 1, F.bround(x, ROUND)).otherwise(x))

    return F.concat(F.lit("["), F.array_join(F.transform(_col(v), decimals), ", "), F.lit("]"))


def from_text(text: Column | str) -> Column:
    return F.from_json(_col(text), "array<float>")


def of_dimension(v: Column | str, dimension: int) -> Column:
    """The vector itself; a row with another length fails the query."""
    v = _col(v)
    return F.when(F.size(v) == dimension, v).otherwise(F.raise_error(F.concat(F.lit(f"vector dimension is not {dimension}: "), F.size(v).cast("string"))))


def centroids(docs: DataFrame, key: str = "shard_id", embedding: str = "embedding") -> DataFrame:
    """``key, centroid``: the mean of each dimension, summed in double precision; empty vectors are skipped."""
    cells = docs.where(F.size(embedding) > 0).select(key, F.posexplode(embedding).alias("pos", "x"))
    means = cells.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    cells = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy(key).agg(F.transform(cells, lambda c: c["m"].cast("float")).alias("centroid"))
