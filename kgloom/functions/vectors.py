"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero, so that it never wins a maximum."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def parsed(text: Column) -> Column:
    """`[0.1 0.2 ...]` as a vector; null if a component is no number."""
    parts = F.filter(F.split(F.regexp_replace(text, r"[\[\]]", ""), r"[\s,]+"), lambda t: t != "")
    out = F.transform(parts, lambda t: t.try_cast("double"))
    return F.when(F.forall(out, lambda x: x.isNotNull()) & (F.size(out) > 0), out)


def mean_by(df: DataFrame, keys: list[str], vector: str, name: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each key, with partial sums before the shuffle."""
    parts = df.select(*keys, F.posexplode(doubles(F.col(vector))).alias("_at", "_x"))
    sums = parts.groupBy(*keys, "_at").agg(F.avg("_x").alias("_x"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias(name))
