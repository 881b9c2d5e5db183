"""Vector arithmetic on array columns, in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where one vector is zero."""
    return let(norm(a) * norm(b), lambda length: F.when(length == 0, 0.0).otherwise(dot(a, b) / length))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return let(norm(a), lambda n: F.transform(a, lambda x: F.when(n == 0, 0.0).otherwise(x.cast("double") / n)))


def softmax(scores: Column) -> Column:
    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda t, x: t + x)
        return let(total, lambda t: F.transform(powers, lambda x: x / t))

    def from_top(top: Column) -> Column:
        return let(F.transform(scores, lambda x: F.exp(x - top)), shares)

    return let(F.array_max(scores), from_top)


def best_of(scores: Column) -> Column:
    """``struct(index, score)`` of the largest entry; the first one on ties, index from 0."""
    return let(
        scores,
        lambda s: F.struct(
            (F.array_position(s, F.array_max(s)) - 1).cast("int").alias("index"), F.array_max(s).alias("score")
        ),
    )


def mean_vectors(df: DataFrame, keys: list[str], vector: str, name: str = "vector") -> DataFrame:
    """Mean vector per key; partial sums per entry before the shuffle."""
    entries = df.select(*keys, F.posexplode(vector).alias("_at", "_x"))
    means = entries.groupBy(*keys, "_at").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    # one struct per dimension of the vector
    gathered = means.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_all"))
    return gathered.select(*keys, F.transform("_all", lambda e: e["_x"]).alias(name))
