"""Predictors defined per (response, event) pair: similarity of each event to the latest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.operators.windows import WINDOW


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0),
                       lambda s, v: s + v)


def _or_zero(c: Column) -> Column:
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c).otherwise(0.0)


def similarity_pairs(windowed: DataFrame, vector: str, kind: str, into: str | None = None,
                     window: str = WINDOW) -> DataFrame:
    """Long form of a window with the similarity of each event's vector to the window's latest event.

    ``cosdist2D`` is the cosine *similarity* (the name is kept), ``eucldist2D`` the Euclidean
    distance; where they are not finite the value is 0.
    """
    into = into or kind
    kept = [F.col(f"`{c}`") for c in windowed.columns if c != window]
    # The latest vector (and its norm) is worked out once per window, then carried to its events.
    as_doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    base = windowed.select(*kept, window, as_doubles(F.element_at(window, -1)[vector]).alias("_base"))
    if kind == "cosdist2D":
        base = base.withColumn("_norm", F.sqrt(_dot(F.col("_base"), F.col("_base"))))
    long = base.withColumn("_e", F.explode(window)).withColumn("_v", as_doubles(F.col("_e")[vector]))
    a, b = F.col("_base"), F.col("_v")
    if kind == "cosdist2D":
        long = long.withColumn("_dot", _dot(a, b)).withColumn("_scale", F.sqrt(_dot(b, b)) * F.col("_norm"))
        value = F.when(F.col("_scale") != 0, F.col("_dot") / F.col("_scale"))
    elif kind == "eucldist2D":
        gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
        long = long.withColumn("_gap", gap)
        value = F.sqrt("_gap")
    else:
        raise ValueError(f"unknown pairwise predictor {kind!r}")
    return long.select(*kept, F.col("_e.time").alias("event_time"),
                       F.col("_e.rank").alias("event_rank"), _or_zero(value).alias(into))
