"""Registry of named queries over the shared test tables, each with SQL giving the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.functions.clock import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Clocks count hours from here (2024-01-01) so that delays keep their digits.
ORIGIN = 1_704_067_200_000_000


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"query {key!r} registered twice")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hours(c: Column) -> Column:
    return (micros(c) - ORIGIN) / F.lit(3.6e9)


def events(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select("event_id", "user_id", "event_type", "value", "props", hours(F.col("ts")).alias("time"))


def inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events X = clicks and views, responses Y = purchases."""
    ev = events(spark, sf)
    X = ev.where(F.col("event_type").isin("click", "view"))
    Y = ev.where(F.col("event_type") == "purchase").select(
        "event_id", "user_id", F.col("value").alias("y"), "time")
    return X, Y


def orders_series(spark: SparkSession, sf: str) -> DataFrame:
    """Orders on a daily clock: series with ties."""
    o = table(spark, sf, "orders")
    return o.withColumn("time", F.floor(micros(F.col("o_orderdate")) / F.lit(86_400_000_000)).cast("double"))


def rounded(df: DataFrame, places: int = 6, *names: str) -> DataFrame:
    """Doubles rounded for comparison; other columns as they are."""
    doubles = [n for n, t in df.dtypes if t == "double" and (not names or n in names)]
    return df.select(*[F.round(F.col(f"`{c}`"), places).alias(c) if c in doubles else F.col(f"`{c}`")
                       for c in df.columns])


EV = """ev AS (SELECT event_id, user_id, event_type, value, props,
  (epoch_us(ts) - 1704067200000000) / 3.6e9 AS time FROM events),
x AS (SELECT * FROM ev WHERE event_type IN ('click', 'view')),
y AS (SELECT event_id, user_id, value AS y, time FROM ev WHERE event_type = 'purchase')"""


def pairs_sql(history: int = 8, cutoff: float | None = None, extra: str = "", series: str = "x.user_id = y.user_id",
              strict: bool = False) -> str:
    """Windows written the naive way: a range join, then a rank filter."""
    bound = "x.time < y.time" if strict else "x.time <= y.time + 1.1920929e-07"
    cut = f"WHERE y_time - x_time <= {cutoff!r}" if cutoff else ""
    return f"""p AS (SELECT * FROM (
  SELECT y.event_id, y.user_id, y.y, y.time AS y_time, x.time AS x_time, x.event_id AS x_id, x.value AS v,
    x.event_type AS x_type, x.props AS x_props, y.time - x.time AS d {extra},
    row_number() OVER (PARTITION BY y.event_id ORDER BY x.time DESC, x.event_id DESC) AS back
  FROM y JOIN x ON {series} AND {bound}) WHERE back <= {history}),
q AS (SELECT * FROM p {cut})"""


def conv_sql(expr: str, history: int = 8, cutoff: float | None = None, name: str = "conv", strict: bool = False) -> str:
    """Per-response sum of an expression over ``d`` (delay) and ``v`` (value)."""
    return f"""WITH {EV}, {pairs_sql(history, cutoff, strict=strict)}
SELECT y.event_id, round(coalesce(sum({expr}), 0), 6) AS {name}
FROM y LEFT JOIN q ON y.event_id = q.event_id GROUP BY y.event_id"""
