"""Response curves as tables: grids, surfaces, integrals and contrasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echoframe.functions.kernels import Kernel
from echoframe.operators.series import COPIES, choose_layout, collapse, lay_out, with_halo


def time_grid(spark: SparkSession, upto: float = 5.0, points: int = 1000, start: float = 0.0) -> DataFrame:
    step = (upto - start) / (points - 1)
    return spark.range(points).select((F.col("id") * step + start).alias("t"))


def curves(grid: DataFrame, kernels: dict[str, Kernel], coefs: dict[str, float] | None = None) -> DataFrame:
    """Long table (term, t, irf): each kernel over the grid's ``t``, times its coefficient."""
    coefs = coefs or {}
    cells = [
        F.struct(F.lit(n).alias("term"), (k.column(F.col("t")) * F.lit(float(coefs.get(n, 1.0)))).alias("irf"))
        for n, k in kernels.items()
    ]
    rest = [F.col(c) for c in grid.columns]
    return grid.select(*rest, F.explode(F.array(*cells)).alias("_c")).select(*grid.columns, "_c.*")


def riemann(df: DataFrame, value: str, upto: float, points: int, by: Sequence[str] = ()) -> DataFrame:
    """Sum of the samples times support / number of points."""
    return df.groupBy(*by).agg((F.sum(value) * F.lit(upto / points)).alias("integral"))


def integral_table(spark: SparkSession, kernels: dict[str, Kernel], coefs: dict[str, float] | None = None,
                   upto: float = 5.0, points: int = 1000) -> DataFrame:
    return riemann(curves(time_grid(spark, upto, points), kernels, coefs), "irf", upto, points, ["term"])


def trapezoid(df: DataFrame, by: Sequence[str], at: str, value: str, mask: str | None = None,
              layout: str = "auto", at_most: int | None = None, blocks: int | None = None) -> DataFrame:
    """Trapezoid integral over irregular points per group; a single point gives its value.

    A segment counts by the mask of its right end.
    """
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    rows = df.select(*by, F.col(at).cast("double").alias("_at"), F.col(value).cast("double").alias("_v"),
                     m.alias("_m"))
    plan = choose_layout([rows], by, layout, at_most, blocks)
    if plan.kind == "blocks":
        # Between identical points lies no area, so their number matters only to the count.
        rows = collapse(rows)
    else:
        rows = rows.withColumn(COPIES, F.lit(1))
    laid = lay_out(rows, by, ["_at", "_v", "_m"], plan)
    w = Window.partitionBy(*laid.group).orderBy("_at", "_v", "_m")
    seg = with_halo(laid, before=1).select(
        "*", F.lag("_at").over(w).alias("_at0"), F.lag("_v").over(w).alias("_v0")).where("_halo = 0")
    area = (F.col("_v") + F.col("_v0")) / 2 * (F.col("_at") - F.col("_at0")) * F.col("_m")
    points = F.sum(COPIES)
    return seg.groupBy(*by).agg(
        points.alias("points"),
        F.when(points > 1, F.coalesce(F.sum(area), F.lit(0.0)))
        .otherwise(F.sum(F.col("_v") * F.col("_m"))).alias("integral"))


def axis_transform(c: Column, kind: str | None) -> Column:
    return {None: c, "exp": F.exp(c), "log": F.log(c), "neglog": -F.log(c)}[kind]


def surface(spark: SparkSession, value_range: tuple[float, float], upto: float, kernel: Kernel, coef: float,
            reference: float = 0.0, points: int = 32, transform: str | None = None) -> DataFrame:
    """Effect of a predictor over its values and delays, relative to a reference value.

    The two axes are enumerated from one range of points^2 ids.
    """
    low, high = value_range
    ids = spark.range(points * points)
    x = F.lit(low) + F.floor(F.col("id") / points) * ((high - low) / (points - 1))
    t = (F.col("id") % points) * (upto / (points - 1))
    return ids.select(x.alias("x"), t.alias("t")).select(
        axis_transform(F.col("x"), transform).alias("x"), "t",
        ((F.col("x") - F.lit(reference)) * kernel.column(F.col("t")) * F.lit(coef)).alias("effect"))


def manipulation_settings(df: DataFrame, names: Sequence[str], reference: str | float = 0.0,
                          indicators: Sequence[str] = (), span: float = 0.9
                          ) -> tuple[dict[str, float], dict[str, float], dict[str, tuple[float, float]]]:
    """Steps, references and axis ranges from training data, in one pass.

    A step is one standard deviation; the reference is 0 or the mean; an axis covers the central
    ``span`` of the values.  Indicators always refer to 0 and step by 1.
    """
    low, high = (1 - span) / 2, (1 + span) / 2
    aggs = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`").cast("double")
        aggs += [F.stddev_samp(c).alias(f"sd{i}"), F.avg(c).alias(f"m{i}"),
                 F.percentile_approx(c, [low, high], 100_000).alias(f"q{i}")]
    row = df.agg(*aggs).first()
    steps, refs, ranges = {}, {}, {}
    for i, n in enumerate(names):
        flag = n in indicators
        steps[n] = 1.0 if flag else row[f"sd{i}"]
        refs[n] = 0.0 if flag or reference != "mean" else row[f"m{i}"]
        ranges[n] = tuple(row[f"q{i}"])
    return steps, refs, ranges


def manipulations(df: DataFrame, coefs: dict[str, float], kernels: dict[str, Kernel], t: float,
                  steps: dict[str, float], references: dict[str, float]) -> DataFrame:
    """Response at delay ``t`` when each predictor moves by its step from its reference."""
    cells = []
    for n, b in coefs.items():
        weight = kernels[n].column(F.lit(t)) * F.lit(b)
        cells.append(F.struct(F.lit(n).alias("predictor"),
                              (weight * F.lit(references.get(n, 0.0))).alias("at_reference"),
                              (weight * F.lit(references.get(n, 0.0) + steps[n])).alias("at_step"),
                              (weight * F.lit(steps[n])).alias("effect")))
    return df.select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")



def contrast(tree) -> Column:
    """Nested pairs of estimate names: the second of a pair is subtracted from the first."""
    if isinstance(tree, str):
        return F.col(f"`{tree}`")
    left, right = tree
    return contrast(left) - contrast(right)


def contrasts(samples: DataFrame, trees: dict[str, object], by: Sequence[str] = (),
              level: float = 95.0, estimate: str = "estimate", name: str = "name",
              sample: str = "sample") -> DataFrame:
    """Mean and bounds over samples of differences between estimates.

    ``samples`` is long: one row per (by..., sample, name).  Bounds interpolate order statistics.
    """
    def leaves(t):
        return [t] if isinstance(t, str) else leaves(t[0]) + leaves(t[1])

    needed = sorted({x for t in trees.values() for x in leaves(t)})
    wide = samples.groupBy(*by, sample).pivot(name, needed).agg(F.first(estimate))
    cells = [F.struct(F.lit(k).alias("contrast"), contrast(t).alias("value")) for k, t in trees.items()]
    long = wide.select(*by, F.explode(F.array(*cells)).alias("_c")).select(*by, "_c.*")
    tail = (100.0 - level) / 200.0
    return long.groupBy(*by, "contrast").agg(
        F.avg("value").alias("mean"), F.percentile("value", tail).alias("lower"),
        F.percentile("value", 1 - tail).alias("upper"))
