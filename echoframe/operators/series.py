"""Ordered operations inside time series: layout, running counts, lags, prefix sums.

Every operation here needs the rows of a series in time order.  Two layouts give that:

* ``series``: one window group per series.  Right while the longest series fits in a task.
* ``blocks``: the table is range-partitioned on (series, time), so a long series is cut into
  pieces of about equal size however its rows are spread over time.  Each piece is one window
  group; what a piece must know of earlier pieces is a *carry* (counts or sums, one row per
  piece) or a *halo* (the last few rows before it).

The layout is chosen by a measured size, never assumed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoframe.session import checkpointed

# Most rows of one series that a single task may sort and window.
SERIES_ROWS = 2_000_000
# float32 machine epsilon: the tolerance within which two clocks count as simultaneous.
SIMULTANEOUS = 1.1920929e-07

BLOCK = "_blk"


@dataclass(frozen=True)
class Layout:
    """How series are cut, and into how many pieces (None: as the session's shuffles are)."""

    kind: str
    pieces: int | None = None


def series_sizes(frames: Sequence[DataFrame], series: Sequence[str], at_most: int = SERIES_ROWS) -> tuple[int, int]:
    """Rows of the tables together, and of the longest series (unmeasured while the total is small)."""
    keys = None
    for f in frames:
        k = f.select(*[F.col(s) for s in series] or [F.lit(1).alias("_one")])
        keys = k if keys is None else keys.unionByName(k)
    total = keys.count()
    if total <= at_most or not series:
        return total, total
    sizes = keys.groupBy(*series).agg(F.count(F.lit(1)).alias("_n"))
    return total, sizes.agg(F.max("_n")).first()[0] or 0


def choose_layout(frames: Sequence[DataFrame], series: Sequence[str], layout: str = "auto",
                  at_most: int | None = None, blocks: int | None = None) -> Layout:
    """Measure the tables and choose; ``layout`` and ``blocks`` override the measurement.

    The number of pieces follows from the row count, so a piece stays as small at 100 TB as it is here.
    """
    at_most = SERIES_ROWS if at_most is None else at_most
    if layout == "series" or blocks:
        return Layout("series" if layout == "series" else "blocks", blocks)
    total, longest = series_sizes(frames, series, at_most)
    usual = int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = -(-total // at_most)
    kind = layout if layout != "auto" else ("series" if longest <= at_most else "blocks")
    return Layout(kind, pieces if pieces > usual else None)


@dataclass
class Laid:
    """A table whose rows carry a block number, and the keys that bound one window group."""

    df: DataFrame
    series: list[str]
    order: list[str]
    layout: Layout

    @property
    def cut(self) -> bool:
        return self.layout.kind == "blocks"

    @property
    def group(self) -> list[str]:
        return [*self.series, BLOCK]


def lay_out(df: DataFrame, series: Sequence[str], order: Sequence[str], layout: Layout) -> Laid:
    """Give every row its block.  ``order`` must rank the rows of a series.

    In the ``blocks`` layout the range partitioning is sampled, so its outcome is written once
    (checkpoint) and every later step reads the same block numbers.
    """
    series, order = list(series), list(order)
    if layout.kind == "series":
        return Laid(df.withColumn(BLOCK, F.lit(0)), series, order, layout)
    keys = [F.col(c) for c in [*series, *order]]
    ranged = df.repartitionByRange(layout.pieces, *keys) if layout.pieces else df.repartitionByRange(*keys)
    return Laid(checkpointed(ranged.withColumn(BLOCK, F.spark_partition_id())), series, order, layout)


def gather(df: DataFrame, group: Sequence[str], layout: Layout) -> DataFrame:
    """Hash-partition by window group, into more pieces than usual where the table needs them."""
    keys = [F.col(g) for g in group]
    return df.repartition(layout.pieces, *keys) if layout.pieces else df.repartition(*keys)


COPIES = "_copies"


def hashable(df: DataFrame) -> list[str]:
    """Columns that can be grouped and hashed: those without maps or variants."""
    return [c for c, t in df.dtypes if "map<" not in t and "variant" not in t]


def collapse(df: DataFrame) -> DataFrame:
    """Identical rows as one row and a count.

    Range partitioning cannot separate rows that are equal in every column; counted before the
    shuffle, any number of copies is one row.  A table with columns that cannot be grouped is left as
    it is.
    """
    if len(hashable(df)) < len(df.columns):
        return df.withColumn(COPIES, F.lit(1).cast("long"))
    return df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias(COPIES))


PIECE = 100_000


def most_copies(laid: "Laid", count: str = COPIES) -> int:
    """Longest run of identical rows in a laid-out (hence already written) table."""
    return laid.df.agg(F.max(count)).first()[0] or 0


def repeated(df: DataFrame, most: int, count: str = COPIES, index: str = "_copy", piece: int = PIECE) -> DataFrame:
    """Undo :func:`collapse`: every row ``count`` times, numbered from 1.

    Where the longest run exceeds a piece, rows are first split into pieces spread over tasks.
    """
    if most <= piece:
        return df.withColumn(index, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count))))
    pieces = df.withColumn("_piece", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col(count) - 1) / piece))))
    spread = pieces.repartition(*[F.col(f"`{c}`") for c in pieces.columns])
    first = F.col("_piece") * piece + 1
    last = F.least(first + (piece - 1), F.col(count))
    return spread.withColumn(index, F.explode(F.sequence(first, last))).drop("_piece")


def block_carries(laid: Laid, measures: dict[str, Column], fold=F.sum) -> DataFrame:
    """Sums (or minima) of ``measures`` over all earlier blocks of the same series.

    One row per later block of a series that spans several: at most one per range partition, since
    a boundary cuts one series only.
    """
    per_block = laid.df.groupBy(*laid.group).agg(*[fold(c).alias(m) for m, c in measures.items()])
    w = Window.partitionBy(*laid.series).orderBy(BLOCK)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *laid.group,
        F.row_number().over(w).alias("_piece"),
        *[fold(m).over(earlier).alias(m) for m in measures],
    ).where("_piece > 1").drop("_piece")


def with_halo(laid: Laid, before: int, after: int = 0, where: Column | None = None) -> DataFrame:
    """Blocks plus copies of the ``before`` last rows ahead of each block and the ``after`` first
    rows behind it (same series, only rows passing ``where``).  Adds ``_halo``: -1, 0 or 1.

    Copies number at most (before + after) per block.
    """
    base = laid.df.withColumn("_halo", F.lit(0))
    if not laid.cut:
        return base
    # Only series cut by a block boundary need copies: at most two (series, block) pairs per block.
    pieces = (
        laid.df.select(*laid.group).distinct()
        .withColumn("_pieces", F.count(F.lit(1)).over(Window.partitionBy(*laid.series)))
        .where("_pieces > 1").drop("_pieces")
    )
    rows = laid.df if where is None else laid.df.where(where)
    rows = rows.join(pieces, laid.group, "left_semi")
    out = base
    for need, sign in ((before, -1), (after, 1)):
        if not need:
            continue
        # Only the `need` edge rows of a block can reach another one; the rank filter is pushed
        # below the shuffle, so a map task sends at most `need` rows per block.
        toward = [F.col(c).desc() if sign < 0 else F.col(c).asc() for c in laid.order]
        edge = rows.withColumn(
            "_pos", F.row_number().over(Window.partitionBy(*laid.group).orderBy(*toward))
        ).where(F.col("_pos") <= need)
        held = edge.groupBy(*laid.group).agg(F.count(F.lit(1)).alias("_held"))
        # Edge rows of a series get ranks that grow towards the target block.
        w = Window.partitionBy(*laid.series).orderBy(
            F.col(BLOCK).asc() if sign < 0 else F.col(BLOCK).desc()
        ).rowsBetween(Window.unboundedPreceding, -1)
        ladder = (
            pieces.join(held, laid.group, "left")
            .withColumn("_held", F.coalesce("_held", F.lit(0)))
            .withColumn("_ahead", F.coalesce(F.sum("_held").over(w), F.lit(0)))
        )
        ranked = edge.join(ladder, laid.group).withColumn(
            "_rank", F.col("_ahead") + F.col("_held") - F.col("_pos") + 1
        )
        wanted = ladder.where("_ahead > 0").select(
            *laid.series,
            F.col(BLOCK).alias("_target"),
            F.explode(
                F.sequence(F.greatest(F.lit(1), F.col("_ahead") - need + 1), F.col("_ahead"))
            ).alias("_rank"),
        )
        copies = ranked.join(wanted, [*laid.series, "_rank"]).select(
            *[F.col("_target").alias(BLOCK) if c == BLOCK else F.col(c) for c in laid.df.columns],
            F.lit(sign).alias("_halo"),
        )
        out = out.unionByName(copies)
    return out


def _sorted_window(laid: Laid):
    return Window.partitionBy(*laid.group).orderBy(*laid.order)


def running_count(df: DataFrame, series: Sequence[str], order: Sequence[str], name: str = "trial",
                  keep_existing: bool = True, **layout) -> DataFrame:
    """Position of each row in its series, from 1, as a double."""
    if keep_existing and name in df.columns:
        return df
    out = prefix_sum(df, series, order, {name: F.lit(1)}, **layout)
    return out.withColumn(name, F.col(name).cast("double"))


def prefix_sum(df: DataFrame, series: Sequence[str], order: Sequence[str],
               measures: dict[str, Column], layout: str = "auto", at_most: int | None = None,
               blocks: int | None = None) -> DataFrame:
    """Running sums of ``measures`` within each series, the current row included."""
    kept = [c for c in df.columns if c not in measures]
    plan = choose_layout([df], series, layout, at_most, blocks)
    rows = df.select(*[F.col(f"`{c}`") for c in kept], *[c.alias(f"_m_{m}") for m, c in measures.items()])
    if plan.kind == "series":
        laid = lay_out(rows, series, order, plan)
        w = _rows_so_far(laid)
        return laid.df.select(*[F.col(f"`{c}`") for c in kept],
                              *[F.sum(f"_m_{m}").over(w).alias(m) for m in measures])
    rows = collapse(rows)
    rows = rows.withColumn("_spread", F.xxhash64(*[F.col(f"`{c}`") for c in hashable(rows)]))
    laid = lay_out(rows, series, [*order, "_spread"], plan)
    run = {m: F.col(f"_m_{m}") * F.col(COPIES) for m in measures}
    w = _rows_so_far(laid)
    out = gather(laid.df, laid.group, plan).select(
        "*", *[F.sum(c).over(w).alias(f"_run_{m}") for m, c in run.items()])
    carry = block_carries(laid, {f"_carry_{m}": c for m, c in run.items()})
    out = repeated(out.join(carry, laid.group, "left"), most_copies(laid))
    # The k-th of n copies has seen n - k fewer of them than the run's end.
    return out.select(*[F.col(f"`{c}`") for c in kept], *[
        (F.col(f"_run_{m}") + F.coalesce(f"_carry_{m}", F.lit(0))
         - F.col(f"_m_{m}") * (F.col(COPIES) - F.col("_copy"))).alias(m) for m in measures])


def prefix_min(df: DataFrame, series: Sequence[str], order: Sequence[str], value: str, into: str,
               layout: str = "auto", at_most: int | None = None, blocks: int | None = None) -> DataFrame:
    """Running minimum of ``value`` within each series, the current row included."""
    plan = choose_layout([df], series, layout, at_most, blocks)
    laid = lay_out(df, series, order, plan)
    out = laid.df.withColumn(into, F.min(value).over(_rows_so_far(laid)))
    if laid.cut:
        carry = block_carries(laid, {"_carry": F.col(value)}, fold=F.min)
        out = out.join(carry, laid.group, "left").withColumn(
            into, F.least(into, "_carry")).drop("_carry")
    return out.drop(BLOCK)


def _rows_so_far(laid: Laid):
    return Window.partitionBy(*laid.group).orderBy(*laid.order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)


def spillover(df: DataFrame, series: Sequence[str], order: Sequence[str], lags: dict[str, int],
              layout: str = "auto", at_most: int | None = None, blocks: int | None = None) -> DataFrame:
    """Add ``<column>S<n>``: the value ``n`` rows earlier in the series, 0 at its start."""
    plan = choose_layout([df], series, layout, at_most, blocks)
    deepest = max(lags.values())
    kept = [F.col(f"`{c}`") for c in df.columns]
    rows, order = df, list(order)
    if plan.kind == "blocks":
        # Of many copies only the first `deepest` reach back beyond themselves, and only as many are
        # seen by later rows; the others see their own value.
        rows = collapse(df)
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in hashable(df)])
        rows = rows.select(*kept, COPIES, spread.alias("_spread"), F.explode(F.sequence(
            F.lit(1), F.least(F.lit(deepest), F.col(COPIES)).cast("int"))).alias("_nth"))
        order += ["_spread", "_nth"]
    laid = lay_out(rows, series, order, plan)
    w = Window.partitionBy(*laid.group).orderBy(*laid.order)
    names = [f"{c}S{n}" for c, n in lags.items()]
    out = with_halo(laid, before=deepest).select(
        "*", *[F.lag(c, n, 0.0).over(w).alias(f"{c}S{n}") for c, n in lags.items()]
    ).where("_halo = 0")
    if not laid.cut or (most := most_copies(laid)) <= deepest:
        return out.select(*kept, *names)
    rest = out.where(f"_nth = {deepest} and {COPIES} > {deepest}").withColumn(COPIES, F.col(COPIES) - deepest)
    rest = repeated(rest, most).select(*kept, *[F.col(f"`{c}`").alias(f"{c}S{n}") for c, n in lags.items()])
    return out.select(*kept, *names).unionByName(rest)
