"""Event windows: for every response, the events of its series around its time.

History takes the last ``history`` events at or before the response, future the first ``future``
events at or after it; ``cutoff`` bounds the distance in time.  Events simultaneous with the
response belong to both and are counted once.

Plan, one shuffle of the two tables and none of the windows:

1. Events and responses are laid out together by (series, block) and ordered by time.
2. A running event count gives each event its rank and each response the rank range it wants.
3. Ranks are cut into chunks as long as a window.  An event goes to its own chunk and the next, so
   any rank range lies within the chunk of its end, which holds at most two windows of events.
4. The chunk's events are attached to the responses of the same chunk and cut to the range
   (:func:`window_arrays`), or unfolded and summed on the spot (:func:`window_sums`).

Steps 2-4 share the partitioning of step 1.  No group grows with the data: blocks have a bounded
number of rows, chunks a bounded number of events.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoframe.operators.series import (
    COPIES,
    SIMULTANEOUS,
    Layout,
    block_carries,
    choose_layout,
    collapse,
    gather,
    hashable,
    lay_out,
    most_copies,
    prefix_sum,
    repeated,
    with_halo,
)

WINDOW = "_window"


@dataclass
class Chunked:
    """Events and responses in their chunks; a response wants ranks (_lo, _hi] of its group."""

    rows: DataFrame
    group: list[str]
    y_cols: list[str]
    plan: Layout
    width: int
    copies: int

    def chunk(self):
        return Window.partitionBy(*self.group, "_chunk").orderBy("_n").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)

    def offsets(self) -> tuple[Column, Column]:
        """First position (from 0) and length of a response's range in its chunk's arrays.

        Ranks in a chunk are consecutive, so a range of ranks is a slice.
        """
        low = F.greatest(F.col("_lo"), F.lit(0))
        before = F.greatest((F.col("_chunk") - 2) * self.width, F.lit(0))
        # Bounded below so that Spark may evaluate them on events too, ahead of the row filter.
        return (F.greatest(low - before, F.lit(0)).cast("int"),
                F.greatest(F.col("_hi") - low, F.lit(0)).cast("int"))

    def restore(self, out: DataFrame, names: Sequence[str]) -> DataFrame:
        if self.plan.kind == "blocks":
            out = repeated(out, self.copies)
        return out.select(*[_q(c) for c in self.y_cols], *[_q(n) for n in names])


def chunked(
    X: DataFrame,
    Y: DataFrame,
    series: Sequence[str],
    values: Sequence[str] = (),
    history: int | None = 128,
    future: int = 0,
    time: str = "time",
    response_time: str | None = None,
    tie: Sequence[str] = (),
    inclusive: bool = True,
    layout: str = "auto",
    at_most: int | None = None,
    blocks: int | None = None,
    ranks: bool = False,
    plan: Layout | None = None,
) -> Chunked:
    """Steps 1-3 of the plan above.  With ``ranks``, ``_g`` is an event's position in its whole series."""
    history, future = int(history or 0), int(future or 0)
    if history + future < 1:
        raise ValueError("history or future must be positive")
    response_time = response_time or time
    series, values, tie = list(series), list(values), list(tie)
    if future and not inclusive:
        raise ValueError("future windows always include simultaneous events")
    y_cols = list(Y.columns)
    if not series:
        X, Y, series = X.withColumn("_all", F.lit(0)), Y.withColumn("_all", F.lit(0)), ["_all"]
    plan = plan or choose_layout([X, Y], series, layout, at_most, blocks)
    width = history + future

    known = [F.col(s).isNotNull() for s in series]
    event = F.struct(F.col(time).cast("double").alias("time"), *[_q(v) for v in values])
    by_itself = len(tie) == 1 and X.schema[tie[0]].dataType.typeName() in ("long", "integer", "short")
    ties = F.col(tie[0]).cast("long") if by_itself else F.xxhash64(*[_q(c) for c in tie or values or [time]])
    events = X.where(_all(known)).where(F.col(time).isNotNull()).select(
        *series,
        F.col(time).cast("double").alias("_t"),
        F.lit(0).alias("_kind"),
        ties.alias("_tie"),
        event.alias("_x"),
    )
    nth, counts_for = F.lit(1), F.lit(1).cast("long")
    if plan.kind == "blocks" and not tie:
        # A window cannot hold more than `width` of any number of identical events: the first `future` and the
        # last `history`.  One of those kept counts for all between, which are not.
        events = collapse(events)
        nth = F.explode(F.sequence(F.lit(1), F.least(F.lit(width), F.col(COPIES)).cast("int")))
        counts_for = F.when(F.col("_nth") == max(1, future), F.greatest(F.col(COPIES) - width, F.lit(0)) + 1).otherwise(1)
    events = events.select("*", nth.alias("_nth"))
    events = (events.withColumn("_for", counts_for) if ranks else events).drop(COPIES)
    # A response sorts behind every event up to its time plus the tolerance; where only later events
    # matter (or simultaneous ones do not), it sorts before the events of its own time.
    behind = inclusive and history > 0
    shift = (SIMULTANEOUS if behind else -SIMULTANEOUS) if inclusive else 0.0
    at = F.col(response_time).cast("double")
    spread = [_q(c) for c in hashable(Y)]
    if plan.kind == "blocks":
        Y = collapse(Y)
    responses = Y.select(
        *series,
        (at + shift).alias("_t"),
        F.lit(1 if behind else -1).alias("_kind"),
        (F.xxhash64(*spread) if plan.kind == "blocks" else F.lit(0).cast("long")).alias("_tie"),
        F.lit(1).alias("_nth"),
        F.struct(*[_q(c) for c in Y.columns if c in y_cols or c == COPIES]).alias("_y"),
    )
    both = events.unionByName(responses, allowMissingColumns=True)

    laid = lay_out(both, series, ["_t", "_kind", "_tie", "_nth"], plan)
    rows = with_halo(laid, max(history, future), future, where=F.col("_kind") == 0)
    group = laid.group

    rows = gather(rows, group, plan)
    ordered = Window.partitionBy(*group).orderBy(*laid.order)
    is_event = F.when(F.col("_kind") == 0, 1).otherwise(0)
    counts = [F.sum(is_event).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_n")]
    if future and history:
        # Events strictly earlier than the response by more than the tolerance.
        below = math.nextafter(2 * SIMULTANEOUS, 1.0)
        keys = ", ".join(f"`{g}`" for g in group)
        counts.append(F.expr(
            f"coalesce(sum(1 - abs(_kind)) over (partition by {keys} order by _t "
            f"range between unbounded preceding and {below!r}D preceding), 0)").alias("_m"))
    if ranks:
        stands = F.when(F.col("_kind") == 0, F.col("_for")).otherwise(0)
        copied = F.when(F.col("_halo") == -1, F.col("_for")).otherwise(0)
        upto = F.sum(stands).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        counts += [(upto - stands + 1 if future else upto).alias("_g"),
                   F.sum(copied).over(Window.partitionBy(*group)).alias("_copied")]
    rows = rows.select("*", *counts).where("_kind = 0 or _halo = 0")
    if ranks and laid.cut:
        # Events of earlier blocks, of which a block sees the last few as copies.
        carry = block_carries(laid, {"_carry": F.when(F.col("_kind") == 0, F.col("_for")).otherwise(0)})
        rows = rows.join(carry, group, "left").withColumn(
            "_g", F.col("_g") - F.col("_copied") + F.coalesce("_carry", F.lit(0)))

    # The rank range (lo, hi] a response wants, and the chunk that covers it.
    lo, hi = F.col("_n") - history, F.col("_n")
    if future:
        last = F.sum(is_event).over(Window.partitionBy(*group)).alias("_events")
        rows = rows.select("*", last)
        hi = F.greatest(hi, F.col("_m") + future) if history else hi + future
        hi = F.least(hi, F.col("_events"))
    end = F.when(F.col("_kind") == 0, F.col("_n")).otherwise(hi)
    rows = rows.withColumn("_end", end).withColumn("_own", F.expr(f"(_end + {width} - 1) div {width}"))
    own = F.col("_own")
    rows = rows.select(
        *group, "_kind", "_x", "_y", "_n", *(["_g"] if ranks else []),
        lo.alias("_lo"), hi.alias("_hi"),
        F.explode(
            F.when(F.col("_kind") == 0, F.array(own, own + 1)).otherwise(F.array(own))
        ).alias("_chunk"),
    )
    copies = most_copies(laid, f"_y.{COPIES}") if laid.cut else 1
    return Chunked(rows, group, y_cols, plan, width, copies)


def window_arrays(
    X: DataFrame,
    Y: DataFrame,
    series: Sequence[str],
    values: Sequence[str] = (),
    history: int | None = 128,
    future: int = 0,
    cutoff: float | None = None,
    response_time: str | None = None,
    into: str = WINDOW,
    **kw,
) -> DataFrame:
    """``Y`` with an array column of its window's events ``{time, rank, <values>}``, oldest first.

    ``tie`` names the column that tells events of equal time apart (default: their values, in which
    case identical events may be many).  ``series`` may be empty.
    ``inclusive=False`` keeps only events strictly before the response (history windows only).
    """
    ch = chunked(X, Y, series, values, history, future, response_time=response_time, ranks=True, **kw)
    ranked = F.when(F.col("_kind") == 0, F.struct(
        F.col("_x.time").alias("time"), F.col("_g").alias("rank"),
        *[F.col("_x").getField(v).alias(v) for v in values]))
    rows = ch.rows.select("*", F.collect_list(ranked).over(ch.chunk()).alias("_c")).where("_kind != 0")
    first, length = ch.offsets()
    out = ch.restore(rows.select("_y.*", F.slice("_c", first + 1, length).alias(into)), [into])
    if cutoff:
        at = _q(response_time or kw.get("time", "time")).cast("double")
        out = out.withColumn(into, F.filter(into, lambda e: F.abs(at - e["time"]) <= F.lit(float(cutoff))))
    return out


def window_sums(
    X: DataFrame,
    Y: DataFrame,
    series: Sequence[str],
    terms: dict[str, tuple[str, Callable[[Column], Column]]],
    history: int | None = 128,
    future: int = 0,
    cutoff: float | None = None,
    response_time: str | None = None,
    **kw,
) -> DataFrame:
    """``Y`` plus, per term, the sum over its window of weight(delay) * value.

    Times and values of a chunk are plain arrays of doubles.  A response unfolds into positions of
    its range and is summed up again in the same stage, all of it generated code; the grouping keys
    contain the partitioning keys, so nothing is shuffled for it.
    """
    values = list(dict.fromkeys(v for v, _ in terms.values()))
    ch = chunked(X, Y, series, values, history, future, response_time=response_time, **kw)
    return chunk_sums(ch, values, terms, response_time or kw.get("time", "time"), cutoff)


def chunk_sums(ch: Chunked, values: Sequence[str], terms: dict[str, tuple[str, Callable[[Column], Column]]],
               response_time: str, cutoff: float | None = None) -> DataFrame:
    """The sums over chunks made with ``values``: kernels are only needed here."""
    is_event = F.col("_kind") == 0
    arrays = {"_at": F.col("_x.time"), **{f"_v{i}": F.col("_x").getField(v) for i, v in enumerate(values)}}
    rows = ch.rows.select(
        *ch.group, "_kind", "_y", "_lo", "_hi", "_chunk",
        *[F.collect_list(F.when(is_event, c)).over(ch.chunk()).alias(n) for n, c in arrays.items()],
    ).where("_kind != 0").withColumn("_rid", F.monotonically_increasing_id())
    first, length = ch.offsets()
    at = F.col("_y").getField(response_time).cast("double")
    unfolded = rows.select(
        *ch.group, "_rid", "_y", at.alias("_ty"), *arrays,
        F.explode_outer(F.when(length > 0, F.sequence(first, first + length - 1))).alias("_i"),
    )
    delays = unfolded.select(
        *ch.group, "_rid", "_y", (F.col("_ty") - F.get("_at", F.col("_i"))).alias("_d"),
        *[F.get(f"_v{i}", F.col("_i")).alias(f"_v{i}") for i in range(len(values))])
    sums = [_weighted(F.col(f"_v{values.index(value)}"), weight, cutoff).alias(name) for name, (value, weight) in terms.items()]
    whole = len(hashable(unfolded.select("_y.*"))) == len(rows.schema["_y"].dataType.names)
    if whole:
        out = delays.groupBy(*ch.group, "_rid", "_y").agg(*sums)
    else:
        out = delays.groupBy(*ch.group, "_rid").agg(F.first("_y").alias("_y"), *sums)
    return ch.restore(out.select("_y.*", *[_q(n) for n in terms]), list(terms))


def _weighted(value: Column, weight: Callable[[Column], Column], cutoff: float | None, only: Column | None = None) -> Column:
    part = weight(F.col("_d")) * value
    if cutoff:
        within = F.abs("_d") <= F.lit(float(cutoff))
        only = within if only is None else only & within
    return F.coalesce(F.sum(part if only is None else F.when(only, part)), F.lit(0.0))


@dataclass
class ManyChunked:
    """Events of several tables and responses of several tables in their chunks, after one exchange."""

    rows: DataFrame
    group: list[str]
    y_cols: list[list[str]]
    width: int
    values: list[list[str]]

    def sums(self, terms: Sequence[tuple[str, int, str, Callable[[Column], Column]]], cutoff: float | None = None) -> list[DataFrame]:
        """Each response table with a column per term (name, source, value, weight)."""
        is_event = F.col("_kind") == 0
        chunk = Window.partitionBy(*self.group, "_src", "_chunk").orderBy("_n").rowsBetween(
            Window.unboundedPreceding, Window.unboundedFollowing)
        flat = [f"_v{s}_{i}" for s, vs in enumerate(self.values) for i in range(len(vs))]
        tables = [f"_y{r}" for r in range(len(self.y_cols))]
        # Values of other sources are null and leave their arrays empty.
        rows = self.rows.select(
            *self.group, "_kind", "_src", "_chunk", "_lo", "_hi", "_rid", "_ty", "_r", *tables,
            *[F.collect_list(F.when(is_event, F.col(c))).over(chunk).alias(f"{c}s") for c in ("_t", *flat)]).where("_kind != 0")
        low = F.greatest(F.col("_lo"), F.lit(0))
        first = F.greatest(low - F.greatest((F.col("_chunk") - 2) * self.width, F.lit(0)), F.lit(0)).cast("int")
        length = F.greatest(F.col("_hi") - low, F.lit(0)).cast("int")
        whole = all(len(hashable(rows.select(f"{t}.*"))) == len(cols) for t, cols in zip(tables, self.y_cols))
        keys = [*self.group, "_rid", "_r", *(tables if whole else [])]
        unfolded = rows.select(
            *self.group, "_rid", "_r", *tables, "_src", "_ty", "_ts", *[f"{c}s" for c in flat],
            F.explode_outer(F.when(length > 0, F.sequence(first, first + length - 1))).alias("_i"))
        delays = unfolded.select(
            *self.group, "_rid", "_r", *tables, "_src", (F.col("_ty") - F.get("_ts", F.col("_i"))).alias("_d"),
            *[F.get(f"{c}s", F.col("_i")).alias(c) for c in flat])
        names = [n for n, *_ in terms]
        sums = [_weighted(F.col(f"_v{s}_{self.values[s].index(value)}"), weight, cutoff, F.col("_src") == s).alias(name)
                for name, s, value, weight in terms]
        out = delays.groupBy(*keys).agg(*([] if whole else [F.first(t, ignorenulls=True).alias(t) for t in tables]), *sums)
        return [out.where(F.col("_r") == r).select(f"_y{r}.*", *[_q(n) for n in names]) for r in range(len(tables))]


def chunked_many(
    sources: Sequence[tuple[DataFrame, Sequence[str], str, Sequence[str]]],
    responses: Sequence[tuple[DataFrame, str]],
    series: Sequence[str],
    history: int | None = 128,
    future: int = 0,
    plan: Layout | None = None,
) -> ManyChunked:
    """Steps 1-3 of the plan above for several event tables (table, values, time, tie) and response tables (table, time).

    All tables are one tagged union, so there is one exchange; events are ranked within their own table.  A
    response enters the chunk that covers its range once for each event table.  Whole series are window groups.
    """
    history, future = int(history or 0), int(future or 0)
    if history + future < 1:
        raise ValueError("history or future must be positive")
    series, width = list(series), history + future
    if not series:
        sources = [(x.withColumn("_all", F.lit(0)), *rest) for x, *rest in sources]
        responses = [(y.withColumn("_all", F.lit(0)), t) for y, t in responses]
        y_cols, series = [[c for c in y.columns if c != "_all"] for y, _ in responses], ["_all"]
    else:
        y_cols = [list(y.columns) for y, _ in responses]
    known, parts = _all([F.col(s).isNotNull() for s in series]), []
    for s, (x, values, time, tie) in enumerate(sources):
        by_itself = len(tie) == 1 and x.schema[tie[0]].dataType.typeName() in ("long", "integer", "short")
        ties = F.col(tie[0]).cast("long") if by_itself else F.xxhash64(*[_q(c) for c in list(tie) or list(values) or [time]])
        parts.append(x.where(known).where(F.col(time).isNotNull()).select(
            *series, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_kind"), ties.alias("_tie"), F.lit(s).alias("_s"),
            *[_q(v).cast("double").alias(f"_v{s}_{i}") for i, v in enumerate(values)]))
    behind = history > 0
    for r, (y, time) in enumerate(responses):
        at = F.col(time).cast("double")
        parts.append(y.select(
            *series, (at + (SIMULTANEOUS if behind else -SIMULTANEOUS)).alias("_t"), F.lit(1 if behind else -1).alias("_kind"),
            F.lit(0).cast("long").alias("_tie"), F.lit(r).alias("_r"), at.alias("_ty"), F.struct(*[_q(c) for c in y_cols[r]]).alias(f"_y{r}")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    rows = gather(both, series, plan or Layout("series"))
    ordered, per_series = Window.partitionBy(*series).orderBy("_t", "_kind", "_tie"), Window.partitionBy(*series)
    keys, below, own, ranges = ", ".join(f"`{g}`" for g in series), math.nextafter(2 * SIMULTANEOUS, 1.0), [], []
    columns = []
    for s in range(len(sources)):
        mine = F.when((F.col("_kind") == 0) & (F.col("_s") == s), 1).otherwise(0)
        columns.append(F.sum(mine).over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_n{s}"))
        if future and history:
            columns.append(F.expr(
                f"coalesce(sum(case when _kind = 0 and _s = {s} then 1 else 0 end) over (partition by {keys} order by _t "
                f"range between unbounded preceding and {below!r}D preceding), 0)").alias(f"_m{s}"))
        if future:
            columns.append(F.sum(mine).over(per_series).alias(f"_all{s}"))
    rows = rows.select("*", *columns, F.monotonically_increasing_id().alias("_rid"))
    to_chunk = lambda n: ((n + (width - 1)) / width).cast("long")
    for s in range(len(sources)):
        n, hi = F.col(f"_n{s}"), F.col(f"_n{s}")
        if future:
            hi = F.greatest(n, F.col(f"_m{s}") + future) if history else n + future
            hi = F.least(hi, F.col(f"_all{s}"))
        place = lambda c, lo, hi, s=s: F.struct(F.lit(s).alias("_src"), c.alias("_chunk"), lo.cast("long").alias("_lo"), hi.cast("long").alias("_hi"))
        ranges.append(place(to_chunk(hi), n - history, hi))
        own.append(F.when(F.col("_s") == s, F.array(place(to_chunk(n), n, n), place(to_chunk(n) + 1, n, n))))
    rank = F.coalesce(*[F.when(F.col("_s") == s, F.col(f"_n{s}")) for s in range(len(sources))])
    spread = F.explode(F.when(F.col("_kind") == 0, F.coalesce(*own)).otherwise(F.array(*ranges))).alias("_place")
    values = [c for c in rows.columns if c.startswith("_v") and c[2].isdigit()]
    rows = rows.select(*series, "_kind", "_t", "_ty", "_r", "_rid", *values, *[f"_y{r}" for r in range(len(responses))], rank.alias("_n"), spread)
    rows = rows.select(*[c for c in rows.columns if c != "_place"], "_place.*")
    return ManyChunked(rows, series, y_cols, width, [list(v) for _, v, _, _ in sources])


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _all(conds: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def pairs(windowed: DataFrame, response_time: str = "time", window: str = WINDOW,
          keep_empty: bool = False) -> DataFrame:
    """Long form: one row per response and event, with ``t_delta`` = response time - event time."""
    gen = F.explode_outer if keep_empty else F.explode
    rest = [c for c in windowed.columns if c != window]
    event = windowed.schema[window].dataType.elementType.names
    rest = [_q(c) for c in rest]
    long = windowed.select(*rest, gen(window).alias("_e"))
    return long.select(
        *rest,
        F.col("_e.time").alias("event_time"),
        (F.col(response_time).cast("double") - F.col("_e.time")).alias("t_delta"),
        F.col("_e.rank").alias("event_rank"),
        *[F.col("_e").getField(v).alias(v) for v in event if v not in ("time", "rank")],
    )


def window_counts(X: DataFrame, Y: DataFrame, series: Sequence[str], cutoff: float | None = None,
                  time: str = "time", response_time: str | None = None, **layout) -> DataFrame:
    """Events at or before each response (``n_before``) and those within ``cutoff`` of it (``n_within``).

    A response enters a running count twice, at both ends of its range; no window is expanded.
    """
    response_time = response_time or time
    y_cols = list(Y.columns)
    known = _all([F.col(s).isNotNull() for s in series])
    events = X.where(known).select(
        *series, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_kind"), F.lit(1).alias("_one"))
    at = F.col(response_time).cast("double")
    ends = [F.struct((at + SIMULTANEOUS).alias("_t"), F.lit(1).alias("_kind"))]
    if cutoff:
        ends.append(F.struct((at - F.lit(float(cutoff))).alias("_t"), F.lit(-1).alias("_kind")))
    marks = Y.select(*series, F.struct(*[_q(c) for c in y_cols]).alias("_y"),
                     F.explode(F.array(*ends)).alias("_e"))
    marks = marks.select(*series, "_e.*", F.lit(0).alias("_one"), "_y")
    both = events.unionByName(marks, allowMissingColumns=True)
    ran = prefix_sum(both, series, ["_t", "_kind"], {"_n": F.col("_one")}, **layout).where("_kind != 0")
    # Both ends of a response meet again; identical responses are counted and restored.
    joined = ran.groupBy("_y").agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_n"))).alias("n_before"),
        F.max(F.when(F.col("_kind") == -1, F.col("_n"))).alias("_lower"),
        F.sum(F.when(F.col("_kind") == 1, 1)).alias("_copies"),
    )
    joined = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return joined.select("_y.*", "n_before",
                         (F.col("n_before") - F.coalesce("_lower", F.lit(0))).alias("n_within"))
