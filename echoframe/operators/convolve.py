"""Convolution: kernel-weighted sums of windowed events, one column per term.

All terms of a source share one event window per response and one pass over it: no join back, no
shuffle beyond the one that brought events and responses together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions.kernels import DiracDelta, Kernel, check_causal
from echoframe.functions.transforms import zero_filled
from echoframe.operators.series import SIMULTANEOUS, choose_layout, prefix_sum
from echoframe.operators.windows import WINDOW, Chunked, ManyChunked, chunk_sums, chunked, chunked_many, window_arrays, window_sums


@dataclass(frozen=True)
class Conv:
    """One convolved predictor: ``value`` weighted by ``kernel``, as column ``name``."""

    name: str
    value: str
    kernel: Kernel = field(default_factory=DiracDelta)


@dataclass
class Source:
    """An event table with its own clock and windows, and the terms it feeds."""

    X: DataFrame
    terms: list[Conv]
    time: str = "time"
    tie: Sequence[str] = ()


def weighted_sum(window: str, response_time: str, value: str, kernel: Kernel) -> Column:
    """Sum over the window of kernel(response time - event time) * value."""
    at = F.col(response_time).cast("double")
    return F.aggregate(
        window, F.lit(0.0),
        lambda total, e: total + kernel.column(at - e["time"]) * e[value],
    )


def convolve(
    Y: DataFrame,
    sources: Sequence[Source],
    series: Sequence[str],
    history: int | None = 128,
    future: int = 0,
    cutoff: float | None = None,
    response_time: str = "time",
    keep_windows: bool = False,
    **window_args,
) -> DataFrame:
    """``Y`` plus one column per term of every source; an empty window gives 0.

    Missing predictor values contribute 0, as do events outside the window.
    """
    if not keep_windows:
        return prepare(Y, sources, series, history, future, cutoff, response_time, **window_args).sums()
    sizing = {k: window_args.pop(k) for k in ("layout", "at_most", "blocks") if k in window_args}
    # Tables are measured as they came, before windows are attached to them.
    plan = choose_layout([*[src.X for src in sources], Y], list(series), **sizing)
    for i, src in enumerate(sources):
        check_causal([t.kernel for t in src.terms if not isinstance(t.kernel, DiracDelta)], future)
        values = list(dict.fromkeys(t.value for t in src.terms))
        X = src.X.withColumns({v: zero_filled(src.X, v) for v in values})
        into = WINDOW if len(sources) == 1 else f"{WINDOW}{i}"
        Y = window_arrays(
            X, Y, series, values, history, future, cutoff, time=src.time,
            response_time=response_time, tie=src.tie, into=into, plan=plan, **window_args,
        )
        Y = Y.withColumns({
            t.name: weighted_sum(into, response_time, t.value, t.kernel) for t in src.terms
        })
    return Y


@dataclass
class Prepared:
    """Events and responses laid out for kernel-weighted sums; kernels may change from one call to the next."""

    sources: Sequence[Source]
    values: list[list[str]]
    cutoff: float | None
    response_time: str
    chunks: ManyChunked | Chunked | None
    again: Callable | None = None

    def sums(self, extra: Sequence[tuple[str, int, str, Callable[[Column], Column]]] = (), kernels: dict[str, Kernel] | None = None) -> DataFrame:
        """The responses with a column per term, its kernel taken from ``kernels`` if named there, and per extra
        term (name, source, value, weight)."""
        return self.tables(extra, kernels)[0]

    def tables(self, extra=(), kernels: dict[str, Kernel] | None = None) -> list[DataFrame]:
        kernels = kernels or {}
        terms = [(t.name, i, t.value, kernels.get(t.name, t.kernel).column) for i, src in enumerate(self.sources) for t in src.terms]
        terms += list(extra)
        if isinstance(self.chunks, ManyChunked):
            return self.chunks.sums(terms, self.cutoff)
        if self.chunks is not None:
            return [chunk_sums(self.chunks, self.values[0], {n: (v, w) for n, _, v, w in terms}, self.response_time, self.cutoff)]
        return self.again(terms)

    def persist(self) -> "Prepared":
        """Keep the laid-out tables (events twice, responses once for each source; no pairs) for several calls."""
        if self.chunks is not None:
            self.chunks.rows.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        if self.chunks is not None:
            self.chunks.rows.unpersist()


def prepare(
    Y: DataFrame | Sequence[DataFrame],
    sources: Sequence[Source],
    series: Sequence[str],
    history: int | None = 128,
    future: int = 0,
    cutoff: float | None = None,
    response_time: str = "time",
    layout: str = "auto",
    at_most: int | None = None,
    blocks: int | None = None,
    **window_args,
) -> Prepared:
    """Lay events and responses out once.

    All tables are measured together.  While whole series fit a task, any number of event and response tables
    takes one exchange; series that must be cut into blocks take one for each event table.
    """
    tables = [Y] if isinstance(Y, DataFrame) else list(Y)
    plan = choose_layout([*[src.X for src in sources], *tables], list(series), layout, at_most, blocks)
    for src in sources:
        check_causal([t.kernel for t in src.terms if not isinstance(t.kernel, DiracDelta)], future)
    values = [list(dict.fromkeys(t.value for t in src.terms)) for src in sources]
    filled = [src.X.withColumns({v: zero_filled(src.X, v) for v in vs}) for src, vs in zip(sources, values)]
    if plan.kind == "series" and (len(sources) > 1 or len(tables) > 1) and not window_args:
        chunks = chunked_many([(x, vs, src.time, src.tie) for x, vs, src in zip(filled, values, sources)],
                              [(y, response_time) for y in tables], series, history, future, plan)
        return Prepared(sources, values, cutoff, response_time, chunks)
    if len(sources) == 1 and len(tables) == 1:
        src = sources[0]
        chunks = chunked(filled[0], tables[0], series, values[0], history, future, time=src.time, response_time=response_time,
                         tie=src.tie, plan=plan, **window_args)
        return Prepared(sources, values, cutoff, response_time, chunks)

    def again(terms) -> list[DataFrame]:
        out = []
        for y in tables:
            for i, src in enumerate(sources):
                own = {n: (v, w) for n, s, v, w in terms if s == i}
                y = window_sums(filled[i], y, series, own, history, future, cutoff, response_time=response_time, time=src.time,
                                tie=src.tie, plan=plan, **window_args)
            out.append(y)
        return out

    return Prepared(sources, values, cutoff, response_time, None, again)


def convolve_many(Ys: Sequence[DataFrame], sources: Sequence[Source], series: Sequence[str], history: int | None = 128, future: int = 0,
                  cutoff: float | None = None, response_time: str = "time", **window_args) -> list[DataFrame]:
    """Several response tables, each with its own columns and one per term of every source."""
    return prepare(Ys, sources, series, history, future, cutoff, response_time, **window_args).tables()


def convolve_exponential(
    Y: DataFrame,
    X: DataFrame,
    series: Sequence[str],
    value: str,
    beta: float,
    into: str,
    time: str = "time",
    response_time: str = "time",
    layout: str = "auto",
    at_most: int | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Exponential kernel over *all* earlier events, without windows: running sums.

    exp(-b (ty - tx)) splits into a factor of ty and one of tx.  Clocks are rebased per span of
    300 / b time units so neither factor leaves the range of a double; a response needs its own span
    and the one before it (anything older weighs less than e^-300).
    """
    span = 300.0 / beta
    y_cols = list(Y.columns)
    if not series:
        X, Y, series = X.withColumn("_all", F.lit(0)), Y.withColumn("_all", F.lit(0)), ["_all"]
    keys = list(series)
    x = X.select(
        *keys, F.col(time).cast("double").alias("_t"), F.lit(0).alias("_kind"),
        zero_filled(X, value).alias("_v"),
    )
    y = Y.select(
        *keys, (F.col(response_time).cast("double") + SIMULTANEOUS).alias("_t"),
        F.lit(1).alias("_kind"), F.lit(0.0).alias("_v"),
        F.struct(*[F.col(f"`{c}`") for c in y_cols]).alias("_y"),
    )
    both = x.unionByName(y, allowMissingColumns=True).withColumn(
        "_span", F.floor(F.col("_t") / span))
    weight = F.col("_v") * F.exp((F.col("_t") - F.col("_span") * span) * beta)
    ran = prefix_sum(both, [*keys, "_span"], ["_t", "_kind"], {"_s": weight},
                     layout=layout, at_most=at_most, blocks=blocks)
    spans = (
        both.where("_kind = 0").groupBy(*keys, "_span").agg(F.sum(weight).alias("_before"))
        .withColumn("_span", F.col("_span") + 1)
    )
    out = ran.where("_kind = 1").join(spans, [*keys, "_span"], "left")
    since = F.col(f"_y.{response_time}").cast("double") - F.col("_span") * span
    total = F.col("_s") * F.exp(since * -beta) + F.coalesce("_before", F.lit(0.0)) * F.exp(
        (since + span) * -beta)
    return out.select("_y.*", (total * beta).alias(into))
