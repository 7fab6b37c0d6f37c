"""Model descriptions and their plans.

A :class:`Model` is a handful of dataclasses on the driver: which predictors enter through which
kernels, over which windows.  It compiles to one feature table (events windowed and convolved once,
whatever the number of terms or ablated variants) from which fits, predictions and scores follow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions import distributions
from echoframe.functions.kernels import LCG, DiracDelta, Kernel
from echoframe.functions.transforms import (
    Moments,
    add_responses,
    apply_ops,
    composite_key,
    dummies,
    levels,
    matching,
    parse_ops,
    product,
    zero_filled,
)
from echoframe.operators.compare import metrics
from echoframe.operators.convolve import Conv, Source, convolve
from echoframe.operators.filters import apply_filters, valid_responses
from echoframe.operators.likelihood import LikelihoodFit, fit_likelihood
from echoframe.operators.partition import ablation_family
from echoframe.operators.regress import (
    CrossedFit,
    Gram,
    LinearFit,
    crossed,
    gram,
    linear_predictor,
    solve,
)
from echoframe.plans.learning import Learned, learn


@dataclass(frozen=True)
class C:
    """One predictor and its kernel.

    ``impulse``: a column, a transform such as ``z(log(x))``, a product ``a:b``, or ``re(pattern)``.
    A column of the response table (or a bare predictor) enters at the response itself.
    Terms with one ``coef_id`` share a coefficient; terms with one ``irf_id`` share kernel parameters.
    ``ran`` names a grouping factor (``a:b`` for a composite) by which the coefficient varies.
    """

    impulse: str
    kernel: Kernel = field(default_factory=DiracDelta)
    coef_id: str | None = None
    irf_id: str | None = None
    trainable: tuple[str, ...] | None = None
    ran: str | None = None


@dataclass(frozen=True)
class Model:
    """What is predicted from what.

    ``family`` is the distribution of the responses; its first parameter is linear in all features, ``by`` names
    features of its other parameters (which are constants otherwise).  Responses that the family does not allow are an
    error, or with ``impossible="undefined"`` leave estimates NaN, predictions and densities null.
    """

    responses: Sequence[str]
    terms: Sequence[C]
    series: Sequence[str]
    history: int | None = 128
    future: int = 0
    cutoff: float | None = None
    products: Sequence[tuple[str, ...]] = ()
    intercept: bool = True
    random_intercepts: Sequence[str] = ()
    filters: Sequence[tuple[str, str]] = ()
    time: str = "time"
    tie: Sequence[str] = ()
    name: str = "model"
    family: str = "normal"
    by: dict[str, Sequence[str]] = field(default_factory=dict)
    impossible: str = "error"

    # ------------------------------------------------------------ compiling terms

    def compile(self, X: Sequence[DataFrame], Y: DataFrame, stats: dict | None = None) -> "Compiled":
        """Resolve impulses against the tables: transforms, dummies, products, locations."""
        X = [X] if isinstance(X, DataFrame) else list(X)
        stats = stats if stats is not None else {}
        tables = [*X, Y]
        convs: list[list[Conv]] = [[] for _ in X]
        aligned: list[Conv] = []
        features: dict[str, list[str]] = {}
        predictor_of: dict[str, str] = {}
        irf_ids: dict[str, str] = {}
        trainable: dict[str, tuple[str, ...]] = {}
        for term in self.terms:
            names = [term.impulse]
            if term.impulse.startswith("re(") and term.impulse.endswith(")"):
                pattern = term.impulse[3:-1].strip("\"'")
                names = list(dict.fromkeys(c for t in X for c in matching(pattern, t.columns)))
            for impulse in names:
                members = impulse.split(":")
                where = next((i for i, t in enumerate(tables)
                              if all(parse_ops(m)[0] in t.columns for m in members)), None)
                if where is None:
                    raise ValueError(f"no table has every column of {impulse!r}")
                table, columns = self._expand(tables[where], members, stats.setdefault(f"{where}", {}))
                tables[where] = table
                for col in columns:
                    kernels = term.kernel.basis() if isinstance(term.kernel, LCG) else [term.kernel]
                    for i, k in enumerate(kernels):
                        name = f"{type(term.kernel).__name__}({col})" if where < len(X) else col
                        name += f"_{i + 1}" if len(kernels) > 1 else ""
                        while any(name == c.name for cs in [*convs, aligned] for c in cs):
                            name += "'"
                        (convs[where] if where < len(X) else aligned).append(Conv(name, col, k))
                        group = term.coef_id or name
                        features.setdefault(group, []).append(name)
                        predictor_of[group] = impulse if term.coef_id is None else term.coef_id
                        if term.irf_id:
                            irf_ids[name] = term.irf_id
                        if term.trainable is not None:
                            trainable[name] = term.trainable
        for p in self.products:
            for member in p:
                if member not in features:
                    where = tables[-1]
                    if member not in where.columns:
                        raise ValueError(f"no feature or response column {member!r}")
                    aligned.append(Conv(member, member))
                    features[member], predictor_of[member] = [member], member
            features[":".join(p)] = [":".join(p)]
            predictor_of[":".join(p)] = ":".join(p)
        return Compiled(self, tables[:-1], tables[-1], convs, aligned, features, predictor_of, irf_ids,
                        trainable, stats)

    @staticmethod
    def _expand(table: DataFrame, members: list[str], stats: dict) -> tuple[DataFrame, list[str]]:
        sets: list[list[str]] = [[]]
        for m in members:
            base, ops = parse_ops(m)
            if not ops and table.schema[base].dataType.typeName() in ("string", "boolean"):
                if f"levels:{base}" not in stats:
                    stats[f"levels:{base}"] = levels(table, base)
                table, coded = dummies(table, base, stats[f"levels:{base}"])
            else:
                moments: dict[str, Moments] = stats.setdefault("moments", {})
                table, coded = apply_ops(table, [m], stats=moments), [m]
            sets = [s + [c] for s in sets for c in coded]
        for s in sets:
            if len(s) > 1 and ":".join(s) not in table.columns:
                table = table.withColumn(":".join(s), product(table, s))
        return table, [":".join(s) for s in sets]

    def prepared(self, Y: DataFrame, stats: dict[str, Moments] | None = None) -> DataFrame:
        """Filters, then response transforms, then rows with a usable response."""
        Y = apply_filters(Y, self.filters)
        Y = add_responses(Y, [r for r in self.responses], stats=stats)
        return valid_responses(Y, self.responses)

    def ablations(self, ablatable: Sequence[str]) -> dict[str, tuple[str, ...]]:
        return ablation_family(self.name, ablatable)

    def fit_mixed(self, X, Y: DataFrame, response: str | None = None, **kw) -> CrossedFit:
        """Fixed effects with by-level intercepts and coefficients, on one convolved table."""
        response = response or self.responses[0]
        Y = self.prepared(Y)
        random: dict[str, list[str]] = {g: ["intercept"] for g in self.random_intercepts}
        for g in dict.fromkeys([*random, *[t.ran for t in self.terms if t.ran]]):
            if g not in Y.columns:
                Y = Y.withColumn(g, composite_key(g.split(":")))
        compiled = self.compile(X, Y)
        for t in self.terms:
            if t.ran:
                mine = [f for f, p in compiled.predictor_of.items() if p in (t.impulse, t.coef_id)]
                random[t.ran] = [*random.get(t.ran, []), *mine]
        table = compiled.features().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return crossed(table, list(compiled.features_of), response, random, **kw)
        finally:
            table.unpersist()

    def fit(self, X, Y: DataFrame, learn_kernels: bool = False, l1=0.0, l2=0.0) -> "FittedModel":
        response_stats: dict[str, Moments] = {}
        stats: dict = {"response": response_stats}
        Y = self.prepared(Y, response_stats)
        compiled = self.compile(X, Y, stats)
        if learn_kernels:
            learned = compiled.learn(self.responses)
            g = dict.fromkeys(self.responses, learned.moments)
            if self.family != "normal" or self.by:
                return self._by_likelihood(compiled.with_kernels(learned.kernels), learned)
            fits = {r: solve(g[r], list(compiled.features_of), r, self.intercept, l2, l1) for r in self.responses}
            return FittedModel(self, compiled.with_kernels(learned.kernels), fits, g, learned.kernels, learned)
        if self.family != "normal" or self.by:
            return self._by_likelihood(compiled, None)
        table = compiled.features()
        several = len(self.responses) > 1
        if several:
            table = table.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            g = {r: gram(table, [*compiled.features_of, r]) for r in self.responses}
        finally:
            if several:
                table.unpersist()
        fits = {r: solve(g[r], list(compiled.features_of), r, self.intercept, l2, l1) for r in self.responses}
        return FittedModel(self, compiled, fits, g, {})

    def _by_likelihood(self, compiled: "Compiled", learned: Learned | None) -> "FittedModel":
        """Fits by the declared family, all from one feature table; kernels are those of the normal model if learned."""
        table = compiled.features().persist(StorageLevel.MEMORY_AND_DISK)
        try:
            fits = {r: fit_likelihood(table, list(compiled.features_of), r, self.family, by=self.by, impossible=self.impossible)
                    for r in self.responses}
        finally:
            table.unpersist()
        return FittedModel(self, compiled, fits, {}, learned.kernels if learned else {}, learned)

    def fit_split(self, X, Y: DataFrame, train: Column, l1=0.0, l2=0.0) -> tuple["FittedModel", DataFrame]:
        """Fit on the rows of ``train``; also the features of all rows, from the same windows.

        Statistics of transforms come from training rows.  The table is kept in memory or on disk, as it is
        read for the fit and again by what scores it; unpersist it when done.
        """
        response_stats: dict[str, Moments] = {}
        stats: dict = {"response": response_stats}
        compiled = self.compile(X, self.prepared(Y.where(train), response_stats), stats)
        whole = self.compile(X, self.prepared(Y, response_stats), stats)
        table = whole.features().persist(StorageLevel.MEMORY_AND_DISK)
        g = {r: gram(table.where(train), [*whole.features_of, r]) for r in self.responses}
        fits = {r: solve(g[r], list(whole.features_of), r, self.intercept, l2, l1) for r in self.responses}
        return FittedModel(self, compiled, fits, g, {}), table


@dataclass
class Compiled:
    model: Model
    X: list[DataFrame]
    Y: DataFrame
    convs: list[list[Conv]]
    aligned: list[Conv]
    features_of: dict[str, list[str]]
    predictor_of: dict[str, str]
    irf_ids: dict[str, str]
    trainable: dict[str, tuple[str, ...]]
    stats: dict

    def sources(self) -> list[Source]:
        m = self.model
        return [Source(x.withColumns({c.value: zero_filled(x, c.value) for c in cs}), cs, m.time, m.tie)
                for x, cs in zip(self.X, self.convs) if cs]

    def windowed(self) -> DataFrame:
        m = self.model
        out = convolve(self.Y, self.sources(), m.series, m.history, m.future, m.cutoff,
                       response_time=m.time, keep_windows=True)
        return out

    def features(self) -> DataFrame:
        """The response table with one column per feature."""
        m = self.model
        out = self.Y
        if any(self.convs):
            out = convolve(out, self.sources(), m.series, m.history, m.future, m.cutoff, response_time=m.time)
        return self.finished(out)

    def finished(self, out: DataFrame) -> DataFrame:
        """Convolved responses with the features made of several columns."""
        m = self.model
        out = out.withColumns({c.name: zero_filled(out, c.value) for c in self.aligned if c.value in out.columns})
        tied = {g: cs for g, cs in self.features_of.items() if cs != [g]}
        for g, cs in tied.items():
            total = None
            for c in cs:
                total = F.col(f"`{c}`") if total is None else total + F.col(f"`{c}`")
            out = out.withColumn(g, total)
        for p in m.products:
            value = None
            for member in p:
                value = F.col(f"`{member}`") if value is None else value * F.col(f"`{member}`")
            out = out.withColumn(":".join(p), value)
        return out

    def learn(self, responses: Sequence[str], **kw) -> Learned:
        """Kernel parameters of all event terms, for all responses together."""
        return learn(self, responses, **kw)

    def with_kernels(self, kernels: dict[str, Kernel]) -> "Compiled":
        convs = [[replace(c, kernel=kernels.get(c.name, c.kernel)) for c in cs] for cs in self.convs]
        return replace(self, convs=convs)


@dataclass
class FittedModel:
    model: Model
    compiled: Compiled
    fits: dict[str, LinearFit | LikelihoodFit]
    grams: dict[str, Gram]
    kernels: dict[str, Kernel]
    learned: Learned | None = None

    def features(self, X, Y: DataFrame) -> DataFrame:
        """Features of other data, transformed by the statistics of the training data."""
        stats = self.compiled.stats
        Y = self.model.prepared(Y, stats.get("response"))
        again = self.model.compile(X, Y, stats)
        return again.with_kernels(self.kernels).features()

    def ablated(self, response: str, ablatable: Sequence[str]) -> dict[str, LinearFit]:
        """Every ablated variant from the sufficient statistics already gathered: no further pass."""
        if response not in self.grams:
            raise ValueError(f"models of family {self.model.family!r} are fitted again without a term, not ablated from sums")
        out = {}
        for name, drop in self.model.ablations(ablatable).items():
            keep = [f for f in self.compiled.features_of
                    if not any(self.compiled.predictor_of[f] == d or f == d for d in drop)]
            out[name] = solve(self.grams[response], keep, response, self.model.intercept)
        return out

    def predict(self, table: DataFrame, response: str | None = None, into: str = "pred",
                loglik: str = "loglik", obs: str = "obs", keep: Sequence[str] | None = None) -> DataFrame:
        """Prediction, observation and normal log-density per row of a feature table."""
        response = response or self.model.responses[0]
        fit = self.fits[response]
        if isinstance(fit, LikelihoodFit):
            cols = [F.col(f"`{c}`") for c in (keep if keep is not None else table.columns)]
            return table.select(*cols, F.col(f"`{response}`").cast("double").alias(obs), fit.expected().alias(into), fit.density().alias(loglik))
        sigma = max(fit.sigma * math.sqrt(max(fit.n - len(fit.coefs) - 1, 1) / fit.n), 1e-150)
        cols = [F.col(f"`{c}`") for c in (keep if keep is not None else table.columns)]
        out = table.select(*cols, F.col(f"`{response}`").cast("double").alias(obs),
                           linear_predictor(fit.coefs, fit.intercept).alias(into))
        return out.withColumn(loglik, distributions.normal(F.col(obs), F.col(into), F.lit(sigma)))

    def evaluate(self, table: DataFrame, response: str | None = None, by: Sequence[str] = ()) -> DataFrame:
        return metrics(self.predict(table, response), "obs", "pred", by, loglik="loglik")


def two_step(table: DataFrame, features: Sequence[str], response: str) -> tuple[LinearFit, DataFrame]:
    """Regress on standardised convolved columns."""
    names = [f"z({f})" for f in features]
    safe = table.select("*", *[F.col(f"`{f}`").alias(f"_f{i}") for i, f in enumerate(features)])
    safe = apply_ops(safe, [f"z(_f{i})" for i in range(len(features))])
    out = safe.select(*[F.col(f"`{c}`") for c in table.columns],
                      *[F.col(f"`z(_f{i})`").alias(n) for i, n in enumerate(names)])
    return solve(gram(out, [*names, response]), names, response), out


def baseline_merge(X: DataFrame, Y: DataFrame, on: Sequence[str] | None = None) -> DataFrame:
    """Inner merge of events and responses on their shared columns, for plain linear baselines."""
    on = list(on) if on else [c for c in X.columns if c in Y.columns]
    return X.join(Y, on=on, how="inner")


__all__ = ["C", "Model", "Compiled", "FittedModel", "two_step", "baseline_merge"]
