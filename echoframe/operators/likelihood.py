"""Maximum likelihood of response distributions, any of whose parameters may depend on features."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions.distributions import DISTRIBUTIONS, LOG_2PI
from echoframe.functions.special import erfcx_scalar
from echoframe.operators.regress import linear_predictor, ols, upright

#: Parameters that are positive: their linear predictors are logarithms.
POSITIVE = ("sigma", "tailweight", "beta")

#: Families of logarithms: no parameters allow a response of 0 or less.
LOGARITHMIC = ("lognormal", "lognormalv2")

#: Where the search for a constant parameter begins, given the spread s of the response about its mean.
STARTS = {"sigma": lambda s: s, "skewness": lambda s: 0.0, "tailweight": lambda s: 1.0, "beta": lambda s: 1.0 / s}


@dataclass
class LikelihoodFit:
    """Coefficients of the first parameter, values of constant ones, and linear predictors of the others.

    With ``impossible`` responses the likelihood is 0 whatever the parameters: all estimates are NaN, predictions and
    densities null.
    """

    family: str
    response: str
    coefs: dict[str, float]
    intercept: float
    shape: dict[str, float]
    loglik: float
    n: int
    gradient: np.ndarray  # in standard errors
    converged: bool
    by: dict[str, tuple[float, dict[str, float]]] = field(default_factory=dict)
    impossible: int = 0

    def parameters(self) -> dict[str, Column]:
        """Every parameter as a column of a table with the features."""
        first = DISTRIBUTIONS[self.family][1][0]
        if self.impossible:
            return {p: F.lit(None).cast("double") for p in DISTRIBUTIONS[self.family][1]}
        out = {first: linear_predictor(self.coefs, self.intercept), **{p: F.lit(float(v)) for p, v in self.shape.items()}}
        out |= {p: linear_predictor(b, b0) for p, (b0, b) in self.by.items()}
        for p in [first, *self.by]:
            if p in POSITIVE:
                out[p] = F.exp(out[p])
        return out

    def density(self) -> Column:
        function, names, _ = DISTRIBUTIONS[self.family]
        have = self.parameters()
        return function(F.col(f"`{self.response}`").cast("double"), *[have[p] for p in names])

    def score(self, df: DataFrame, into: str = "loglik") -> DataFrame:
        """Log-likelihood of every row."""
        return df.withColumn(into, self.density())

    def expected(self) -> Column:
        """The mean of the response where it has a closed form, else its location."""
        p = self.parameters()
        if self.family == "lognormal":
            return F.exp(p["mu"] + p["sigma"] * p["sigma"] * 0.5)
        if self.family == "exgaussian":
            return p["mu"] + F.lit(1.0) / p["beta"]
        if self.family == "exgaussianinvrate":
            return p["mu"] + p["beta"]
        if self.family == "exponential":
            return F.lit(1.0) / p["beta"]
        if self.family == "bernoulli":
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-p["logit"]))
        return p["mu"]

    def predict(self, df: DataFrame, into: str = "pred") -> DataFrame:
        return df.withColumn(into, self.expected())


def fit_likelihood(df: DataFrame, features: Sequence[str], response: str, family: str, iterations: int = 100, tol: float = 1e-10,
                   by: dict[str, Sequence[str]] | None = None, impossible: str = "error") -> LikelihoodFit:
    """Fit a distribution whose parameters are linear in features by block scoring.

    ``features`` belong to the first parameter (the location, where there is one), ``by`` names those of others;
    parameters without features are constants.  Positive parameters are linear on the log scale.

    A step is one aggregation at the point it leads to: the log-likelihood, and sums and products of each row's scores (central
    differences of the log-density by each parameter, times that parameter's features), of which each task sends one row.  It is taken if the
    likelihood rose, else damped.  The fit has converged when a full step promises less than ``tol`` of log-likelihood,
    whatever the number of rows.

    Rows with a missing response or feature are left out.  All others count: a point that makes one impossible is
    refused, and a response that the family does not allow at all is an error, or with ``impossible="undefined"`` leaves
    all estimates undefined: no response is left out for the sake of the others.
    """
    density, names, _ = DISTRIBUTIONS[family]
    if impossible not in ("error", "undefined"):
        raise ValueError(f"impossible responses are 'error' or 'undefined', not {impossible!r}")
    if family == "categorical":
        raise ValueError("see fit_family for categories")
    design = {p: list(features) if i == 0 else list((by or {}).get(p, ())) for i, p in enumerate(names)}
    unknown = set(by or ()) - set(names)
    if unknown:
        raise ValueError(f"{family!r} has no parameter {', '.join(sorted(unknown))}")
    used = list(dict.fromkeys(f for fs in design.values() for f in fs))
    y = F.col("_y")
    data = df.select(F.col(f"`{response}`").cast("double").alias("_y"), *[F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(used)])
    ok = " and ".join(f"{c} is not null and not isnan({c})" for c in data.columns)
    data = data.where(ok).persist(StorageLevel.MEMORY_AND_DISK)
    number = {f: i for i, f in enumerate(used)}
    slots = [(p, f) for p in names for f in (None, *design[p])]
    try:
        told = data.agg(F.count("*").alias("n"), F.avg("_y").alias("m"), F.stddev_samp("_y").alias("s"), F.count_if(y <= 0).alias("low"),
                        *[a for i in range(len(used)) for a in (F.avg(f"_x{i}").alias(f"m{i}"), F.stddev_pop(f"_x{i}").alias(f"s{i}"))]).first()
        n = told["n"]
        if not n:
            raise ValueError("no complete rows")
        if family in LOGARITHMIC and told["low"]:
            return _undefined(family, response, design, int(n), told["low"], impossible)
        mean = [told[f"m{i}"] for i in range(len(used))]
        sd = [told[f"s{i}"] or 1.0 for i in range(len(used))]
        u, spread = _start(data, slots, number, mean, sd, family, told)
        size = [1e-4 if p in POSITIVE or p in ("skewness", "logit") else 1e-4 * spread for p in names]
        k, owner = len(slots), np.array([names.index(p) for p, _ in slots])
        columns = [-1 if f is None else number[f] for _, f in slots]
        centre, scale, positive = np.array(mean), np.array(sd), [p in POSITIVE for p in names]

        def scores(u):
            """Task function: a row of sums over its rows of the log-likelihood, the scores and their products."""
            def rows(batches):
                total = np.zeros(2 + k + k * k)
                for b in batches:
                    v = np.array([b.column(i).to_numpy() for i in range(b.num_columns)])
                    z = (v[1:] - centre[:, None]) / scale[:, None] if len(centre) else v[1:]
                    x = np.array([np.ones(len(v[0])) if c < 0 else z[c] for c in columns])
                    etas = np.array([u[owner == i] @ x[owner == i] for i in range(len(names))])
                    with np.errstate(all="ignore"):
                        at = lambda e: log_density(family, v[0], [np.exp(a) if up else a for a, up in zip(e, positive)])
                        ll, s = at(etas), np.empty_like(etas)
                        for i, h in enumerate(size):
                            move = np.zeros((len(names), 1))
                            move[i] = h
                            s[i] = (at(etas + move) - at(etas - move)) / (2 * h)
                    fine = np.isfinite(ll) & np.isfinite(s).all(axis=0)
                    own = (s[owner] * x)[:, fine]
                    total += np.concatenate(([fine.sum(), ll[fine].sum()], own.sum(axis=1), (own @ own.T).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([t]) for t in total], names=[f"t{i}" for i in range(len(total))])

            return rows

        schema = ", ".join(f"t{i} double" for i in range(2 + k + k * k))

        def look(u):
            row = np.array(data.mapInArrow(scores(u), schema).agg(*[F.sum(f"t{i}") for i in range(2 + k + k * k)]).first(), dtype=float)
            if row[0] < n:
                return None, n - row[0]
            # Products of scores estimate the curvature of the log-likelihood.
            return (row[1], row[2:2 + k], row[2 + k:].reshape(k, k)), 0

        slopes = np.array([f is not None for _, f in slots])
        now, lost = look(u)
        for _ in range(8):
            if now is None and slopes.any():
                u = np.where(slopes, u / 2, u)
                now, lost = look(u)
        if now is None and slopes.any():
            u = np.where(slopes, 0.0, u)
            now, lost = look(u)
        if now is None:
            return _undefined(family, response, design, int(n), int(lost), impossible)
        bend, damping, converged = np.zeros((len(u), len(u))), 1e-4, False
        for _ in range(iterations):
            unit = np.sqrt(np.maximum(np.diag(now[2]), 1e-300))
            H, up = upright((now[2] + bend) / np.outer(unit, unit)), now[1] / unit
            if float(up @ np.linalg.solve(H, up)) < tol:
                # The last two steps are too short to be told by the likelihood, but not by the parameters.
                converged, last = True, np.linalg.solve(H, up) / unit
                then, _ = look(u + last)
                if then is not None:
                    miss = now[1] - then[1] - (then[2] + bend) @ last
                    if abs(miss @ last) > 1e-8 * np.linalg.norm(miss) * np.linalg.norm(last):
                        bend = bend + np.outer(miss, miss) / (miss @ last)
                    u, now = u + last, then
                    H = upright((now[2] + bend) / np.outer(unit, unit))
                    u = u + np.linalg.solve(H, now[1] / unit) / unit
                break
            step = np.linalg.solve(H + damping * np.eye(len(u)), up) / unit
            step = step * min(1.0, min([1.0 / abs(s) for (p, _), s in zip(slots, step) if p in POSITIVE and s] or [1.0]))
            then, _ = look(u + step)
            if then is not None:
                miss = now[1] - then[1] - (then[2] + bend) @ step
                if abs(miss @ step) > 1e-8 * np.linalg.norm(miss) * np.linalg.norm(step):
                    bend = bend + np.outer(miss, miss) / (miss @ step)
            if then is not None and then[0] > now[0]:
                u, now, damping = u + step, then, damping / 10 if damping > 1e-9 else 0.0
            else:
                damping = max(damping * 10, 1e-6)
                if damping > 1e10:
                    # No shorter step gains either: the likelihood is as high as it can be told.
                    converged = bool(np.abs(up).max() < 0.01)
                    break
    finally:
        data.unpersist()
    if not converged:
        warnings.warn(f"{family} not converged", stacklevel=2)
    found: dict[str, tuple[float, dict[str, float]]] = {}
    for p in names:
        own = {f: float(v / sd[number[f]]) for (q, f), v in zip(slots, u) if q == p and f is not None}
        first = float(u[slots.index((p, None))]) - sum(b * mean[number[f]] for f, b in own.items())
        found[p] = (first, own)
    shape = {p: math.exp(found[p][0]) if p in POSITIVE else found[p][0] for p in names[1:] if not design[p]}
    return LikelihoodFit(family, response, found[names[0]][1], found[names[0]][0], shape, float(now[0]), int(n),
                         now[1] / np.sqrt(np.maximum(np.diag(now[2]), 1e-300)), converged,
                         {p: found[p] for p in names[1:] if design[p]})


def _undefined(family: str, response: str, design: dict[str, list[str]], n: int, lost: int, impossible: str) -> LikelihoodFit:
    """The fit of data that the family does not allow, unless that is an error.  Nothing is left to search for."""
    if impossible == "error":
        raise ValueError(f"{lost} of {n} responses are impossible under {family!r}")
    first, *others = design
    nan = {p: dict.fromkeys(fs, math.nan) for p, fs in design.items()}
    return LikelihoodFit(family, response, nan[first], math.nan, {p: math.nan for p in others if not design[p]}, -math.inf, n,
                         np.full(sum(1 + len(fs) for fs in design.values()), math.nan), True,
                         {p: (math.nan, nan[p]) for p in others if design[p]}, lost)


def log_density(family: str, y: np.ndarray, p: Sequence[np.ndarray]) -> np.ndarray:
    """The log-densities of ``functions.distributions`` on arrays; not finite where a response is impossible."""
    if family == "exponential":
        return np.where(y >= 0, np.log(p[0]) - p[0] * y, -np.inf)
    if family == "bernoulli":
        return y * p[0] - np.logaddexp(0.0, p[0])
    mu, sigma = p[:2]
    if family == "lognormalv2":
        var = np.log1p((sigma / mu) ** 2)
        mu, sigma = np.log(mu) - var / 2, np.sqrt(var)
    if family in ("normal", "lognormal", "lognormalv2"):
        t = y if family == "normal" else np.log(y)
        z = (t - mu) / sigma
        return -0.5 * LOG_2PI - np.log(sigma) - 0.5 * z * z - (0.0 if family == "normal" else t)
    if family == "johnsonsu":
        w = (y - mu) / sigma
        z = p[2] + p[3] * np.arcsinh(w)
        return np.log(p[3]) - np.log(sigma) - 0.5 * np.log1p(w * w) - 0.5 * LOG_2PI - 0.5 * z * z
    if family == "sinharcsinh":
        scale = sigma * 2 / np.sinh(np.arcsinh(2.0) * p[3])
        w = (y - mu) / scale
        inner = np.arcsinh(w) / p[3] - p[2]
        return -0.5 * LOG_2PI - 0.5 * np.sinh(inner) ** 2 + np.log(np.cosh(inner)) - np.log(p[3]) - np.log(scale) - 0.5 * np.log1p(w * w)
    beta = 1.0 / p[2] if family == "exgaussianinvrate" else p[2]
    u, z = (y - mu) / sigma, (mu + beta * sigma**2 - y) / (sigma * math.sqrt(2.0))
    # Where z is large erfc vanishes and the leading factor grows; scaled, what is left is a normal density.
    # Made here: a vectorised function that was used before cannot be sent to workers.
    erfc, erfcx = (np.vectorize(f, otypes=[float]) for f in (math.erfc, erfcx_scalar))
    above = -0.5 * u * u + np.log(erfcx(np.maximum(z, 0.0)))
    below = beta * (mu - y) + 0.5 * (beta * sigma) ** 2 + np.log(erfc(np.minimum(z, 0.0)))
    return np.log(beta) - math.log(2.0) + np.where(z > 0, above, below)


def _start(data: DataFrame, slots, number, mean, sd, family: str, told) -> tuple[np.ndarray, float]:
    """Where the search begins, and the spread of what the location is a location of."""
    first = slots[0][0]
    own = [f for p, f in slots if p == first and f is not None]
    values: dict[tuple, float] = {}
    if first == "mu":
        target = data.select((F.log("_y") if family == "lognormal" else F.col("_y")).alias("_t"), *[
            ((F.col(f"_x{number[f]}") - mean[number[f]]) / sd[number[f]]).alias(f"_z{number[f]}") for f in own])
        fit = ols(target, [f"_z{number[f]}" for f in own], "_t")
        s = fit.sigma if math.isfinite(fit.sigma) and fit.sigma > 0 else 1.0
        values[first, None] = fit.intercept if math.isfinite(fit.intercept) else 0.0
        values |= {(first, f): fit.coefs[f"_z{number[f]}"] for f in own}
        for p in STARTS:
            values[p, None] = math.log(STARTS[p](s)) if p in POSITIVE else STARTS[p](s)
        if family == "exgaussianinvrate":
            values["beta", None] = -values["beta", None]
        if family.startswith("exgaussian"):
            # Half of the variance in either part.
            values[first, None] -= s * math.sqrt(0.5)
            values["sigma", None] += 0.5 * math.log(0.5)
    else:
        s = 1.0
        m = told["m"]
        values[first, None] = (math.log(1.0 / m) if m and m > 0 else 0.0) if first == "beta" else math.log(max(m, 1e-3) / max(1 - m, 1e-3))
    return np.array([values.get(slot, 0.0) for slot in slots]), s
