"""Kernel parameters of a whole model, learned together with its coefficients.

Coefficients are solved for at every step (variable projection), so the search is over kernel parameters alone.
A step is one aggregation over windows that were laid out once: sums of the features, and of the kernels' derivatives in
closed form as further terms of the same generated code, go straight into moments.  No pair of an event and a
response is stored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions.kernels import DiracDelta, Kernel
from echoframe.functions.special import ColumnMath
from echoframe.operators.convolve import prepare
from echoframe.operators.regress import Gram, LinearFit, from_free, gram, solve, to_free, upright

if TYPE_CHECKING:
    from echoframe.plans.model import Compiled


@dataclass
class Learned:
    """Kernels by convolved column, the fits of all responses, and how the search ended."""

    kernels: dict[str, Kernel]
    fits: dict[str, LinearFit]
    moments: Gram
    parameters: list[tuple[str, str]]  # (kernel, parameter)
    values: np.ndarray
    cov: np.ndarray  # of the parameters
    gradient: np.ndarray  # in standard errors
    trace: list[float] = field(repr=False)  # negative log-likelihood but for constants
    converged: bool = True


@dataclass
class Point:
    """Moments at one set of parameters, and what they say of the way on."""

    u: np.ndarray
    moments: Gram
    fits: dict[str, LinearFit]
    loss: float
    curvature: np.ndarray
    slope: np.ndarray
    exact: bool


def learn(compiled: "Compiled", responses: Sequence[str], iterations: int = 100, tol: float = 1e-8) -> Learned:
    """Damped Gauss-Newton, with a secant correction, over all free parameters of all event terms.

    All responses share the kernels; each has its own coefficients and variance, and weighs by the latter.  Terms of
    one ``irf_id`` share parameters, terms of one ``coef_id`` a coefficient; ``trainable`` names a term's free
    parameters.  Products after convolution take part.  The search ends when the log-likelihood that a full step
    promises is below ``tol`` (a step of less than 1e-4 standard errors, whatever the number of rows).
    """
    m = compiled.model
    convs = [(s, c) for s, cs in enumerate(cs for cs in compiled.convs if cs) for c in cs]
    owner = {c.name: compiled.irf_ids.get(c.name, c.name) for _, c in convs}
    kernels: dict[str, Kernel] = {}
    for _, c in convs:
        known = kernels.setdefault(owner[c.name], c.kernel)
        if type(known) is not type(c.kernel):
            raise ValueError(f"terms of irf_id {owner[c.name]!r} have kernels of several families")
    limits = {owner[c.name]: compiled.trainable[c.name] for _, c in convs if c.name in compiled.trainable}
    free = [(o, p) for o, k in kernels.items() if not isinstance(k, DiracDelta) for p in k.params if o not in limits or p in limits[o]]
    features = list(compiled.features_of)
    prepared = prepare(compiled.Y, compiled.sources(), m.series, m.history, m.future, m.cutoff, m.time).persist()

    def at(u: np.ndarray) -> dict[str, Kernel]:
        out = dict(kernels)
        for (o, p), x in zip(free, u):
            out[o] = out[o].with_params(**{p: from_free(kernels[o], p, x)})
        return out

    def table(ks: dict[str, Kernel]) -> tuple[DataFrame, dict[str, Column]]:
        """The feature table with the convolved derivatives, and the derivative of each feature by each parameter."""
        extra = [(f"_d{i}_{c.name}", s, c.value, lambda t, k=ks[o], p=p: k.derivative(t, ColumnMath, p))
                 for i, (o, p) in enumerate(free) for s, c in convs if owner[c.name] == o]
        out = compiled.finished(prepared.sums(extra, {c.name: ks[owner[c.name]] for _, c in convs}))
        slopes: dict[str, Column] = {}
        for i, (o, _) in enumerate(free):
            own = {}
            for f, members in compiled.features_of.items():
                for name in members:
                    if owner.get(name) == o:
                        part = F.col(f"`_d{i}_{name}`")
                        own[f] = part if f not in own else own[f] + part
            for p in m.products:
                total = None
                for j, member in enumerate(p):
                    if member in own:
                        part = own[member]
                        for other in (*p[:j], *p[j + 1:]):
                            part = part * F.col(f"`{other}`")
                        total = part if total is None else total + part
                if total is not None:
                    own[":".join(p)] = total
            slopes |= {f"_{i}:{f}": c for f, c in own.items()}
        return out, slopes

    def look(u: np.ndarray) -> Point:
        ks = at(u)
        out, slopes = table(ks)
        g = gram(out, {**{f: F.col(f"`{f}`") for f in features}, **slopes, **{r: F.col(f"`{r}`") for r in responses}})
        M = g.cov if m.intercept else g.raw()
        chain = [_by_free(kernels[o], p, ks[o].params[p]) for o, p in free]
        curvature, slope, loss, fits, exact = np.zeros((len(free), len(free))), np.zeros(len(free)), 0.0, {}, True
        for r in responses:
            fit = solve(g, features, r, m.intercept)
            mse = fit.sigma**2 * max(fit.n - len(features) - m.intercept, 1.0) / max(fit.n, 1.0)
            J, resid = np.zeros((len(free), len(g.names))), np.zeros(len(g.names))
            resid[g.names.index(r)] = 1.0
            for f, b in fit.coefs.items():
                resid[g.names.index(f)] -= b
                for i in range(len(free)):
                    if f"_{i}:{f}" in slopes:
                        J[i, g.names.index(f"_{i}:{f}")] = b * chain[i]
            ix = g.index(features)
            solved = np.linalg.lstsq(M[np.ix_(ix, ix)], (J @ M[:, ix]).T, rcond=1e-12)[0]
            var = float(g.cov[g.names.index(r), g.names.index(r)])
            weight = fit.n / max(mse, 1e-24 * var, 1e-300)
            curvature += weight * (J @ M @ J.T - (J @ M[:, ix]) @ solved)
            slope += weight * (J @ M @ resid)
            loss += 0.5 * fit.n * math.log(max(mse, 1e-24 * var, 1e-300))
            exact &= mse <= 1e-22 * var
            fits[r] = fit
        return Point(u, g, fits, loss, curvature, slope, exact)

    now = None
    try:
        now = look(np.array([to_free(kernels[o], p, kernels[o].params[p]) for o, p in free]))
        trace, damping, converged = [now.loss], 1e-3, not free
        bend = np.zeros((len(free), len(free)))
        for _ in range(iterations if free else 0):
            unit = np.sqrt(np.maximum(np.diag(now.curvature), 1e-300))
            H, down = upright((now.curvature + bend) / np.outer(unit, unit)), now.slope / unit
            promise = float(down @ np.linalg.solve(H, down))
            if promise < tol or now.exact:
                converged = True
                break
            step = np.linalg.solve(H + damping * np.eye(len(free)), down) / unit
            step = step * min(1.0, 1.5 / max(np.abs(step).max(), 1e-300))
            if np.abs(step).max() < 1e-11:
                converged = True
                break
            then = look(now.u + step)
            # What the curvature leaves out where residuals are large, from how the slope changed along the step.
            miss = now.slope - then.slope - (then.curvature + bend) @ step
            if abs(miss @ step) > 1e-8 * np.linalg.norm(miss) * np.linalg.norm(step):
                bend = bend + np.outer(miss, miss) / (miss @ step)
            if then.loss < now.loss:
                # While the error falls fast, residuals are still large for want of a fit: no correction then.
                bend = bend * (now.loss - then.loss < 0.1 * now.moments.n)
                now, damping = then, damping / 10 if damping > 1e-9 else 0.0
                trace.append(now.loss)
            else:
                damping = max(damping * 10, 1e-6)
                if damping > 1e10:
                    # No shorter step lowers the loss either: it is as low as it can be told.
                    converged = True
                    break
    finally:
        prepared.unpersist()
    if not converged:
        warnings.warn(f"kernels not converged after {iterations} steps", stacklevel=2)
    ks = at(now.u)
    values = np.array([ks[o].params[p] for o, p in free])
    chain = np.array([_by_free(kernels[o], p, ks[o].params[p]) for o, p in free])
    cov = np.linalg.pinv(now.curvature) * np.outer(chain, chain) if free else np.zeros((0, 0))
    gradient = now.slope / np.sqrt(np.maximum(np.diag(now.curvature), 1e-300))
    return Learned({c.name: ks[owner[c.name]] for _, c in convs}, now.fits, now.moments, free, values, cov, gradient, trace, converged)


def _by_free(kernel: Kernel, p: str, v: float) -> float:
    """Derivative of a parameter by what the search moves."""
    low, high = kernel.bounds.get(p, (None, None))
    return v - low if low is not None else v - high if high is not None else 1.0


__all__ = ["Learned", "learn"]
