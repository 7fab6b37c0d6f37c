"""Impulse response kernels: weight of an event as a function of its delay.

A kernel is a few numbers on the driver.  ``column(t)`` gives its value for a column of delays;
normalisers depend on parameters only and enter the expression as literals.  ``on_grid`` evaluates
the same definition on a numpy grid.  New kernels subclass :class:`Kernel`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, fields, replace
from typing import ClassVar

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from echoframe.functions.special import (
    ArrayMath,
    ColumnMath,
    beta_cdf,
    digamma,
    erfcx_scalar,
    gamma_cdf,
    normal_cdf_scalar,
)

# Added to normalisers, and to the delay of kernels that are singular at zero: 4 float32 epsilons.
EPSILON = 4 * 1.1920928955078125e-07
ROOT_2PI = math.sqrt(2 * math.pi)


@dataclass(frozen=True)
class Kernel:
    """Base: ``support_ub`` bounds the support from above when the normaliser should respect it."""

    support_ub: float | None = field(default=None, kw_only=True)
    causal: ClassVar[bool] = True
    bounds: ClassVar[dict[str, tuple[float | None, float | None]]] = {}

    def __post_init__(self):
        for name, (low, high) in self.bounds.items():
            value = getattr(self, name)
            if low is not None and not value > low:
                raise ValueError(f"{type(self).__name__}: {name} must exceed {low}, got {value}")
            if high is not None and not value < high:
                raise ValueError(f"{type(self).__name__}: {name} must be below {high}, got {value}")

    def shape(self, x, m):
        raise NotImplementedError

    def slope(self, x, m, param: str):
        """Derivative of the shape by a parameter, in closed form."""
        raise NotImplementedError(f"{type(self).__name__} has no derivative by {param}")

    def normaliser(self) -> float:
        return 1.0

    def normaliser_slope(self, param: str) -> float:
        """Derivative of the normaliser, a number that depends on parameters only: differences of four points."""
        v = self.params[param]
        low, high = self.bounds.get(param, (None, None))
        h = 1e-3 * max(abs(v), 1e-2)
        for edge in (low, high):
            h = h if edge is None else min(h, abs(v - edge) / 4)
        at = [self.with_params(**{param: v + k * h}).normaliser() for k in (-2, -1, 1, 2)]
        return (8 * (at[2] - at[1]) - (at[3] - at[0])) / (12 * h)

    def derivative(self, t, m, param: str):
        """Derivative of the whole kernel by a parameter, on columns (``ColumnMath``) or grids (``ArrayMath``)."""
        z, dz = self.normaliser(), self.normaliser_slope(param)
        out = self.slope(t, m, param) * (1.0 / z)
        return out - self.shape(t, m) * (dz / z**2) if dz else out

    def column(self, t: Column) -> Column:
        return self.shape(t, ColumnMath) * F.lit(1.0 / self.normaliser())

    def on_grid(self, t) -> np.ndarray:
        return self.shape(np.asarray(t, dtype=float), ArrayMath) * (1.0 / self.normaliser())

    @property
    def params(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "support_ub"}

    def with_params(self, **params: float) -> "Kernel":
        return replace(self, **params)


@dataclass(frozen=True)
class DiracDelta(Kernel):
    """Only an event simultaneous with the response counts, with weight 1."""

    tolerance: ClassVar[float] = 1.1920929e-07
    causal: ClassVar[bool] = False

    def column(self, t: Column) -> Column:
        return F.when(F.abs(t) <= self.tolerance, 1.0).otherwise(0.0)

    def on_grid(self, t) -> np.ndarray:
        return (np.abs(np.asarray(t, dtype=float)) <= self.tolerance).astype(float)


@dataclass(frozen=True)
class Exp(Kernel):
    beta: float = 1.0
    bounds = {"beta": (0.0, None)}

    def shape(self, x, m):
        return m.exp(x * -self.beta) * self.beta

    def slope(self, x, m, param):
        return m.exp(x * -self.beta) * (x * -self.beta + 1.0)

    def normaliser(self):
        return 1.0 if self.support_ub is None else -math.expm1(-self.beta * self.support_ub) + EPSILON


@dataclass(frozen=True)
class ExpRateGT1(Exp):
    beta: float = 2.0
    bounds = {"beta": (1.0, None)}


def _gamma_pdf(x, m, shape: float, rate: float):
    log_scale = shape * math.log(rate) - math.lgamma(shape)
    return m.exp(m.log(x) * (shape - 1.0) - x * rate + log_scale)


def _gamma_slopes(x, m, shape: float, rate: float):
    """The gamma density and its derivatives by shape, rate and place."""
    f = _gamma_pdf(x, m, shape, rate)
    return f, f * (m.log(x) + (math.log(rate) - digamma(shape))), f * (x * -1.0 + shape / rate), f * ((shape - 1.0) / x - rate)


@dataclass(frozen=True)
class Gamma(Kernel):
    alpha: float = 2.0
    beta: float = 1.0
    bounds = {"alpha": (0.0, None), "beta": (0.0, None)}

    def shape(self, x, m):
        return _gamma_pdf(m.floor_at(x, 0.0) + EPSILON, m, self.alpha, self.beta)

    def slope(self, x, m, param):
        _, by_alpha, by_beta, _ = _gamma_slopes(m.floor_at(x, 0.0) + EPSILON, m, self.alpha, self.beta)
        return by_alpha if param == "alpha" else by_beta

    def normaliser(self):
        return 1.0 if self.support_ub is None else gamma_cdf(self.support_ub, self.alpha, self.beta) + EPSILON


@dataclass(frozen=True)
class GammaShapeGT1(Gamma):
    bounds = {"alpha": (1.0, None), "beta": (0.0, None)}


@dataclass(frozen=True)
class HRFSingleGamma(Gamma):
    alpha: float = 6.0
    beta: float = 1.0


@dataclass(frozen=True)
class ShiftedGamma(Kernel):
    alpha: float = 2.0
    beta: float = 1.0
    delta: float = -1.0
    bounds = {"alpha": (0.0, None), "beta": (0.0, None), "delta": (None, 0.0)}

    def shape(self, x, m):
        return _gamma_pdf(m.floor_at(x, 0.0) - self.delta, m, self.alpha, self.beta)

    def slope(self, x, m, param):
        _, by_alpha, by_beta, by_place = _gamma_slopes(m.floor_at(x, 0.0) - self.delta, m, self.alpha, self.beta)
        return {"alpha": by_alpha, "beta": by_beta, "delta": by_place * -1.0}[param]

    def normaliser(self):
        top = 1.0 if self.support_ub is None else gamma_cdf(
            self.support_ub - self.delta, self.alpha, self.beta)
        return top - gamma_cdf(-self.delta, self.alpha, self.beta) + EPSILON


@dataclass(frozen=True)
class ShiftedGammaShapeGT1(ShiftedGamma):
    bounds = {"alpha": (1.0, None), "beta": (0.0, None), "delta": (None, 0.0)}


@dataclass(frozen=True)
class Normal(Kernel):
    """``sigma`` is the standard deviation.  ``support_lb`` None: not renormalised below."""

    mu: float = 0.0
    sigma: float = 1.0
    support_lb: float | None = field(default=0.0, kw_only=True)
    causal: ClassVar[bool] = False
    bounds = {"sigma": (0.0, None)}

    @property
    def params(self):
        return {"mu": self.mu, "sigma": self.sigma}

    def cdf(self, x: float) -> float:
        return normal_cdf_scalar((x - self.mu) / self.sigma)

    def shape(self, x, m):
        z = (x - self.mu) / self.sigma
        return m.exp(z * z * -0.5) / (self.sigma * ROOT_2PI)

    def slope(self, x, m, param):
        z = (x - self.mu) / self.sigma
        return self.shape(x, m) * (z if param == "mu" else z * z - 1.0) * (1.0 / self.sigma)

    def normaliser(self):
        low = 0.0 if self.support_lb is None else self.cdf(self.support_lb)
        high = 1.0 if self.support_ub is None else self.cdf(self.support_ub)
        return high - low + EPSILON


@dataclass(frozen=True)
class SkewNormal(Kernel):
    """Proper skew-normal density, normalised over its support."""

    mu: float = 0.0
    sigma: float = 1.0
    alpha: float = 1.0
    support_lb: float | None = field(default=0.0, kw_only=True)
    causal: ClassVar[bool] = False
    bounds = {"sigma": (0.0, None)}

    @property
    def params(self):
        return {"mu": self.mu, "sigma": self.sigma, "alpha": self.alpha}

    def shape(self, x, m):
        z = (x - self.mu) / self.sigma
        phi = m.exp(z * z * -0.5) / ROOT_2PI
        return phi * m.erfc(z * (-self.alpha / math.sqrt(2.0))) / self.sigma

    def slope(self, x, m, param):
        z = (x - self.mu) / self.sigma
        phi = m.exp(z * z * -0.5) / ROOT_2PI
        lean = phi * m.exp(z * z * (-0.5 * self.alpha**2)) * math.sqrt(2.0 / math.pi)
        if param == "alpha":
            return lean * z * (1.0 / self.sigma)
        by_z = lean * (self.alpha / self.sigma) - self.shape(x, m) * z
        return by_z * (-1.0 / self.sigma) if param == "mu" else (by_z * z + self.shape(x, m)) * (-1.0 / self.sigma)

    def normaliser(self):
        reach = 12.0 * self.sigma
        low = self.mu - reach if self.support_lb is None else max(self.support_lb, self.mu - reach)
        high = self.mu + reach if self.support_ub is None else min(self.support_ub, self.mu + reach)
        if high <= low:
            return EPSILON
        grid = np.linspace(low, high, 20_001)
        value = self.shape(grid, ArrayMath)
        # Two trapezoid sums, extrapolated to a step of 0 (Simpson's rule).
        fine, coarse = np.trapezoid(value, grid), np.trapezoid(value[::2], grid[::2])
        return float((4 * fine - coarse) / 3) + EPSILON


@dataclass(frozen=True)
class EMG(Kernel):
    """Exponentially modified Gaussian: a normal delay followed by an exponential one."""

    mu: float = 0.0
    sigma: float = 1.0
    beta: float = 1.0
    support_lb: float | None = field(default=0.0, kw_only=True)
    causal: ClassVar[bool] = False
    bounds = {"sigma": (0.0, None), "beta": (0.0, None)}

    @property
    def params(self):
        return {"mu": self.mu, "sigma": self.sigma, "beta": self.beta}

    def shape(self, x, m):
        # exp(lead) grows where erfc(z) vanishes; there both are one scaled function times a normal density.
        u = (x - self.mu) * (1.0 / self.sigma)
        lead = (x - self.mu - 0.5 * self.beta * self.sigma**2) * -self.beta
        z = (x - (self.mu + self.beta * self.sigma**2)) * (-1.0 / (math.sqrt(2.0) * self.sigma))
        early, late = m.floor_at(z, 0.0), m.floor_at(z * -1.0, 0.0) * -1.0
        before = m.exp(u * u * -0.5) * m.erfcx(early)
        after = m.exp(m.floor_at(lead * -1.0, 0.0) * -1.0) * m.erfc(late)
        return m.pick(z > 0.0, before, after) * (0.5 * self.beta)

    def slope(self, x, m, param):
        f, u = self.shape(x, m), (x - self.mu) * (1.0 / self.sigma)
        bell = m.exp(u * u * -0.5) * (1.0 / (self.sigma * ROOT_2PI))
        if param == "mu":
            return (f - bell) * self.beta
        if param == "beta":
            return f * ((x - self.mu) * -1.0 + (1.0 / self.beta + self.beta * self.sigma**2)) - bell * (self.beta * self.sigma**2)
        return f * (self.beta**2 * self.sigma) - bell * (u * (1.0 / self.sigma) + self.beta) * (self.beta * self.sigma)

    def cdf(self, x: float) -> float:
        u = (x - self.mu) / self.sigma
        v = self.beta * self.sigma
        w = (v - u) / math.sqrt(2.0)
        if w > 0:
            return normal_cdf_scalar(u) - 0.5 * math.exp(-0.5 * u * u) * erfcx_scalar(w)
        return normal_cdf_scalar(u) - math.exp(-v * u + 0.5 * v * v) * normal_cdf_scalar(u - v)

    def normaliser(self):
        low = 0.0 if self.support_lb is None else self.cdf(self.support_lb)
        high = 1.0 if self.support_ub is None else self.cdf(self.support_ub)
        return high - low + EPSILON


@dataclass(frozen=True)
class BetaPrime(Kernel):
    alpha: float = 2.0
    beta: float = 2.0
    bounds = {"alpha": (0.0, None), "beta": (0.0, None)}

    def _density(self, x, m):
        log_beta = math.lgamma(self.alpha) + math.lgamma(self.beta) - math.lgamma(self.alpha + self.beta)
        return m.exp(m.log(x) * (self.alpha - 1.0) - m.log(x + 1.0) * (self.alpha + self.beta) - log_beta)

    def _slopes(self, x, m, param):
        f, both = self._density(x, m), digamma(self.alpha + self.beta)
        if param == "alpha":
            return f * (m.log(x) - m.log(x + 1.0) + (both - digamma(self.alpha)))
        if param == "beta":
            return f * (m.log(x + 1.0) * -1.0 + (both - digamma(self.beta)))
        return f * ((self.alpha + self.beta) / (x + 1.0) - (self.alpha - 1.0) / x)

    def cdf(self, x: float) -> float:
        return beta_cdf(x / (1.0 + x), self.alpha, self.beta)

    def shape(self, x, m):
        return self._density(m.floor_at(x, 0.0) + EPSILON, m)

    def slope(self, x, m, param):
        return self._slopes(m.floor_at(x, 0.0) + EPSILON, m, param)

    def normaliser(self):
        return 1.0 if self.support_ub is None else self.cdf(self.support_ub) + EPSILON


@dataclass(frozen=True)
class ShiftedBetaPrime(BetaPrime):
    delta: float = -1.0
    bounds = {"alpha": (0.0, None), "beta": (0.0, None), "delta": (None, 0.0)}

    def shape(self, x, m):
        return self._density(m.floor_at(x, 0.0) - self.delta, m)

    def slope(self, x, m, param):
        return self._slopes(m.floor_at(x, 0.0) - self.delta, m, param)

    def normaliser(self):
        high = 1.0 if self.support_ub is None else self.cdf(self.support_ub - self.delta)
        return high - self.cdf(-self.delta) + EPSILON


@dataclass(frozen=True)
class DoubleGamma(Kernel):
    """Main gamma response minus ``c`` times an undershoot gamma response.

    Subclasses differ in which of the five numbers they leave free.
    """

    def parts(self) -> tuple[float, float, float, float, float]:
        """Main and undershoot shapes, main and undershoot rates, ``c``."""
        raise NotImplementedError

    def shape(self, x, m):
        a1, a2, b1, b2, c = self.parts()
        x = m.floor_at(x, 0.0) + EPSILON
        return _gamma_pdf(x, m, a1, b1) - _gamma_pdf(x, m, a2, b2) * c

    def slope(self, x, m, param):
        a1, a2, b1, b2, c = self.parts()
        # The five numbers are sums of parameters and constants: a step of 1 tells how each depends on one.
        moved = self.with_params(**{param: self.params[param] + 1.0}).parts()
        d = [round(after - before, 9) for after, before in zip(moved, (a1, a2, b1, b2, c))]
        x = m.floor_at(x, 0.0) + EPSILON
        main, main_a, main_b, _ = _gamma_slopes(x, m, a1, b1)
        under, under_a, under_b, _ = _gamma_slopes(x, m, a2, b2)
        return main_a * d[0] + main_b * d[2] - (under_a * d[1] + under_b * d[3]) * c - under * d[4]

    def normaliser(self):
        a1, a2, b1, b2, c = self.parts()
        if self.support_ub is None:
            return 1.0 - c + EPSILON
        return gamma_cdf(self.support_ub, a1, b1) - c * gamma_cdf(self.support_ub, a2, b2) + EPSILON


@dataclass(frozen=True)
class HRFDoubleGamma1(DoubleGamma):
    beta: float = 1.0
    bounds = {"beta": (0.0, None)}

    def parts(self):
        return 6.0, 16.0, self.beta, self.beta, 1.0 / 6.0


@dataclass(frozen=True)
class HRFDoubleGamma2(DoubleGamma):
    alpha: float = 6.0
    beta: float = 1.0
    bounds = {"alpha": (0.0, None), "beta": (0.0, None)}

    def parts(self):
        return self.alpha, self.alpha + 10.0, self.beta, self.beta, 1.0 / 6.0


@dataclass(frozen=True)
class HRFDoubleGamma3(DoubleGamma):
    alpha: float = 6.0
    beta: float = 1.0
    c: float = 1.0 / 6.0
    bounds = {"alpha": (0.0, None), "beta": (0.0, None)}

    def parts(self):
        return self.alpha, self.alpha + 10.0, self.beta, self.beta, self.c


@dataclass(frozen=True)
class HRFDoubleGamma4(DoubleGamma):
    alpha_main: float = 6.0
    alpha_undershoot: float = 16.0
    beta: float = 1.0
    c: float = 1.0 / 6.0
    bounds = {"alpha_main": (0.0, None), "alpha_undershoot": (0.0, None), "beta": (0.0, None)}

    def parts(self):
        return self.alpha_main, self.alpha_undershoot, self.beta, self.beta, self.c


@dataclass(frozen=True)
class HRFDoubleGamma5(DoubleGamma):
    alpha_main: float = 6.0
    alpha_undershoot: float = 16.0
    beta_main: float = 1.0
    beta_undershoot: float = 1.0
    c: float = 1.0 / 6.0
    bounds = {"alpha_main": (0.0, None), "alpha_undershoot": (0.0, None), "beta_main": (0.0, None),
              "beta_undershoot": (0.0, None)}

    def parts(self):
        return self.alpha_main, self.alpha_undershoot, self.beta_main, self.beta_undershoot, self.c


@dataclass(frozen=True)
class LCG(Kernel):
    """Linear combination of Gaussians: centres, widths and amplitudes.

    Linear in the amplitudes, so :meth:`basis` kernels can be fitted by ordinary regression.
    """

    centers: tuple[float, ...] = tuple(float(i) for i in range(10))
    widths: tuple[float, ...] = (1.0,) * 10
    amplitudes: tuple[float, ...] = (0.1,) * 10
    support_lb: float | None = field(default=0.0, kw_only=True)
    causal: ClassVar[bool] = False

    @classmethod
    def spaced(cls, bases: int = 10, upto: float = 1.0, **kw) -> "LCG":
        step = upto / max(bases - 1, 1)
        return cls(tuple(i * step for i in range(bases)), (step,) * bases, (1.0 / bases,) * bases, **kw)

    @property
    def params(self):
        return {f"y{i + 1}": v for i, v in enumerate(self.amplitudes)}

    def with_params(self, **params):
        amps = tuple(params.get(f"y{i + 1}", v) for i, v in enumerate(self.amplitudes))
        return replace(self, amplitudes=amps)

    def _normals(self) -> list[Normal]:
        return [Normal(c, s + EPSILON, support_lb=self.support_lb, support_ub=self.support_ub)
                for c, s in zip(self.centers, self.widths)]

    def basis(self) -> list[Kernel]:
        return [Normal(c, s + EPSILON, support_lb=None) for c, s in zip(self.centers, self.widths)]

    def shape(self, x, m):
        total = None
        for n, v in zip(self._normals(), self.amplitudes):
            part = n.shape(x, m) * v
            total = part if total is None else total + part
        return total

    def slope(self, x, m, param):
        return self._normals()[int(param[1:]) - 1].shape(x, m)

    def normaliser(self):
        mass = sum(v * (n.normaliser() - EPSILON) for n, v in zip(self._normals(), self.amplitudes))
        return mass + EPSILON


@dataclass(frozen=True)
class Composed(Kernel):
    """Convolution of two kernels over ``[0, reach]``, tabulated once and interpolated linearly.

    ``reach`` is the longest delay that can occur (a window's cutoff, say); a longer one is an error.
    """

    first: Kernel = Exp()
    second: Kernel = Exp()
    reach: float | None = None
    n_interp: int = 1000

    @property
    def params(self):
        return {}

    def __post_init__(self):
        if self.reach is None or self.reach <= 0:
            raise ValueError("a composed kernel needs its reach: the longest delay that can occur")

    def table(self) -> tuple[float, np.ndarray]:
        t = np.linspace(0.0, self.reach, self.n_interp)
        step = t[1] - t[0]
        size = 1 << (2 * self.n_interp - 1).bit_length()
        spectrum = np.fft.rfft(self.first.on_grid(t), size) * np.fft.rfft(self.second.on_grid(t), size)
        return step, np.fft.irfft(spectrum, size)[: self.n_interp] * step

    def column(self, t: Column) -> Column:
        step, v = self.table()
        pos = F.greatest(t, F.lit(0.0)) / step
        low = F.floor(pos).cast("int")
        values = F.lit([float(x) for x in v])
        at = F.get(values, low)
        after = F.get(values, low + 1)
        # The last point of the table has none after it.
        value = F.coalesce(at + (after - at) * (pos - low), at)
        beyond = F.raise_error(F.lit(f"a delay exceeds the composed kernel's reach of {self.reach}")).cast("double")
        return F.when(t > self.reach * (1 + 1e-9), beyond).otherwise(F.coalesce(value, F.lit(float(v[-1]))))

    def on_grid(self, t) -> np.ndarray:
        step, v = self.table()
        return np.interp(np.maximum(t, 0.0), np.arange(len(v)) * step, v, right=0.0)


# The names under which kernel families are known.
FAMILIES: dict[str, type[Kernel]] = {
    "DiracDelta": DiracDelta,
    "Exp": Exp,
    "ExpRateGT1": ExpRateGT1,
    "Gamma": Gamma,
    "ShiftedGamma": ShiftedGamma,
    "GammaShapeGT1": GammaShapeGT1,
    "ShiftedGammaShapeGT1": ShiftedGammaShapeGT1,
    "Normal": Normal,
    "SkewNormal": SkewNormal,
    "EMG": EMG,
    "BetaPrime": BetaPrime,
    "ShiftedBetaPrime": ShiftedBetaPrime,
    "HRFSingleGamma": HRFSingleGamma,
    "HRFDoubleGamma1": HRFDoubleGamma1,
    "HRFDoubleGamma2": HRFDoubleGamma2,
    "HRFDoubleGamma3": HRFDoubleGamma3,
    "HRFDoubleGamma4": HRFDoubleGamma4,
    "HRFDoubleGamma5": HRFDoubleGamma5,
    "HRF1": HRFDoubleGamma1,
    "HRF2": HRFDoubleGamma2,
    "HRF3": HRFDoubleGamma3,
    "HRF4": HRFDoubleGamma4,
    "HRF5": HRFDoubleGamma5,
    "HRF": HRFDoubleGamma5,
}


def check_causal(kernels: Sequence[Kernel], future: int) -> None:
    """Causal kernels say nothing about events still to come."""
    bad = sorted({type(k).__name__ for k in kernels if k.causal})
    if future and bad:
        raise ValueError(f"causal kernels cannot see future events: {', '.join(bad)}")
