"""Special functions: ``erfc`` as a Spark column, incomplete gamma and beta on the driver.

The column form keeps error-function kernels and densities inside generated code; the driver forms
are only ever called on a handful of parameters (normalisers, test statistics).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# W. J. Cody's rational Chebyshev approximations for the error function (1969).
# Numerator and denominator coefficients, highest power first, for |x| <= 0.5, for
# 0.5 < |x| <= 4 and (in 1/x^2) for |x| > 4.
ERF_P = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2,
         3.77485237685302021e2, 3.20937758913846947e3)
ERF_Q = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3,
         2.84423683343917062e3)
ERFC_P = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0,
          6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2,
          1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
ERFC_Q = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2,
          1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3,
          3.43936767414372164e3, 1.23033935480374942e3)
TAIL_P = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1,
          1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
TAIL_Q = (1.0, 2.56852019228982242e0, 1.87295284992346725e0, 5.27905102951428412e-1,
          6.05183413124413191e-2, 2.33520497626869185e-3)


def _horner(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def erfc(x: Column) -> Column:
    """Complementary error function of a column, to double precision."""
    a = F.abs(x)
    sq = x * x
    inner = F.lit(1.0) - x * _horner(ERF_P, sq) / _horner(ERF_Q, sq)
    middle = F.exp(-sq) * _horner(ERFC_P, a) / _horner(ERFC_Q, a)
    inv = F.lit(1.0) / sq
    far = F.exp(-sq) / a * (
        F.lit(1.0 / math.sqrt(math.pi)) - inv * _horner(TAIL_P, inv) / _horner(TAIL_Q, inv)
    )
    upper = F.when(a <= 4.0, middle).otherwise(far)
    return F.when(a <= 0.5, inner).when(x > 0, upper).otherwise(F.lit(2.0) - upper)


def erfcx(x: Column) -> Column:
    """``exp(x^2) erfc(x)`` of a non-negative column, where ``erfc`` itself may vanish."""
    sq = x * x
    inner = F.exp(sq) * (F.lit(1.0) - x * _horner(ERF_P, sq) / _horner(ERF_Q, sq))
    middle = _horner(ERFC_P, x) / _horner(ERFC_Q, x)
    inv = F.lit(1.0) / sq
    far = (F.lit(1.0 / math.sqrt(math.pi)) - inv * _horner(TAIL_P, inv) / _horner(TAIL_Q, inv)) / x
    return F.when(x <= 0.5, inner).when(x <= 4.0, middle).otherwise(far)


def erfcx_scalar(x: float) -> float:
    """The same of a number; beyond 20 by its asymptotic series."""
    if x < 20.0:
        return math.exp(x * x) * math.erfc(x)
    total, term = 1.0, 1.0
    for k in range(1, 8):
        term *= -(2 * k - 1) / (2 * x * x)
        total += term
    return total / (x * math.sqrt(math.pi))


def normal_cdf_scalar(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2.0))


def normal_quantile(p: float) -> float:
    """Inverse normal distribution function by bisection on ``erfc``."""
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if normal_cdf_scalar(mid) < p else (lo, mid)
    return 0.5 * (lo + hi)


def digamma(x: float) -> float:
    """Derivative of the logarithm of the gamma function, for positive x."""
    total = 0.0
    while x < 10.0:
        total -= 1.0 / x
        x += 1.0
    y = 1.0 / (x * x)
    # Bernoulli numbers over twice their index.
    series = y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760)))))
    return total + math.log(x) - 0.5 / x - series


def gamma_cdf(x: float, shape: float, rate: float) -> float:
    """Regularised lower incomplete gamma function at ``rate * x``."""
    z = rate * x
    if z <= 0:
        return 0.0
    scale = math.exp(shape * math.log(z) - z - math.lgamma(shape))
    if z < shape + 1:
        term = total = 1.0 / shape
        k = shape
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= z / k
            total += term
        return scale * total
    return 1.0 - scale * _gamma_fraction(z, shape)


def gamma_sf(x: float, shape: float, rate: float) -> float:
    """Regularised upper incomplete gamma function, without cancellation in the tail."""
    z = rate * x
    if z < shape + 1:
        return 1.0 - gamma_cdf(x, shape, rate)
    return math.exp(shape * math.log(z) - z - math.lgamma(shape)) * _gamma_fraction(z, shape)


def _gamma_fraction(z: float, shape: float) -> float:
    return _lentz(lambda i: z + 1 - shape + 2 * i, lambda i: -i * (i - shape))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_cdf(1 - x, b, a)

    def numerator(i: int) -> float:
        m = i // 2
        if i % 2 == 0:
            return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))

    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    return front / a * _lentz(lambda i: 1.0, numerator)


def _lentz(b, a, tol: float = 1e-16, limit: int = 10_000) -> float:
    """The continued fraction 1 / (b0 + a1 / (b1 + a2 / (b2 + ...)))."""
    tiny = 1e-300
    f = b(0) or tiny
    c, d = f, 0.0
    for i in range(1, limit):
        d = 1.0 / (b(i) + a(i) * d or tiny)
        c = b(i) + a(i) / c or tiny
        f *= c * d
        if abs(c * d - 1.0) < tol:
            break
    return 1.0 / f


def chi2_sf(x: float, df: float) -> float:
    return gamma_sf(x, df / 2.0, 0.5)


class ColumnMath:
    """The functions a kernel may use, on Spark columns."""

    exp, log, sqrt, abs = F.exp, F.log, F.sqrt, F.abs
    erfc, erfcx = staticmethod(erfc), staticmethod(erfcx)

    @staticmethod
    def pick(cond: Column, yes: Column, no: Column) -> Column:
        return F.when(cond, yes).otherwise(no)

    @staticmethod
    def floor_at(x: Column, low: float) -> Column:
        return F.greatest(x, F.lit(low))


class ArrayMath:
    """The same functions on driver-side numpy grids (normalisers, curve composition)."""

    exp, log, sqrt, abs = np.exp, np.log, np.sqrt, np.abs
    erfc = staticmethod(np.vectorize(math.erfc, otypes=[float]))
    erfcx = staticmethod(np.vectorize(erfcx_scalar, otypes=[float]))

    @staticmethod
    def pick(cond, yes, no):
        return np.where(cond, yes, no)

    @staticmethod
    def floor_at(x, low: float):
        return np.maximum(x, low)
