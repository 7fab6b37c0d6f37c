"""Log-densities of response distributions, one row at a time, as column expressions.

``lognormalv2`` is taken as the log-normal parameterised by the mean and standard deviation of the
response itself; ``exgaussianinvrate`` as the ex-Gaussian with the mean of its exponential part
(inverse rate) in place of the rate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoframe.functions.special import erfc

LOG_2PI = math.log(2 * math.pi)


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))


def normal(y, mu, sigma) -> Column:
    y, mu, sigma = _c(y), _c(mu), _c(sigma)
    z = (y - mu) / sigma
    return F.lit(-0.5 * LOG_2PI) - F.log(sigma) - z * z * 0.5


def lognormal(y, mu, sigma) -> Column:
    y = _c(y)
    return normal(F.log(y), mu, sigma) - F.log(y)


def lognormalv2(y, mu, sigma) -> Column:
    mu, sigma = _c(mu), _c(sigma)
    var = F.log1p(sigma * sigma / (mu * mu))
    return lognormal(y, F.log(mu) - var * 0.5, F.sqrt(var))


def sinharcsinh(y, mu, sigma, skewness=0.0, tailweight=1.0) -> Column:
    """y = mu + sigma * sinh((asinh(Z) + skewness) * tailweight) * 2 / sinh(asinh(2) * tailweight)."""
    y, mu, sigma, skew, tail = map(_c, (y, mu, sigma, skewness, tailweight))
    scale = sigma * 2.0 / F.sinh(F.asinh(F.lit(2.0)) * tail)
    w = (y - mu) / scale
    inner = F.asinh(w) / tail - skew
    z = F.sinh(inner)
    log_jacobian = (
        F.log(F.cosh(inner)) - F.log(tail) - F.log(scale) - F.log1p(w * w) * 0.5
    )
    return F.lit(-0.5 * LOG_2PI) - z * z * 0.5 + log_jacobian


def johnsonsu(y, mu, sigma, skewness=0.0, tailweight=1.0) -> Column:
    """Z = skewness + tailweight * asinh((y - mu) / sigma)."""
    y, mu, sigma, skew, tail = map(_c, (y, mu, sigma, skewness, tailweight))
    w = (y - mu) / sigma
    z = skew + tail * F.asinh(w)
    return F.log(tail) - F.log(sigma) - F.log1p(w * w) * 0.5 - LOG_2PI / 2 - z * z * 0.5


def _log1pexp(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bernoulli(y, logit) -> Column:
    y, logit = _c(y), _c(logit)
    return y * logit - _log1pexp(logit)


def categorical(y: Column, logits: list) -> Column:
    """``y`` is the index of the category among ``logits``."""
    logits = [_c(v) for v in logits]
    top = F.greatest(*logits)
    total = None
    for v in logits:
        e = F.exp(v - top)
        total = e if total is None else total + e
    return F.get(F.array(*logits), y.cast("int")) - top - F.log(total)


def exponential(y, beta) -> Column:
    y, beta = _c(y), _c(beta)
    return F.log(beta) - beta * y


def exgaussian(y, mu, sigma, beta) -> Column:
    y, mu, sigma, beta = map(_c, (y, mu, sigma, beta))
    lead = beta * (mu - y) + beta * beta * sigma * sigma * 0.5
    z = (mu + beta * sigma * sigma - y) / (sigma * math.sqrt(2.0))
    return F.log(beta) - math.log(2.0) + lead + _log_erfc(z)


def _log_erfc(z: Column) -> Column:
    """Logarithm of erfc; an asymptotic series where erfc itself would underflow."""
    r = F.lit(1.0) / (z * z)
    series = F.lit(1.0) + r * (-0.5 + r * (0.75 + r * (-1.875 + r * 6.5625)))
    far = -z * z - F.log(z * math.sqrt(math.pi)) + F.log(series)
    return F.when(z > 20.0, far).otherwise(F.log(erfc(z)))


def exgaussianinvrate(y, mu, sigma, beta) -> Column:
    return exgaussian(y, mu, sigma, F.lit(1.0) / _c(beta))


# Distribution names, parameters and support.
DISTRIBUTIONS = {
    "normal": (normal, ("mu", "sigma"), "real"),
    "lognormal": (lognormal, ("mu", "sigma"), "real"),
    "lognormalv2": (lognormalv2, ("mu", "sigma"), "real"),
    "sinharcsinh": (sinharcsinh, ("mu", "sigma", "skewness", "tailweight"), "real"),
    "johnsonsu": (johnsonsu, ("mu", "sigma", "skewness", "tailweight"), "real"),
    "bernoulli": (bernoulli, ("logit",), "discrete"),
    "categorical": (categorical, ("logit",), "discrete"),
    "exponential": (exponential, ("beta",), "positive"),
    "exgaussian": (exgaussian, ("mu", "sigma", "beta"), "real"),
    "exgaussianinvrate": (exgaussianinvrate, ("mu", "sigma", "beta"), "real"),
}
