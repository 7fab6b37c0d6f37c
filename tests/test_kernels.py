import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.functions import kernels as K
from echoframe.functions.special import beta_cdf, chi2_sf, erfc, gamma_cdf, normal_quantile

ALL = [
    K.Exp(0.5), K.ExpRateGT1(1.5), K.Gamma(2.0, 0.5), K.GammaShapeGT1(1.5, 0.5), K.HRFSingleGamma(),
    K.ShiftedGamma(2.0, 0.5, -1.0), K.ShiftedGammaShapeGT1(1.5, 0.5, -1.0), K.Normal(2.0, 1.0),
    K.SkewNormal(2.0, 1.0, 3.0), K.EMG(2.0, 1.0, 0.7), K.BetaPrime(2.0, 4.0), K.ShiftedBetaPrime(2.0, 4.0, -0.5),
    K.HRFDoubleGamma1(0.5), K.HRFDoubleGamma2(), K.HRFDoubleGamma3(), K.HRFDoubleGamma4(), K.HRFDoubleGamma5(),
    K.LCG.spaced(5, 10.0),
]


@pytest.mark.parametrize("kernel", ALL, ids=lambda k: type(k).__name__)
def test_integral_is_one(kernel):
    t = np.linspace(0, 400, 400_001)
    assert np.trapezoid(kernel.on_grid(t), t) == pytest.approx(1.0, abs=2e-3)


@pytest.mark.parametrize("kernel", [k for k in ALL if not isinstance(k, K.ExpRateGT1)], ids=lambda k: type(k).__name__)
def test_integral_on_bounded_support(kernel):
    from dataclasses import replace

    bounded = replace(kernel, support_ub=5.0)
    t = np.linspace(0, 5, 200_001)
    assert np.trapezoid(bounded.on_grid(t), t) == pytest.approx(1.0, abs=2e-3)


def test_columns_equal_grids(spark):
    t = np.linspace(0, 30, 61)
    df = spark.createDataFrame([(float(x),) for x in t], "t double").coalesce(1)
    kernels = [*ALL, K.Composed(first=K.Exp(1.0), second=K.Normal(3.0, 1.0), reach=40.0), K.DiracDelta()]
    rows = df.select("t", *[k.column(F.col("t")).alias(f"k{i}") for i, k in enumerate(kernels)]).orderBy("t").collect()
    for i, k in enumerate(kernels):
        assert np.allclose([r[f"k{i}"] for r in rows], k.on_grid(t), rtol=1e-9, atol=1e-12), type(k).__name__


def test_erfc_column(spark):
    xs = [-6.0, -4.0, -1.3, -0.5, -0.1, 0.0, 0.2, 0.5, 0.7, 2.0, 4.0, 4.5, 10.0, 26.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", erfc(F.col("x")).alias("y")).collect():
        assert r.y == pytest.approx(math.erfc(r.x), rel=1e-13)


def test_driver_functions():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert normal_quantile(0.975) == pytest.approx(1.959963984540054)
    assert beta_cdf(0.3, 2, 3) == pytest.approx(0.3483)
    assert gamma_cdf(2.0, 3.0, 1.0) == pytest.approx(0.3233235838169366)


def test_parameter_bounds():
    for bad in (lambda: K.Exp(0.0), lambda: K.ExpRateGT1(0.5), lambda: K.GammaShapeGT1(0.5, 1.0),
                lambda: K.ShiftedGamma(2.0, 1.0, 0.5), lambda: K.Normal(0.0, -1.0)):
        with pytest.raises(ValueError):
            bad()


def test_lcg_basis_spans_the_kernel():
    k = K.LCG((0.0, 2.0), (1.0, 1.5), (0.3, 0.7), support_lb=None)
    t = np.linspace(0, 5, 11)
    mixed = sum(v * b.on_grid(t) for v, b in zip(k.amplitudes, k.basis()))
    assert np.allclose(mixed / 1.0, k.on_grid(t), rtol=1e-5)


def test_composition_of_exponentials():
    k = K.Composed(first=K.Exp(0.5), second=K.Exp(2.0), reach=20.0, n_interp=20_001)
    t = np.linspace(0.5, 10, 20)
    exact = (np.exp(-0.5 * t) - np.exp(-2.0 * t)) / 1.5
    assert np.allclose(k.on_grid(t), exact, rtol=5e-3)


@pytest.mark.parametrize("kernel", [K.EMG(0.0, 50.0, 1.0), K.EMG(40.0, 2.0, 20.0), K.EMG(6.0, 4.0, 0.1)])
def test_steep_emg(spark, kernel):
    t = np.linspace(0, 400, 200_001)
    assert np.trapezoid(kernel.on_grid(t), t) == pytest.approx(1.0, abs=1e-3)
    some = [0.0, 0.1, 10.0, 40.0, 50.0, 300.0]
    df = spark.createDataFrame([(x,) for x in some], "t double").select(kernel.column(F.col("t")).alias("k"), "t").orderBy("t")
    assert np.allclose([r.k for r in df.collect()], kernel.on_grid(np.array(some)), rtol=1e-9, atol=1e-15)


def test_reach_is_required(spark):
    with pytest.raises(ValueError):
        K.Composed(first=K.Exp(1.0), second=K.Exp(2.0))
    df = spark.createDataFrame([(9.0,), (11.0,)], "t double")
    k = K.Composed(first=K.Exp(1.0), second=K.Exp(2.0), reach=10.0)
    assert df.where("t < 10").select(k.column(F.col("t"))).first()[0] > 0
    with pytest.raises(Exception, match="reach"):
        df.select(k.column(F.col("t"))).collect()


def test_far_tail():
    assert chi2_sf(75.0, 2) == pytest.approx(5.175555005801869e-17) and chi2_sf(70.0, 2) == pytest.approx(6.305116760146985e-16)


def test_derivatives(spark):
    """Closed forms against differences of the whole kernel, on grids and on columns, with and without bounds of the support."""
    from echoframe.functions.special import ArrayMath, ColumnMath, digamma

    assert digamma(1.0) == pytest.approx(-0.5772156649015329, abs=1e-13) and digamma(0.25) == pytest.approx(-4.227453533376265, abs=1e-12)
    t = np.array([0.05, 0.4, 1.0, 2.5, 7.0])
    grid = spark.createDataFrame([(float(x),) for x in t], "t double").coalesce(1)
    cases = [K.Exp(0.7), K.Exp(0.7, support_ub=5.0), K.Gamma(2.3, 0.8), K.Gamma(1.4, 0.8, support_ub=6.0), K.ShiftedGamma(2.2, 0.9, -0.7), K.Normal(1.0, 0.8),
             K.Normal(1.0, 0.8, support_lb=None), K.SkewNormal(0.8, 1.1, 1.7), K.EMG(0.9, 0.6, 1.3), K.BetaPrime(2.5, 3.1), K.ShiftedBetaPrime(2.5, 3.1, -0.4),
             K.HRFDoubleGamma1(1.2), K.HRFDoubleGamma2(5.5, 1.2), K.HRFDoubleGamma3(5.5, 1.2, 0.2), K.HRFDoubleGamma4(5.5, 14.0, 1.2, 0.2),
             K.HRFDoubleGamma5(5.5, 14.0, 1.2, 0.9, 0.2), K.HRFSingleGamma(5.0, 1.1), K.LCG((0.0, 1.0), (0.5, 0.5), (0.3, 0.6)), K.GammaShapeGT1(1.5, 1.0, support_ub=4.0)]
    for k in cases:
        for p, v in k.params.items():
            h = 1e-5
            want = (k.with_params(**{p: v + h}).on_grid(t) - k.with_params(**{p: v - h}).on_grid(t)) / (2 * h)
            assert k.derivative(t, ArrayMath, p) == pytest.approx(want, rel=2e-6, abs=2e-8), (k, p)
            got = [r[0] for r in grid.select(k.derivative(F.col("t"), ColumnMath, p)).collect()]
            assert got == pytest.approx(want, rel=2e-6, abs=2e-8), (k, p)
