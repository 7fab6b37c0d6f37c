import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare as same_rows
from echoframe.functions import distributions as D
from echoframe.functions import kernels as K
from echoframe.operators.likelihood import fit_likelihood
from echoframe.operators import compare, irf, regress
from echoframe.operators.convolve import Conv, weighted_sum
from echoframe.operators.partition import ensemble_predictions, nested_models, softmax
from echoframe.operators.windows import WINDOW, window_arrays
from echoframe.plans.model import C, Model


@pytest.fixture(scope="module")
def xy(spark):
    rng = np.random.default_rng(3)
    n = 400
    g = rng.integers(0, 12, n)
    a, b = rng.normal(size=n), rng.normal(size=n)
    y = 1 + 2 * a - 0.5 * b + rng.normal(size=12)[g] * 2 + rng.normal(size=n)
    pdf = pd.DataFrame(dict(id=np.arange(n), g=g, a=a, b=b, y=y))
    return pdf, spark.createDataFrame(pdf).repartition(3).cache()


def test_ols_matches_numpy(xy):
    pdf, df = xy
    X = np.column_stack([np.ones(len(pdf)), pdf.a, pdf.b])
    want, rss = np.linalg.lstsq(X, pdf.y, rcond=None)[:2]
    fit = regress.ols(df, ["a", "b"], "y")
    assert np.allclose([fit.intercept, fit.coefs["a"], fit.coefs["b"]], want)
    cov = np.linalg.inv(X.T @ X) * rss / (len(pdf) - 3)
    assert np.allclose(fit.cov, cov)
    flat = regress.ols(df, ["a"], "y", intercept=False)
    assert flat.coefs["a"] == pytest.approx((pdf.a * pdf.y).sum() / (pdf.a**2).sum())
    w = df.withColumn("w", F.lit(2.0))
    assert regress.ols(w, ["a", "b"], "y", weight="w").coefs["a"] == pytest.approx(want[1])


def test_lasso_selects(xy):
    _, df = xy
    g = regress.gram(df, ["a", "b", "y"])
    fit = regress.solve(g, ["a", "b"], "y", l1={"b": 100.0})
    assert fit.coefs["b"] == 0.0 and fit.coefs["a"] > 1


def test_mixed_model(xy):
    """Against a dense maximum-likelihood profile over the variance ratio."""
    pdf, df = xy
    fit = regress.mixed(df, ["a", "b"], "y", "g", ["intercept"], iterations=60, tol=1e-12)
    X = np.column_stack([np.ones(len(pdf)), pdf.a, pdf.b])
    Z = np.equal.outer(pdf.g.to_numpy(), np.arange(12)).astype(float)
    y = pdf.y.to_numpy()

    def profile(ratio):
        V = np.eye(len(y)) + ratio * Z @ Z.T
        Vi = np.linalg.inv(V)
        beta = np.linalg.solve(X.T @ Vi @ X, X.T @ Vi @ y)
        r = y - X @ beta
        s2 = r @ Vi @ r / len(y)
        ll = -0.5 * (len(y) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(V)[1])
        return ll, beta, s2, ratio * s2 * Z.T @ Vi @ r / s2

    best = max((profile(r) for r in np.linspace(0.5, 12, 200)), key=lambda t: t[0])
    assert np.allclose([fit.intercept, fit.fixed["a"], fit.fixed["b"]], best[1], atol=0.02)
    assert fit.sigma**2 == pytest.approx(best[2], rel=0.02)
    assert all(y2 >= y1 - 1e-6 for y1, y2 in zip(fit.loglik_trace, fit.loglik_trace[1:]))
    eff = fit.effects.toPandas().set_index("g").ranef_intercept.sort_index()
    assert np.allclose(eff, best[3], atol=0.1)
    # An unseen level gets the population prediction.
    unseen = df.limit(1).withColumn("g", F.lit(99).cast("long"))
    row = fit.predict(unseen).first()
    assert row.pred == pytest.approx(fit.intercept + fit.fixed["a"] * row.a + fit.fixed["b"] * row.b)


def test_kernel_recovery(spark):
    rng = np.random.default_rng(4)
    X = spark.createDataFrame(pd.DataFrame(dict(s=rng.integers(0, 5, 400), time=rng.uniform(0, 100, 400),
                                                u=rng.normal(size=400), v=rng.normal(size=400))))
    Y = spark.createDataFrame(pd.DataFrame(dict(s=rng.integers(0, 5, 300), time=rng.uniform(0, 100, 300))))
    w = window_arrays(X, Y, ["s"], ["u", "v"], 20)
    w = w.withColumn("y", weighted_sum(WINDOW, "time", "u", K.Exp(0.4)) * 3.0
                     + weighted_sum(WINDOW, "time", "v", K.Gamma(2.0, 0.7)) * 2.0 + 1.0).cache()
    fit = regress.fit_kernels(w, [Conv("u", "u", K.Exp(0.8)), Conv("v", "v", K.Gamma(2.5, 1.0))], "y", tol=1e-9)
    assert fit.kernels["u"].beta == pytest.approx(0.4, rel=1e-3)
    assert fit.kernels["v"].alpha == pytest.approx(2.0, rel=1e-3)
    assert fit.kernels["v"].beta == pytest.approx(0.7, rel=1e-3)
    assert fit.fit.coefs == pytest.approx({"u": 3.0, "v": 2.0}, rel=1e-3)
    # Only the listed parameters move; tied terms share theirs.
    held = regress.fit_kernels(w, [Conv("v", "v", K.Gamma(2.5, 1.0))], "y", trainable={"v": ("beta",)}, iterations=3)
    assert held.kernels["v"].alpha == 2.5
    tied = regress.fit_kernels(w, [Conv("u", "u", K.Exp(0.8)), Conv("v", "v", K.Exp(0.8))], "y",
                               irf_ids={"u": "k", "v": "k"}, iterations=3)
    assert tied.kernels["u"] == tied.kernels["v"] and len(tied.params) == 1


def test_distributions_integrate_to_one(spark):
    y = F.col("y")
    grid = spark.range(400_001).select((F.col("id") * 0.002 - 300).alias("y"))
    dens = {
        "normal": D.normal(y, 3, 2), "johnsonsu": D.johnsonsu(y, 3, 2, 0.5, 1.3), "sinharcsinh": D.sinharcsinh(y, 3, 2, 0.3, 1.2),
        "exgaussian": D.exgaussian(y, 3, 2, 0.2),
    }
    total = grid.agg(*[(F.sum(F.exp(c)) * 0.002).alias(k) for k, c in dens.items()]).first()
    for k in dens:
        assert total[k] == pytest.approx(1.0, abs=1e-4), k
    pos = spark.range(1, 400_000).select((F.col("id") * 0.001).alias("y"))
    dens = {"lognormal": D.lognormal(y, 1, 0.7), "lognormalv2": D.lognormalv2(y, 4, 2), "exponential": D.exponential(y, 0.3)}
    total = pos.agg(*[(F.sum(F.exp(c)) * 0.001).alias(k) for k, c in dens.items()],
                    (F.sum(F.exp(D.lognormalv2(y, 4, 2)) * y) * 0.001).alias("mean")).first()
    for k in dens:
        assert total[k] == pytest.approx(1.0, abs=1e-3), k
    assert total["mean"] == pytest.approx(4.0, abs=1e-2)


def test_permutation(spark):
    rng = np.random.default_rng(5)
    n = 200
    d = pd.DataFrame(dict(id=np.arange(n), a=rng.exponential(size=n), b=rng.exponential(size=n), c=rng.exponential(size=n) + 0.5))
    df = spark.createDataFrame(d).repartition(3)
    null = compare.permutation_test(df, "a", "b", "id", 2000)
    far = compare.permutation_test(df, "a", "c", "id", 2000)
    assert null.diff == pytest.approx(d.a.mean() - d.b.mean()) and 0.02 < null.p < 1
    assert far.p < 0.01
    # The draw depends on ids and seed, not on how rows are spread.
    again = compare.permutation_test(df.repartition(7), "a", "b", "id", 2000)
    assert again.p == null.p
    assert compare.permutation_test(df, "a", "b", "id", 2000, seed=9).p == pytest.approx(null.p, abs=0.05)
    # Spread of the null distribution: sum of squared differences / n^2.
    sd = null.diffs.agg(F.stddev_pop("diff")).first()[0]
    assert sd == pytest.approx(math.sqrt(((d.a - d.b) ** 2).sum()) / n, rel=0.06)
    one = compare.permutation_test(df, "a", "c", "id", 500, n_tails=1)
    assert one.p <= 0.01
    assert compare.permutation_test(df, "a", "a", "id", 10).p == 1.0
    assert compare.permutation_test(df, "a", "c", "id", 10, mode="mse", nested=True).p == 1.0
    many = compare.permutation_test(df, ["a", "b"], ["c", "c"], "id", 200, agg="median", mode="loglik")
    assert many.p < 0.02 and many.diffs.count() == 200
    with pytest.raises(ValueError):
        compare.permutation_test(df, "a", "b", "id", mode="loss")


@pytest.mark.parametrize("layout", [dict(layout="series"), dict(layout="blocks", blocks=3)], ids=["series", "blocks"])
def test_adjusted_p(spark, layout):
    p = [0.01, 0.04, 0.03, 0.5]
    df = spark.createDataFrame([("f", i, v) for i, v in enumerate(p)] + [("g", 0, 0.2)], "fam string, i int, p double")
    got = {(r.fam, r.i): r.p_adjusted for r in compare.adjust_p(df, by=["fam"], **layout).collect()}
    c = 1 + 1 / 2 + 1 / 3 + 1 / 4
    assert got[("f", 0)] == pytest.approx(0.01 * 4 * c)
    assert got[("f", 1)] == got[("f", 2)] == pytest.approx(0.04 * 4 * c / 3)
    assert got[("f", 3)] == pytest.approx(min(1.0, 0.5 * c)) and got[("g", 0)] == pytest.approx(0.2)


@pytest.mark.parametrize("layout", [dict(layout="series"), dict(layout="blocks", blocks=3)], ids=["series", "blocks"])
def test_quantile_table(spark, layout):
    from echoframe.functions.special import normal_quantile

    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 2, 2, 5]], "e double")
    rows = compare.quantile_table(df, "e", 0.0, 1.0, **layout).orderBy("rank").collect()
    assert [r.empirical for r in rows] == [1, 2, 2, 2, 2, 3, 5]
    assert [r.theoretical for r in rows] == pytest.approx([normal_quantile((i + 0.5) / 7) for i in range(7)], abs=1e-12)


def test_pca_and_correlations(xy):
    pdf, df = xy
    p = compare.pca(df, ["a", "b", "y"])
    z = (pdf[["a", "b", "y"]] - pdf[["a", "b", "y"]].mean()) / pdf[["a", "b", "y"]].std(ddof=0)
    assert np.allclose(sorted(np.linalg.eigvalsh(np.cov(z, rowvar=False)), reverse=True), p.values)
    out = p.project(df).toPandas()
    assert np.allclose(np.cov(out[["pc1", "pc2", "pc3"]], rowvar=False), np.diag(p.values), atol=1e-9)
    r = {(x.a, x.b): x.r for x in compare.correlations(df, ["a"], ["b", "y"]).collect()}
    assert r[("a", "y")] == pytest.approx(np.corrcoef(pdf.a, pdf.y)[0, 1])


def test_steiger_nested(xy):
    _, df = xy
    row = compare.correlation_test(df, "y", "a", "b").first()
    assert row.p < 0.01 and row.z > 0
    assert compare.correlation_test(df, "y", "a", "b", nested=True).first().p == 1.0


def test_bootstrap_bounds(xy):
    _, df = xy
    s = regress.bootstrap(df, ["a", "b"], "y", "id", 60)
    rows = {r.parameter: r for r in regress.credible(s, ["parameter"], "estimate").collect()}
    assert rows["a"].lower < 2.0 < rows["a"].upper and rows["b"].upper < 0
    trees = {"gap": ("a", "b"), "plain": "a"}
    c = {r.contrast: r for r in irf.contrasts(s, trees, name="parameter", sample="replicate").collect()}
    assert c["gap"].mean == pytest.approx(rows["a"].mean - rows["b"].mean)


def test_softmax_and_ensembles(spark):
    df = spark.createDataFrame([("m1", 0.0), ("m2", math.log(3.0))], "model string, a double")
    w = softmax(df, "a")
    assert {r.model: round(r.weight, 9) for r in w.collect()} == {"m1": 0.25, "m2": 0.75}
    preds = spark.createDataFrame([(1, "m1", 4.0), (1, "m2", 8.0)], "id int, model string, p double")
    assert ensemble_predictions(preds, "id", "model", "p").first().pred == 6.0
    assert ensemble_predictions(preds, "id", "model", "p", w).first().pred == pytest.approx(7.0)


def test_nested_models(spark):
    df = spark.createDataFrame([("m",), ("m!a",), ("m!b",), ("m!a!b",), ("n!a",)], "model string")
    got = {(r.smaller, r.larger) for r in nested_models(df).collect()}
    assert got == {("m!a", "m"), ("m!b", "m"), ("m!a!b", "m!a"), ("m!a!b", "m!b")}


def test_dirac_model_is_plain_regression(spark, xy):
    """A bare predictor of the response table is an ordinary covariate."""
    pdf, df = xy
    X = spark.createDataFrame([(0, 0.0, 1.0)], "g long, time double, v double")
    Y = df.withColumn("time", F.col("id").cast("double"))
    model = Model(["y"], [C("a"), C("b")], ["g"], history=4)
    fit = model.fit(X, Y)
    assert fit.fits["y"].coefs["a"] == pytest.approx(regress.ols(df, ["a", "b"], "y").coefs["a"])
    names = fit.ablated("y", ["a"])
    assert set(names) == {"model", "model!a"} and names["model!a"].r2 < names["model"].r2
    pred = fit.predict(fit.features(X, Y))
    assert pred.select(F.sum("loglik")).first()[0] == pytest.approx(fit.fits["y"].loglik, rel=1e-6)


def test_lcg_amplitudes_are_linear(spark):
    rng = np.random.default_rng(6)
    X = spark.createDataFrame(pd.DataFrame(dict(s=0, time=rng.uniform(0, 200, 300), v=rng.normal(size=300))))
    Y = spark.createDataFrame(pd.DataFrame(dict(s=0, time=rng.uniform(0, 200, 200))))
    shape = K.LCG((0.0, 3.0, 6.0), (2.0,) * 3, (0.5, 1.0, -0.3), support_lb=None)
    w = window_arrays(X, Y, ["s"], ["v"], 40)
    total = sum((weighted_sum(WINDOW, "time", "v", b) * a for a, b in zip(shape.amplitudes, shape.basis())), F.lit(0.0))
    Y2 = w.withColumn("y", total).drop(WINDOW)
    fit = Model(["y"], [C("v", shape)], ["s"], history=40).fit(X, Y2)
    assert list(fit.fits["y"].coefs.values()) == pytest.approx([0.5, 1.0, -0.3], abs=1e-6)


def test_logistic_and_f1(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=2000)
    y = (rng.uniform(size=2000) < 1 / (1 + np.exp(-(0.5 + x)))).astype(int)
    df = spark.createDataFrame(pd.DataFrame(dict(x=x, y=y)))
    fit = regress.fit_family(df, ["x"], "y", "bernoulli")
    assert fit.coefs[0]["x"] == pytest.approx(1.0, abs=0.2)
    out = fit.predict(df).withColumn("hat", F.when(F.col("pred") > 0.5, 1).otherwise(0))
    row = compare.f1(out, "y", "hat").first()
    hat = np.array([r.hat for r in out.select("hat").collect()])
    assert row.n == 2000 and 0.6 < row.f1_macro < 0.9 and row.accuracy == pytest.approx((hat == y).mean(), abs=0.05)


def test_crossed_factors_and_model_terms(spark):
    rng = np.random.default_rng(8)
    n = 600
    g, h = rng.integers(0, 10, n), rng.integers(0, 15, n)
    a = rng.normal(size=n)
    eg, eh, sl = rng.normal(size=10) * 2, rng.normal(size=15), rng.normal(size=10)
    y = 1 + (2 + sl[g]) * a + eg[g] + eh[h] + rng.normal(size=n) * 0.5
    Y = spark.createDataFrame(pd.DataFrame(dict(id=np.arange(n), s=0, time=np.arange(n) * 1.0, g=g, h=h, a=a, y=y)))
    X = spark.createDataFrame([(0, 0.0, 1.0)], "s long, time double, v double")
    model = Model(["y"], [C("a", ran="g")], ["s"], history=2, random_intercepts=["g", "h"])
    fit = model.fit_mixed(X, Y, iterations=15)
    assert set(fit.fits) == {"g", "h"} and fit.fits["g"].random == ["intercept", "a"]
    e = fit.fits["g"].effects.toPandas().set_index("g").sort_index()
    assert np.corrcoef(e.ranef_intercept, eg)[0, 1] > 0.98 and np.corrcoef(e.ranef_a, sl)[0, 1] > 0.95
    f = fit.fits["h"].effects.toPandas().set_index("h").sort_index()
    assert np.corrcoef(f.ranef_intercept, eh)[0, 1] > 0.95
    out = fit.predict(Y).select(F.avg(F.pow(F.col("y") - F.col("pred"), 2.0))).first()[0]
    assert out < 0.35


def test_manipulation_settings(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(101)], "x double, d double")
    steps, refs, ranges = irf.manipulation_settings(df, ["x", "d"], "mean", indicators=["d"])
    assert refs == {"x": 50.0, "d": 0.0} and steps["d"] == 1.0 and steps["x"] == pytest.approx(29.3, abs=0.1)
    assert ranges["x"] == pytest.approx((5.0, 95.0), abs=1.0)


@pytest.mark.parametrize("family,shape", [("johnsonsu", {"sigma": 2.0, "skewness": -0.5, "tailweight": 1.5}), ("exgaussian", {"sigma": 0.5, "beta": 0.5}),
                                          ("exgaussianinvrate", {"sigma": 0.5, "beta": 2.0}), ("sinharcsinh", {"sigma": 1.0, "skewness": 0.3, "tailweight": 1.3})])
def test_families_are_recovered(spark, family, shape):
    rng = np.random.default_rng(4)
    n = 6000
    x, z = rng.normal(size=n), rng.normal(size=n)
    if family == "johnsonsu":
        noise = shape["sigma"] * np.sinh((z - shape["skewness"]) / shape["tailweight"])
    elif family == "sinharcsinh":
        scale = shape["sigma"] * 2 / np.sinh(np.arcsinh(2.0) * shape["tailweight"])
        noise = scale * np.sinh((np.arcsinh(z) + shape["skewness"]) * shape["tailweight"])
    else:
        noise = shape["sigma"] * z + rng.exponential(2.0, n)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, 1.0 + 0.7 * x + noise)], "x double, y double")
    fit = fit_likelihood(df, ["x"], "y", family)
    assert fit.converged and fit.coefs["x"] == pytest.approx(0.7, abs=0.1) and fit.intercept == pytest.approx(1.0, abs=0.3)
    for k, v in shape.items():
        assert fit.shape[k] == pytest.approx(v, rel=0.2, abs=0.1), k
    assert fit.score(df).agg({"loglik": "sum"}).first()[0] == pytest.approx(fit.loglik, rel=1e-6)


def test_wide_and_narrow_sums_agree(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(300, 3)) + [1e6, 0, 5]]
    df = spark.createDataFrame([*rows, (1.0, None, 2.0)], "a double, b double, y double")
    narrow = regress.ols(df, ["a", "b"], "y", l2=0.5)
    monkeypatch.setattr(regress, "WIDE", 1)
    wide = regress.ols(df, ["a", "b"], "y", l2=0.5)
    assert wide.n == narrow.n == 300 and wide.coefs == pytest.approx(narrow.coefs) and wide.sigma == pytest.approx(narrow.sigma)
    assert np.allclose(wide.cov, narrow.cov)


def test_converged_mixed_model(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=40)
    df = spark.createDataFrame([(g, float(2 + u[g] + rng.normal())) for g in range(40) for _ in range(10)], "g int, y double")
    fit = regress.mixed(df, [], "y", "g")
    y = df.toPandas()
    within = float(((y.y - y.groupby("g").y.transform("mean")) ** 2).sum()) / (40 * 9)
    between = 10 * float(((y.groupby("g").y.mean() - y.y.mean()) ** 2).sum()) / 40
    assert fit.converged and fit.sigma**2 == pytest.approx(within, rel=1e-3)
    assert fit.variance[0, 0] == pytest.approx((between - within) / 10, rel=1e-2)


def test_folds_are_not_copied(spark):
    df = spark.createDataFrame([(float(i % 7), float(i % 5), i % 3) for i in range(90)], "x double, y double, f int")
    out, fits = regress.crossval(df, ["x"], "y", "f")
    for fold, fit in fits.items():
        rest = regress.ols(df.where(f"f <> {fold}"), ["x"], "y")
        assert fit.coefs == pytest.approx(rest.coefs) and fit.n == rest.n == 60
    assert out.count() == 90
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_no_response_is_lost(spark):
    """Impossible responses are an error; a steep mean is fitted to all rows, not to those it suits."""
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 1, 2000)
    mean, sd = 6.0 - 5.9 * x, 0.2
    var = np.log1p(sd**2 / mean**2)
    y = np.exp(np.log(mean) - var / 2 + np.sqrt(var) * rng.normal(size=2000))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    fit = fit_likelihood(df, ["x"], "y", "lognormalv2")
    assert fit.n == 2000 and fit.converged and fit.intercept + fit.coefs["x"] > 0
    assert fit.intercept == pytest.approx(6.0, abs=0.05) and fit.coefs["x"] == pytest.approx(-5.9, abs=0.05)
    bad = df.unionByName(spark.createDataFrame([(0.5, -1.0)] * 200, "x double, y double"))
    for family in ("lognormal", "lognormalv2", "exponential"):
        if family != "exponential":
            with pytest.raises(ValueError, match="200 of 2200"):
                fit_likelihood(bad, ["x"], "y", family)


@pytest.fixture(scope="module", params=["zeros", "zero_view", "negative", "positive"])
def priced(request, tmp_path_factory):
    """A folder of events, some of whose values a log-normal family does not allow."""
    folder = str(tmp_path_factory.mktemp(request.param))
    odd = {"zeros": "i % 97 = 5, 0.0", "zero_view": "i = 12, 0.0", "negative": "i = 6, -1.0", "positive": "false, 0.0"}[request.param]
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 977) AS ts, i * 7919 % 23 AS user_id,
      ['click', 'view', 'purchase', 'error'][1 + i * 104729 % 11 % 4] AS event_type,
      if({odd}, 1.0 + i * 1299709 % 1009 / 10)::DOUBLE AS value, '{{"k": 1}}' AS props FROM range(1500) t(i)) TO '{folder}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return request.param, folder, con


def test_model_of_responses_its_family_does_not_allow(spark, priced):
    """A purchase of value 0 leaves the log-normal model undefined: every row comes back, without a prediction, as in the SQL."""
    kind, folder, con = priced
    rows, same, note = same_rows(spark, con, "model_family", folder)
    told = con.execute(f"SELECT count(*), count(pred), count(loglik) FROM ({entry.oracle_sql()['model_family']})").fetchone()
    assert same and rows == told[0] > 100, note
    assert told[1:] == ((0, 0) if kind in ("zeros", "negative") else told[:1] * 2)


def test_groups_of_responses_their_family_does_not_allow(spark, priced):
    """Values of 0 leave no log-normal fit; its row is that of the SQL, and the other family's is fitted as ever."""
    kind, folder, con = priced
    rows, same, note = same_rows(spark, con, "scale_models", folder)
    assert same and rows == 2, note
    told = con.execute(f"SELECT * FROM ({entry.oracle_sql()['scale_models']}) ORDER BY family").fetchall()
    assert np.isfinite(told[1][1:5]).all() and np.isfinite(told[0][1:5]).all() == (kind == "positive")


def test_undefined_fits(spark):
    df = spark.createDataFrame([(float(i % 5), float(i)) for i in range(50)], "x double, y double")
    for family in ("lognormal", "lognormalv2"):
        with pytest.raises(ValueError, match="1 of 50"):
            fit_likelihood(df, ["x"], "y", family)
        fit = fit_likelihood(df, ["x"], "y", family, by={"sigma": ["x"]}, impossible="undefined")
        assert (fit.n, fit.impossible, fit.loglik) == (50, 1, -np.inf) and np.isnan(fit.gradient).all() and len(fit.gradient) == 4
        assert np.isnan([fit.intercept, fit.coefs["x"], fit.by["sigma"][0], fit.by["sigma"][1]["x"]]).all() and not fit.shape
        assert fit.predict(fit.score(df)).agg({"pred": "count", "loglik": "count", "*": "count"}).first().asDict() == {
            "count(pred)": 0, "count(loglik)": 0, "count(1)": 50}
    above = df.where("y > 0")
    fits = [fit_likelihood(above, ["x"], "y", "lognormal", impossible=i) for i in ("error", "undefined")]
    assert fits[0].coefs == fits[1].coefs and fits[1].impossible == 0 and fits[1].shape == fits[0].shape
    with pytest.raises(ValueError, match="'drop'"):
        fit_likelihood(df, ["x"], "y", "normal", impossible="drop")


@pytest.mark.parametrize("family", ["normal", "johnsonsu", "sinharcsinh", "exgaussian", "exgaussianinvrate", "lognormal"])
def test_every_parameter_by_features(spark, family):
    """All parameters depend on a feature: the score equations hold, and planted dependences come back."""
    rng = np.random.default_rng(6)
    n = 8000
    x, z = rng.normal(size=n), rng.normal(size=n)
    sigma = np.exp(0.2 + 0.3 * x)
    y = {"johnsonsu": lambda: 1 + x + sigma * np.sinh((z - 0.4) / np.exp(0.3)),
         "sinharcsinh": lambda: 1 + x + sigma * 2 / np.sinh(np.arcsinh(2.0) * 1.2) * np.sinh((np.arcsinh(z) + 0.3) * 1.2),
         "exgaussian": lambda: 1 + x + sigma * z + rng.exponential(np.exp(0.5), n), "exgaussianinvrate": lambda: 1 + x + sigma * z + rng.exponential(np.exp(0.5), n),
         "lognormal": lambda: np.exp(1 + x + sigma * z), "normal": lambda: 1 + x + sigma * z}[family]()
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    names = D.DISTRIBUTIONS[family][1]
    fit = fit_likelihood(df, ["x"], "y", family, by={p: ["x"] for p in names[1:]})
    assert fit.converged and fit.n == n and np.abs(fit.gradient).max() < 0.01 and not fit.shape
    assert fit.coefs["x"] == pytest.approx(1.0, abs=0.2) and fit.by["sigma"][1]["x"] == pytest.approx(0.3, abs=0.12)
    assert fit.score(df).agg({"loglik": "sum"}).first()[0] == pytest.approx(fit.loglik, rel=1e-6)


def test_fits_after_error_functions_were_used_here(spark):
    """What the driver did with error functions before must not keep a fit's functions from the workers."""
    K.SkewNormal(0.5, 1.0, 2.0).on_grid(np.linspace(0, 1, 5))
    K.EMG(0.5, 1.0, 2.0).on_grid(np.linspace(0, 1, 5))
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in rng.normal(size=800) + rng.exponential(1.0, 800)], "y double")
    assert fit_likelihood(df, [], "y", "exgaussian").converged and fit_likelihood(df, [], "y", "normal").n == 800


def test_families_without_a_location(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=5000)
    rows = [(float(a), float(rng.exponential(np.exp(0.5 - 0.4 * a))), float(rng.uniform() < 1 / (1 + np.exp(-0.3 - a)))) for a in x]
    df = spark.createDataFrame(rows, "x double, y double, b double")
    fit = fit_likelihood(df, ["x"], "y", "exponential")
    assert fit.converged and fit.intercept == pytest.approx(-0.5, abs=0.06) and fit.coefs["x"] == pytest.approx(0.4, abs=0.06)
    fit = fit_likelihood(df, ["x"], "b", "bernoulli")
    assert fit.converged and fit.intercept == pytest.approx(0.3, abs=0.12) and fit.coefs["x"] == pytest.approx(1.0, abs=0.12)
