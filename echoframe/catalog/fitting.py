"""Fits, predictions, response distributions, curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from echoframe.catalog.base import EV, events, inputs, orders_series, pairs_sql, query, rounded, table
from echoframe.functions import distributions as D
from echoframe.functions import kernels as K
from echoframe.functions.transforms import dummies, level_moments, moments
from echoframe.operators import irf, regress
from echoframe.operators.compare import metrics
from echoframe.operators.convolve import Conv, Source, convolve, weighted_sum
from echoframe.operators.likelihood import fit_likelihood
from echoframe.operators.partition import modular_partition
from echoframe.operators.windows import WINDOW, window_arrays
from echoframe.plans.model import C, Model, baseline_merge, two_step
from echoframe.session import fresh_folder
from echoframe.sources.tables import read_rows, write_results

EXP, GAM = K.Exp(0.05), K.Gamma(2.0, 0.1)
_D = "(greatest(d, 0) + 4 * 1.1920928955078125e-07)"
_GAM = f"exp(2.0 * ln(0.1) + ln({_D}) - 0.1 * {_D})"

# The feature table the fits below share: two convolved predictors per purchase.
FEATS = f"""{EV}, {pairs_sql(8)}, f AS (SELECT y.event_id, y.user_id, any_value(y.y) AS y, any_value(y.time) AS time,
  coalesce(sum(0.05 * exp(-0.05 * d) * v), 0) AS a, coalesce(sum({_GAM} * v), 0) AS b
  FROM y LEFT JOIN q ON y.event_id = q.event_id GROUP BY y.event_id, y.user_id)"""
# Least squares on two predictors in closed form.
OLS2 = """m AS (SELECT count(*) AS n, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb,
  covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_, var_pop(y) AS yy FROM f),
k AS (SELECT *, (ay * bb - by_ * ab) / (aa * bb - ab * ab) AS ca, (by_ * aa - ay * ab) / (aa * bb - ab * ab) AS cb FROM m),
o AS (SELECT *, my - ca * ma - cb * mb AS c0, yy - ca * ay - cb * by_ AS mse FROM k)"""


def features(spark, sf):
    X, Y = inputs(spark, sf)
    src = Source(X, [Conv("a", "value", EXP), Conv("b", "value", GAM)], tie=["event_id"])
    return convolve(Y, [src], ["user_id"], 8)


def _model(**kw):
    return Model(["y"], [C("value", EXP), C("value", GAM)], ["user_id"], history=8, tie=["event_id"], **kw)


@query(f"""WITH {FEATS}, {OLS2} SELECT 'intercept' AS parameter, round(c0, 6) AS estimate FROM o
UNION ALL SELECT 'Exp(value)', round(ca, 6) FROM o UNION ALL SELECT 'Gamma(value)', round(cb, 6) FROM o""")
def ols_coefs(spark, sf):
    X, Y = inputs(spark, sf)
    fit = _model().fit(X, Y).fits["y"]
    return rounded(fit.parameter_table(Y).select("parameter", "estimate"))


@query(f"""WITH {FEATS}, s AS (SELECT regr_slope(y, a) AS b1, regr_intercept(y, a) AS b0, regr_sxx(y, a) AS sxx,
  count(*) AS n, avg(a) AS ma, sqrt((regr_syy(y, a) - regr_slope(y, a) * regr_sxy(y, a)) / (count(*) - 2)) AS sg FROM f),
e AS (SELECT 'a' AS parameter, b1 AS estimate, sg / sqrt(sxx) AS se FROM s
  UNION ALL SELECT 'intercept', b0, sg * sqrt(1.0 / n + ma * ma / sxx) FROM s)
SELECT parameter, round(estimate, 6) AS estimate, round(se, 6) AS se,
  round(estimate - 1.959963984540054 * se, 6) AS lower, round(estimate + 1.959963984540054 * se, 6) AS upper FROM e""")
def parameter_summary(spark, sf):
    table_ = features(spark, sf)
    return rounded(regress.ols(table_, ["a"], "y").parameter_table(table_))


@query(f"""WITH {FEATS}, s AS (SELECT covar_pop(a, y) / var_pop(a) AS b, corr(a, y) * stddev_pop(y) AS c, stddev_pop(a) AS sd,
  avg(y) AS my, avg(a) AS ma FROM f)
SELECT 'ridge' AS penalty, round(c / 1.5 / sd, 6) AS slope, round(my - c / 1.5 / sd * ma, 6) AS intercept FROM s
UNION ALL SELECT 'lasso', round(sign(c) * greatest(abs(c) - 0.1, 0) / sd, 6),
  round(my - sign(c) * greatest(abs(c) - 0.1, 0) / sd * ma, 6) FROM s""")
def penalised(spark, sf):
    g = regress.gram(features(spark, sf), ["a", "y"])
    fits = {"ridge": regress.solve(g, ["a"], "y", l2=0.5), "lasso": regress.solve(g, ["a"], "y", l1=0.1)}
    rows = [(k, f.coefs["a"], f.intercept) for k, f in fits.items()]
    return rounded(spark.createDataFrame(rows, "penalty string, slope double, intercept double"))


@query(f"""WITH {FEATS}, {OLS2}, l AS (SELECT 'model' AS model, mse, n FROM o
  UNION ALL SELECT 'model!Gamma(value)', yy - ay * ay / aa, n FROM o
  UNION ALL SELECT 'model!Exp(value)', yy - by_ * by_ / bb, n FROM o
  UNION ALL SELECT 'model!Exp(value)!Gamma(value)', yy, n FROM o)
SELECT model, round(mse, 4) AS mse, round(-0.5 * n * (ln(2 * pi() * mse) + 1), 4) AS loglik FROM l""")
def ablation_family(spark, sf):
    """Four models from one convolved table and one pass of sums."""
    X, Y = inputs(spark, sf)
    fits = _model().fit(X, Y).ablated("y", ["Exp(value)", "Gamma(value)"])
    rows = [(k, f.sigma**2 * (f.n - len(f.coefs) - 1) / f.n, f.loglik) for k, f in fits.items()]
    return rounded(spark.createDataFrame(rows, "model string, mse double, loglik double"), 4)


_RATES = (0.01, 0.02, 0.05, 0.1, 0.2)


@query(f"""WITH {EV}, {pairs_sql(8)}, c AS (SELECT y.event_id, any_value(y.y) AS y, {', '.join(
    f'coalesce(sum({r} * exp(-{r} * d) * v), 0) AS f{i}' for i, r in enumerate(_RATES))}
  FROM y LEFT JOIN q ON y.event_id = q.event_id GROUP BY y.event_id)
""" + " UNION ALL ".join(f"SELECT 'exp_{r}' AS candidate, round(regr_r2(y, f{i}), 6) AS r2, round(regr_slope(y, f{i}), 6) AS slope, "
                         f"round(regr_intercept(y, f{i}), 6) AS intercept FROM c" for i, r in enumerate(_RATES)))
def kernel_candidates(spark, sf):
    X, Y = inputs(spark, sf)
    w = window_arrays(X, Y, ["user_id"], ["value"], 8, tie=["event_id"])
    return rounded(regress.candidate_scores(w, WINDOW, "y", "value", {f"exp_{r}": K.Exp(r) for r in _RATES}))


@query(f"""WITH {EV} SELECT count(*) AS n, 0.05 AS beta, 2.0 AS coef, 3.0 AS intercept FROM y""")
def kernel_recovery(spark, sf):
    """Responses made with a known kernel: the search returns the kernel they were made with."""
    X, Y = inputs(spark, sf)
    w = window_arrays(X, Y, ["user_id"], ["value"], 8, tie=["event_id"])
    w = w.withColumn("made", weighted_sum(WINDOW, "time", "value", EXP) * 2.0 + 3.0)
    fit = regress.fit_kernels(w, [Conv("a", "value", K.Exp(0.15))], "made")
    n = int(fit.fit.n)
    rows = [(n, round(fit.kernels["a"].beta, 4), round(fit.fit.coefs["a"], 4), round(fit.fit.intercept, 4))]
    return spark.createDataFrame(rows, "n long, beta double, coef double, intercept double")


@query(f"""WITH {FEATS}, {OLS2}, names AS (SELECT unnest(['Exp(value).beta', 'Gamma(value).alpha', 'Gamma(value).beta']) AS parameter)
SELECT parameter, n, round(0.5 * n * ln(mse), 3) AS loss_before, true AS better, 0.0::DOUBLE AS gradient, true AS converged FROM o, names""")
def kernel_fit(spark, sf):
    """The kernels of both terms learned for the observed responses, from those of the other queries: flat in every parameter."""
    X, Y = inputs(spark, sf)
    learned = _model().fit(X, Y, learn_kernels=True).learned
    rows = [(f"{o}.{p}", int(learned.moments.n), round(learned.trace[0], 3), bool(learned.trace[-1] <= learned.trace[0]),
             abs(round(float(g), 2)), learned.converged) for (o, p), g in zip(learned.parameters, learned.gradient)]
    return spark.createDataFrame(rows, "parameter string, n long, loss_before double, better boolean, gradient double, converged boolean")


def _recovered(spark, learned, response, names):
    """Learned numbers, and the variance of what they were learned from."""
    fit, g = learned.fits[response], learned.moments
    at = g.names.index(response)
    values = {f"{o}.{p}": v for (o, p), v in zip(learned.parameters, learned.values)} | {"intercept": fit.intercept} | fit.coefs
    rows = [(names.get(k, k), float(round(v, 4)), int(fit.n), float(round(g.cov[at, at], 5)), learned.converged) for k, v in values.items()]
    return spark.createDataFrame(rows, "parameter string, value double, n long, variance double, converged boolean")


def _planted_sql(made: str, values: dict[str, float], extra: str = "") -> str:
    rows = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in values.items())
    return f"""WITH {EV}, c AS (SELECT * FROM x WHERE x.event_type = 'click'), w AS (SELECT * FROM x WHERE x.event_type = 'view'),
pc AS (SELECT y.event_id, y.time - c.time AS d, c.value AS v FROM y JOIN c ON c.user_id = y.user_id AND c.time <= y.time + 1.1920929e-07
  QUALIFY row_number() OVER (PARTITION BY y.event_id ORDER BY c.time DESC, c.event_id DESC) <= 8),
pw AS (SELECT y.event_id, y.time - w.time AS d, w.value AS v FROM y JOIN w ON w.user_id = y.user_id AND w.time <= y.time + 1.1920929e-07
  QUALIFY row_number() OVER (PARTITION BY y.event_id ORDER BY w.time DESC, w.event_id DESC) <= 8),
gc AS (SELECT event_id, sum(0.05 * exp(-0.05 * d) * v) AS e, sum({_GAM} * v) AS g FROM pc GROUP BY event_id),
gw AS (SELECT event_id, sum(0.05 * exp(-0.05 * d) * v) AS e, sum({_GAM} * v) AS g FROM pw GROUP BY event_id),
f AS (SELECT y.*, coalesce(gc.e, 0) AS ce, coalesce(gc.g, 0) AS cg, coalesce(gw.e, 0) AS we, coalesce(gw.g, 0) AS wg FROM y
  LEFT JOIN gc USING (event_id) LEFT JOIN gw USING (event_id)),
m AS (SELECT count(*) AS n, round(var_pop({made}), 5) AS variance FROM f)
SELECT parameter, value, n, variance, true AS converged FROM m, (VALUES {rows}) AS p(parameter, value)"""


def _two_tables(spark, sf):
    """Clicks and views as event tables of their own, with their own predictors."""
    X, Y = inputs(spark, sf)
    clicks = X.where("event_type = 'click'").withColumnRenamed("value", "c")
    views = X.where("event_type = 'view'").withColumnRenamed("value", "w")
    return [clicks.select("event_id", "user_id", "time", "c"), views.select("event_id", "user_id", "time", "w")], Y


def _made(model, X, Y, made):
    """Responses made of a model's true features."""
    return model.compile(X, Y).features().withColumn("made", made).select(*Y.columns, "made")


@query(_planted_sql("2 * ce + 1.5 * wg + 3", {"c.beta": 0.05, "w.alpha": 2.0, "w.beta": 0.1, "c": 2.0, "w": 1.5, "intercept": 3.0}))
def kernel_recovery_two_sources(spark, sf):
    """Responses made of clicks by one kernel and views by another: the search returns both, from other ones."""
    X, Y = _two_tables(spark, sf)
    model = lambda a, b: Model(["made"], [C("c", a), C("w", b)], ["user_id"], history=8, tie=["event_id"])
    Y = _made(model(EXP, GAM), X, Y, F.col("`Exp(c)`") * 2 + F.col("`Gamma(w)`") * 1.5 + 3)
    learned = model(K.Exp(0.1), K.Gamma(1.6, 0.15)).fit(X, Y, learn_kernels=True).learned
    return _recovered(spark, learned, "made", {"Exp(c).beta": "c.beta", "Gamma(w).alpha": "w.alpha", "Gamma(w).beta": "w.beta", "Exp(c)": "c", "Gamma(w)": "w"})


@query(_planted_sql("2 * (ce + we) + 0.5 * wg + 3", {"shared.beta": 0.05, "w.beta": 0.1, "both": 2.0, "w": 0.5, "intercept": 3.0}))
def kernel_recovery_tied(spark, sf):
    """Clicks and views share one kernel and one coefficient; of the third term's kernel the shape is held."""
    X, Y = _two_tables(spark, sf)
    model = lambda a, b, **kw: Model(["made"], [
        C("c", a, coef_id="both", irf_id="shared"), C("w", a, coef_id="both", irf_id="shared"), C("w", b, trainable=("beta",))],
        ["user_id"], history=8, tie=["event_id"])
    Y = _made(model(EXP, GAM), X, Y, F.col("both") * 2 + F.col("`Gamma(w)`") * 0.5 + 3)
    learned = model(K.Exp(0.09), K.Gamma(2.0, 0.14)).fit(X, Y, learn_kernels=True).learned
    return _recovered(spark, learned, "made", {"Gamma(w).beta": "w.beta", "Gamma(w)": "w"})


@query(_planted_sql("ce + 0.25 * ce * wg + 0.02 * wg * time + 3", {"c.beta": 0.05, "w.alpha": 2.0, "w.beta": 0.1, "c": 1.0, "product": 0.25, "by_time": 0.02, "w": 0.0,
                                                                  "intercept": 3.0}))
def kernel_recovery_products(spark, sf):
    """Kernels learned through products of convolved terms with each other and with a column of the responses."""
    X, Y = _two_tables(spark, sf)
    model = lambda a, b: Model(["made"], [C("c", a), C("w", b)], ["user_id"], history=8, tie=["event_id"],
                               products=[("Exp(c)", "Gamma(w)"), ("Gamma(w)", "time")])
    c, w = F.col("`Exp(c)`"), F.col("`Gamma(w)`")
    Y = _made(model(EXP, GAM), X, Y, c + c * w * 0.25 + w * F.col("time") * 0.02 + 3)
    learned = model(K.Exp(0.07), K.Gamma(1.8, 0.12)).fit(X, Y, learn_kernels=True).learned
    out = _recovered(spark, learned, "made", {"Exp(c).beta": "c.beta", "Gamma(w).alpha": "w.alpha", "Gamma(w).beta": "w.beta", "Exp(c)": "c", "Gamma(w)": "w",
                                              "Exp(c):Gamma(w)": "product", "Gamma(w):time": "by_time"})
    # The column of the responses itself enters as a feature and gets no weight; nor does the second kernel alone.
    return out.where("parameter <> 'time'").withColumn("value", F.col("value") + 0.0).withColumn("value", F.when(F.abs("value") < 5e-4, 0.0).otherwise(F.col("value")))


@query(f"""WITH {FEATS}, {pairs_sql(8).replace('p AS', 'p2 AS').replace('FROM p ', 'FROM p2 ').replace('q AS', 'q2 AS')},
g AS (SELECT y.event_id, y.user_id % 3 AS grp, y.y, {', '.join(
    f'coalesce((SELECT sum({r} * exp(-{r} * d) * v) FROM q2 WHERE q2.event_id = y.event_id), 0) AS f{i}' for i, r in enumerate((0.02, 0.2)))} FROM y),
s AS (SELECT grp, count(*) AS n, regr_r2(y, f0) AS r0, regr_r2(y, f1) AS r1, regr_slope(y, f0) AS s0, regr_slope(y, f1) AS s1 FROM g GROUP BY grp)
SELECT grp, n, CASE WHEN r0 >= r1 THEN 'slow' ELSE 'fast' END AS candidate, round(greatest(r0, r1), 6) AS r2,
  round(CASE WHEN r0 >= r1 THEN s0 ELSE s1 END, 6) AS slope FROM s""")
def kernels_by_level(spark, sf):
    X, Y = inputs(spark, sf)
    w = window_arrays(X, Y.withColumn("grp", F.col("user_id") % 3), ["user_id"], ["value"], 8, tie=["event_id"])
    return rounded(regress.kernels_by_level(w, WINDOW, "y", "value", "grp", {"slow": K.Exp(0.02), "fast": K.Exp(0.2)}))


@query(f"""WITH {FEATS} SELECT user_id, count(*) AS n, 0.0::DOUBLE AS level_equation, 0.0::DOUBLE AS slope_equation, true AS converged
FROM f WHERE user_id IS NOT NULL GROUP BY user_id""")
def random_effects(spark, sf):
    """By-user intercepts and slopes, run to convergence, put into the mixed-model equations.

    For each user the residuals (and residuals times the predictor) must sum to s2 D^-1 u; what is left of that,
    in units of s2, is the result.
    """
    f = features(spark, sf)
    fit = regress.mixed(f, ["a"], "y", "user_id", ["intercept", "a"])
    inverse = np.linalg.inv(fit.variance)
    e = F.col("y") - F.col("pred")
    sums = fit.predict(f).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(e).alias("e"), F.sum(e * F.col("a")).alias("ea"))
    joined = sums.join(fit.effects.withColumnRenamed("user_id", "u"), F.col("user_id") == F.col("u"))
    u0, u1, s2 = F.col("ranef_intercept"), F.col("ranef_a"), fit.sigma**2
    left = [F.col(c) / s2 - (u0 * float(row[0]) + u1 * float(row[1])) for c, row in zip(("e", "ea"), inverse)]
    return joined.select("user_id", "n", *[(F.round(x, 5) + 0.0).alias(n) for x, n in zip(left, ("level_equation", "slope_equation"))],
                         F.lit(fit.converged).alias("converged"))


@query("""WITH l AS (SELECT ln(l_extendedprice) AS y, l_quantity AS q FROM lineitem),
o AS (SELECT count(*) AS n, regr_slope(y, q) AS b, regr_intercept(y, q) AS a, var_pop(y) - covar_pop(y, q) ** 2 / var_pop(q) AS v, sum(y) AS t FROM l)
SELECT n, round(b, 5) AS slope, round(a, 4) AS intercept, round(sqrt(v), 4) AS sigma, round((-0.5 * n * (ln(2 * pi() * v) + 1) - t) / n, 6) AS loglik FROM o""")
def fit_lognormal(spark, sf):
    """Log-normal prices by quantity: the search agrees with the closed form."""
    fit = fit_likelihood(table(spark, sf, "lineitem"), ["l_quantity"], "l_extendedprice", "lognormal")
    return spark.createDataFrame([(fit.n, round(fit.coefs["l_quantity"], 5), round(fit.intercept, 4), round(fit.shape["sigma"], 4),
                                   round(fit.loglik / fit.n, 6))], "n long, slope double, intercept double, sigma double, loglik double")


_FAMILIES = ("normal", "lognormal", "lognormalv2", "johnsonsu", "sinharcsinh", "exgaussian", "exgaussianinvrate")
# Values with a roughly normal part, made of their ids, added to their skewed one.
_NOISY = "value + 200 + 0.04 * ((event_id * 7919) % 1000 + (event_id * 104729) % 1000 + (event_id * 1299709) % 1000)"
_CLOSED = f"""l AS (SELECT {_NOISY} AS p, ln({_NOISY}) AS lp, CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END AS q FROM events),
o AS (SELECT count(*) AS n, var_pop(p) - covar_pop(p, q) ** 2 / var_pop(q) AS v, var_pop(lp) - covar_pop(lp, q) ** 2 / var_pop(q) AS lv, avg(lp) AS m FROM l)"""


@query(f"WITH {_CLOSED} " + " UNION ALL ".join(
    f"SELECT '{f}' AS family, n, 0.0::DOUBLE AS gradient, true AS converged, "
    + {"normal": "round(-0.5 * (ln(2 * pi() * v) + 1), 5)", "lognormal": "round(-0.5 * (ln(2 * pi() * lv) + 1) - m, 5)"}.get(f, "NULL") + " AS loglik FROM o"
    for f in _FAMILIES))
def fit_families(spark, sf):
    """A skewed response under every family: where the search ends, the score equations hold; likelihoods where SQL can say them."""
    ev = table(spark, sf, "events").select(F.expr(_NOISY).alias("r"), F.when(F.col("event_type") == "view", 1.0).otherwise(0.0).alias("g"))
    rows = []
    for family in _FAMILIES:
        fit = fit_likelihood(ev, ["g"], "r", family)
        rows.append((family, fit.n, abs(round(float(np.abs(fit.gradient).max()), 2)), fit.converged,
                     round(fit.loglik / fit.n, 5) if family in ("normal", "lognormal") else None))
    return spark.createDataFrame(rows, "family string, n long, gradient double, converged boolean, loglik double")


_SCALED = """SELECT '{family}' AS family, round(avg({y}) FILTER (g = 0), 4) AS mean0, round(avg({y}) FILTER (g = 1) - avg({y}) FILTER (g = 0), 4) AS mean1,
  round(ln(stddev_pop({y}) FILTER (g = 0)), 4) AS scale0, round(ln(stddev_pop({y}) FILTER (g = 1)) - ln(stddev_pop({y}) FILTER (g = 0)), 4) AS scale1,
  count(*) AS n, true AS converged FROM e"""


@query("WITH e AS (SELECT value AS v, ln(value) AS lv, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS g FROM events) "
       + _SCALED.format(family="normal", y="v") + " UNION ALL " + _SCALED.format(family="lognormal", y="lv"))
def scale_models(spark, sf):
    """Location and scale both by a predictor, fitted together: in two groups these are the groups' means and deviations.

    Values that a family does not allow leave nothing to fit; the row then has what the groups' means and deviations
    come to, infinite or NaN.
    """
    ev = table(spark, sf, "events").withColumn("g", F.when(F.col("event_type") == "view", 1.0).otherwise(0.0))
    rows = []
    for family in ("normal", "lognormal"):
        fit = fit_likelihood(ev, ["g"], "value", family, by={"sigma": ["g"]}, tol=1e-10, impossible="undefined")
        scale, by = fit.by["sigma"]
        found = (fit.intercept, fit.coefs["g"], scale, by["g"])
        if fit.impossible:
            found = _two_groups(ev, _ln(F.col("value")) if family == "lognormal" else F.col("value"))
        rows.append((family, *found, fit.n, fit.converged))
    return rounded(spark.createDataFrame(rows, "family string, mean0 double, mean1 double, scale0 double, scale1 double, n long, converged boolean"), 4)


def _ln(c):
    """The logarithm as the SQL has it: of 0 minus infinity, below NaN."""
    return F.when(c > 0, F.log(c)).when(c == 0, F.lit(-np.inf)).when(c < 0, F.lit(np.nan))


def _two_groups(df, y):
    """Mean and logarithm of the deviation of ``y`` where ``g`` is 0, and what the rows where it is 1 have more."""
    told = [f(F.when(F.col("g") == k, y)) for f in (F.avg, lambda c: _ln(F.stddev_pop(c))) for k in (0.0, 1.0)]
    return tuple(df.agg(*[x for a, b in (told[:2], told[2:]) for x in (a, b - a)]).first())


@query(f"""WITH {EV}, {pairs_sql(8)}, sx AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM x),
g AS (SELECT y.event_id, any_value(y.y) AS y, coalesce(sum(0.05 * exp(-0.05 * d) * (v - m) / sd), 0) AS a
  FROM sx, y LEFT JOIN q ON y.event_id = q.event_id GROUP BY y.event_id),
t AS (SELECT a, (y - (SELECT avg(y) FROM g)) / (SELECT stddev_samp(y) FROM g) AS z FROM g)
SELECT count(*) AS n, round(regr_slope(z, a), 6) AS slope, round(regr_intercept(z, a), 6) AS intercept, round(regr_r2(z, a), 6) AS r2 FROM t""")
def standardised_fit(spark, sf):
    """A model of standardised predictors and a standardised response."""
    X, Y = inputs(spark, sf)
    fit = Model(["z(y)"], [C("z(value)", EXP)], ["user_id"], history=8, tie=["event_id"]).fit(X, Y).fits["z(y)"]
    return rounded(spark.createDataFrame([(int(fit.n), fit.coefs["Exp(z(value))"], fit.intercept, fit.r2)],
                                         "n long, slope double, intercept double, r2 double"))


@query(f"""WITH {FEATS}, {OLS2} SELECT 'convolved' AS kind, 'a' AS name, count(*) AS n, round(sum(a), 4) AS total FROM f
UNION ALL SELECT 'convolved', 'b', count(*), round(sum(b), 4) FROM f UNION ALL SELECT 'parameters', 'a', 1, round(ca, 4) FROM o
UNION ALL SELECT 'parameters', 'b', 1, round(cb, 4) FROM o UNION ALL SELECT 'parameters', 'intercept', 1, round(c0, 4) FROM o""")
def convolved_sink(spark, sf):
    """Convolved predictors and parameters written to the result table and read again."""
    path, feats = fresh_folder(spark, "results"), features(spark, sf)
    write_results(feats.select("event_id", "a", "b"), path, {"model": "m", "kind": "convolved", "response": "y"})
    fit = regress.ols(feats, ["a", "b"], "y")
    write_results(fit.parameter_table(feats), path, {"model": "m", "kind": "parameters", "response": "y"})
    rows = read_rows(spark, path, "convolved", "event_id long, a double, b double").select(
        "kind", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("v")) for n in "ab"])).alias("x")).select("kind", "x.*")
    told = read_rows(spark, path, "parameters", "parameter string, estimate double").select("kind", F.col("parameter").alias("name"), F.col("estimate").alias("v"))
    return rounded(rows.unionByName(told).groupBy("kind", "name").agg(F.count("*").alias("n"), F.sum("v").alias("total")), 4)


@query(f"""WITH {FEATS}, l AS (SELECT event_id, ln(y) AS ly, y, a FROM f),
s AS (SELECT regr_slope(ly, a) AS b, regr_intercept(ly, a) AS c, (regr_syy(ly, a) - regr_slope(ly, a) * regr_sxy(ly, a)) / count(*) AS v FROM l)
SELECT event_id, round(exp(c + b * a + v / 2), 2) AS pred, round(-0.5 * ln(2 * pi() * v) - (ly - c - b * a) ** 2 / (2 * v) - ly, 4) AS loglik FROM l, s""")
def model_family(spark, sf):
    """A model with log-normal responses: expected values and densities by its own family, null if a response is not positive."""
    X, Y = inputs(spark, sf)
    fitted = Model(["y"], [C("value", EXP)], ["user_id"], history=8, tie=["event_id"], family="lognormal", impossible="undefined").fit(X, Y)
    out = fitted.predict(fitted.features(X, Y))
    return out.select("event_id", F.round("pred", 2).alias("pred"), F.round("loglik", 4).alias("loglik"))


@query(f"""WITH {FEATS}, g AS (SELECT *, user_id % 4 AS fold FROM f),
s AS (SELECT h.fold, regr_slope(g.y, g.a) AS slope, regr_intercept(g.y, g.a) AS intercept
  FROM (SELECT DISTINCT fold FROM g) h JOIN g ON g.fold != h.fold GROUP BY h.fold)
SELECT event_id, fold, round(intercept + slope * a, 6) AS pred FROM g JOIN s USING (fold)""")
def crossval_predictions(spark, sf):
    """Every response predicted by a fit on the users of the other folds."""
    f = features(spark, sf).withColumn("fold", F.col("user_id") % 4)
    out, _ = regress.crossval(f, ["a"], "y", "fold")
    return rounded(out.select("event_id", "fold", "pred"))


@query("""WITH l AS (SELECT l_quantity AS q, l_extendedprice / 1000 AS p, l_tax AS t FROM lineitem),
g AS (SELECT var_pop(q) AS qq, var_pop(p) AS pp, covar_pop(q, p) AS qp, covar_pop(q, t) AS qt, covar_pop(p, t) AS pt, count(*) AS n FROM l),
b AS (SELECT *, (pp * qt - qp * pt) / (qq * pp - qp * qp) AS bq, (qq * pt - qp * qt) / (qq * pp - qp * qp) AS bp FROM g)
SELECT n, 70 AS columns, round(bq, 8) AS quantity, round(bp, 8) AS price
  FROM b""")
def ols_wide(spark, sf):
    """Seventy columns, of which 35 repeat each of two: the coefficients share out to those of two columns."""
    li = table(spark, sf, "lineitem")
    cols = {f"q{i}": F.col("l_quantity") for i in range(35)} | {f"p{i}": F.col("l_extendedprice") / 1000 for i in range(35)}
    wide = li.select(*[c.alias(n) for n, c in cols.items()], "l_tax")
    g = regress.gram(wide, [*cols, "l_tax"])
    fit = regress.solve(g, list(cols), "l_tax")
    row = (int(fit.n), len(cols), round(sum(fit.coefs[f"q{i}"] for i in range(35)), 8), round(sum(fit.coefs[f"p{i}"] for i in range(35)), 8))
    return spark.createDataFrame([row], "n long, columns int, quantity double, price double")


@query("""WITH e AS (SELECT user_id, avg(value) - (SELECT avg(value) FROM events WHERE event_type = 'click') AS effect
  FROM events WHERE event_type = 'click' GROUP BY user_id HAVING count(*) >= 12)
SELECT event_id, round(coalesce(effect, 0), 6) AS effect FROM events LEFT JOIN e USING (user_id) WHERE event_type = 'view'""")
def level_lookup(spark, sf):
    ev = table(spark, sf, "events")
    clicks = ev.where("event_type = 'click'")
    mean = moments(clicks, {"v": F.col("value")})["v"].mean
    effects = clicks.groupBy("user_id").agg(
        (F.avg("value") - mean).alias("effect"), F.count(F.lit(1)).alias("n")).where("n >= 12")
    out = regress.lookup_effects(ev.where("event_type = 'view'"), effects, "user_id", ["effect"])
    return rounded(out.select("event_id", "effect"))


@query("""SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code FROM orders""")
def category_codes(spark, sf):
    o = table(spark, sf, "orders")
    classes = regress.category_codes(o, "o_orderpriority")
    return o.select("o_orderkey", regress.category_index("o_orderpriority", classes).alias("code"))


# ---------------------------------------------------------------- prediction

_PARTS = f"""{FEATS}, u AS (SELECT f.*, CASE WHEN r % 4 <= 1 THEN 'train' WHEN r % 4 = 2 THEN 'dev' ELSE 'test' END AS part FROM f
  JOIN (SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS r FROM (SELECT DISTINCT user_id FROM y)) USING (user_id)),
t AS (SELECT regr_slope(y, a) AS b1, regr_intercept(y, a) AS b0,
  (regr_syy(y, a) - regr_slope(y, a) * regr_sxy(y, a)) / count(*) AS mse FROM u WHERE part = 'train'),
r AS (SELECT event_id, part, y, b0 + b1 * a AS pred, -0.5 * ln(2 * pi() * mse) - (y - b0 - b1 * a) ** 2 / (2 * mse) AS ll FROM u, t)"""


def _held_out(spark, sf):
    X, Y = inputs(spark, sf)
    Y = modular_partition(Y, ["user_id"]).drop("splitID")
    model = Model(["y"], [C("value", EXP)], ["user_id"], history=8, tie=["event_id"])
    return model.fit_split(X, Y, F.col("part") == "train")


@query(f"WITH {_PARTS} SELECT event_id, part, round(pred, 6) AS pred, round(ll, 6) AS loglik FROM r")
def predict_rows(spark, sf):
    fitted, feats = _held_out(spark, sf)
    out = fitted.predict(feats)
    return rounded(out.select("event_id", "part", F.col("pred").alias("pred"), F.col("loglik").alias("loglik")))


@query(f"""WITH {_PARTS} SELECT part, count(*) AS n, round(avg((y - pred) ** 2), 4) AS mse, round(avg(abs(y - pred)), 4) AS mae,
  round(greatest(0, (1 - avg((y - pred) ** 2) / var_pop(y)) * 100), 4) AS pve, round(corr(y, pred), 4) AS r,
  round(sum(ll), 4) AS loglik FROM r GROUP BY part""")
def evaluate_partitions(spark, sf):
    fitted, feats = _held_out(spark, sf)
    return rounded(fitted.evaluate(feats, by=["part"]), 4)


@query(f"""WITH {FEATS} SELECT round(regr_slope(y, (a - m) / s), 6) AS slope, round(avg(y), 6) AS intercept, count(*) AS n
FROM f, (SELECT avg(a) AS m, stddev_samp(a) AS s FROM f)""")
def two_step_regression(spark, sf):
    fit, _ = two_step(features(spark, sf), ["a"], "y")
    return rounded(spark.createDataFrame([(fit.coefs["z(a)"], fit.intercept, int(fit.n))],
                                         "slope double, intercept double, n long"))


@query("""WITH j AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT count(*) AS n, round(regr_slope(o_totalprice, l_extendedprice), 6) AS slope,
  round(regr_intercept(o_totalprice, l_extendedprice), 3) AS intercept FROM j""")
def baseline_merge_ols(spark, sf):
    """Linear baseline: events and responses merged on their shared column."""
    X = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), "l_extendedprice")
    Y = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), "o_totalprice")
    fit = regress.ols(baseline_merge(X, Y), ["l_extendedprice"], "o_totalprice")
    df = spark.createDataFrame([(int(fit.n), fit.coefs["l_extendedprice"], fit.intercept)],
                               "n long, slope double, intercept double")
    return df.select("n", F.round("slope", 6).alias("slope"), F.round("intercept", 3).alias("intercept"))


@query(f"""WITH {EV}, {pairs_sql(8)}, s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM x),
g AS (SELECT event_id, sum(0.05 * exp(-0.05 * d) * (v - m) / sd) AS z, sum(CASE WHEN x_type = 'view' THEN 0.05 * exp(-0.05 * d) ELSE 0 END) AS vw,
  sum(CASE WHEN x_type = 'view' THEN 0.05 * exp(-0.05 * d) * v ELSE 0 END) AS vv, sum(0.05 * exp(-0.05 * d)) AS rt FROM q, s GROUP BY event_id)
SELECT y.event_id, round(coalesce(z, 0), 6) AS z, round(coalesce(vw, 0), 6) AS vw, round(coalesce(vv, 0), 6) AS vv,
  round(coalesce(vv, 0) + coalesce(rt, 0), 6) AS tied, round(coalesce(z, 0) * y.y, 6) AS zy FROM y LEFT JOIN g ON y.event_id = g.event_id""")
def model_features(spark, sf):
    """Transforms, indicators, products, a shared coefficient and a product after convolution."""
    X, Y = inputs(spark, sf)
    X = X.withColumn("rate", F.lit(1.0))
    model = Model(
        ["y"],
        [C("z(value)", EXP), C("event_type", EXP), C("event_type:value", EXP),
         C("event_type:value", EXP, coef_id="tied"), C("rate", EXP, coef_id="tied")],
        ["user_id"], history=8, tie=["event_id"], products=[("Exp(z(value))", "y")])
    out = model.compile(X, model.prepared(Y)).features()
    names = {"Exp(z(value))": "z", "Exp(event_type_view)": "vw", "Exp(event_type_view:value)": "vv",
             "tied": "tied", "Exp(z(value)):y": "zy"}
    return rounded(out.select("event_id", *[F.col(f"`{k}`").alias(v) for k, v in names.items()]))


# ---------------------------------------------------------------- response distributions

_N = "(-0.5 * ln(2 * pi()) - ln({s}) - 0.5 * (({y} - {m}) / {s}) ** 2)"
_W = "((v - 50.0) / 40.0)"
_SC = "(40.0 * 2.0 / sinh(asinh(2.0) * 1.2))"
_SI = f"(asinh((v - 50.0) / {_SC}) / 1.2 - 0.3)"
_V2 = "ln(1 + 40.0 * 40.0 / (50.0 * 50.0))"


@query(f"""WITH r AS (SELECT event_id, value AS v FROM events)
SELECT event_id, round({_N.format(y='v', m='50.0', s='40.0')}, 6) AS normal,
  round({_N.format(y='ln(v)', m='3.0', s='1.0')} - ln(v), 6) AS lognormal,
  round({_N.format(y='ln(v)', m=f'(ln(50.0) - 0.5 * {_V2})', s=f'sqrt({_V2})')} - ln(v), 6) AS lognormalv2,
  round(ln(1.5) - ln(40.0) - 0.5 * ln(1 + {_W} * {_W}) - 0.5 * ln(2 * pi()) - 0.5 * (-0.5 + 1.5 * asinh({_W})) ** 2, 6) AS johnsonsu,
  round(-0.5 * ln(2 * pi()) - 0.5 * sinh({_SI}) ** 2 + ln(cosh({_SI})) - ln(1.2) - ln({_SC})
    - 0.5 * ln(1 + ((v - 50.0) / {_SC}) ** 2), 6) AS sinharcsinh,
  round(ln(0.02) - 0.02 * v, 6) AS exponential FROM r""")
def loglik_continuous(spark, sf):
    v = F.col("value")
    return rounded(table(spark, sf, "events").select(
        "event_id", D.normal(v, 50, 40).alias("normal"), D.lognormal(v, 3, 1).alias("lognormal"),
        D.lognormalv2(v, 50, 40).alias("lognormalv2"), D.johnsonsu(v, 50, 40, -0.5, 1.5).alias("johnsonsu"),
        D.sinharcsinh(v, 50, 40, 0.3, 1.2).alias("sinharcsinh"), D.exponential(v, 0.02).alias("exponential")))


_Z = "least(8.5, (v - 10.0 - 0.02 * 400.0) / 20.0)"
_PHI_Z = (f"(0.5 + sign({_Z}) * exp(-0.5 * {_Z} * {_Z}) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: "
          f"exp((2 * k + 1) * ln(abs({_Z}) + 1e-300) - (lgamma(k + 1.5) - lgamma(0.5) + (k + 1) * ln(2.0))))))")


@query(f"""WITH r AS (SELECT event_id, value AS v FROM events)
SELECT event_id, round(ln(0.02) + 0.02 * (10.0 - v) + 0.5 * 0.0004 * 400.0 + ln({_PHI_Z}), 6) AS exgaussian,
  round(ln(0.02) + 0.02 * (10.0 - v) + 0.5 * 0.0004 * 400.0 + ln({_PHI_Z}), 6) AS exgaussianinvrate FROM r""")
def loglik_exgaussian(spark, sf):
    v = F.col("value")
    return rounded(table(spark, sf, "events").select(
        "event_id", D.exgaussian(v, 10, 20, 0.02).alias("exgaussian"),
        D.exgaussianinvrate(v, 10, 20, 50).alias("exgaussianinvrate")))


@query("""SELECT doc_id, round(quality * (0.5 + toxic) - ln(1 + exp(0.5 + toxic)), 6) AS bernoulli,
  round(CASE WHEN quality + toxic = 0 THEN 0.1 WHEN quality + toxic = 1 THEN 0.7 ELSE -0.4 END
    - ln(exp(0.1) + exp(0.7) + exp(-0.4)), 6) AS categorical FROM labels""")
def loglik_discrete(spark, sf):
    lb = table(spark, sf, "labels")
    return rounded(lb.select(
        "doc_id", D.bernoulli(F.col("quality"), F.lit(0.5) + F.col("toxic")).alias("bernoulli"),
        D.categorical(F.col("quality") + F.col("toxic"), [0.1, 0.7, -0.4]).alias("categorical")))


@query("""WITH j AS (SELECT quality, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS en FROM labels JOIN documents USING (doc_id)),
g AS (SELECT avg(CASE WHEN en = 0 THEN quality END) AS p0, avg(CASE WHEN en = 1 THEN quality END) AS p1 FROM j)
SELECT round(ln(p0 / (1 - p0)), 3) AS intercept, round(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)), 3) AS slope FROM g""")
def logistic_regression(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", 1.0).otherwise(0.0).alias("en"))
    fit = regress.fit_family(table(spark, sf, "labels").join(docs, "doc_id"), ["en"], "quality", "bernoulli")
    return rounded(spark.createDataFrame([(fit.intercepts[0], fit.coefs[0]["en"])], "intercept double, slope double"), 3)


@query("""SELECT o_orderpriority, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 3) AS f,
  round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0 END), 3) AS o,
  round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0 END), 3) AS p FROM orders GROUP BY 1""")
def multinomial_regression(spark, sf):
    """Indicators saturate the design, so fitted probabilities equal the groups' shares."""
    o, names = dummies(table(spark, sf, "orders"), "o_orderpriority")
    fit = regress.fit_family(o, names, "o_orderstatus", "categorical")
    e = [F.exp(c) for c in fit.logits()]
    total = e[0] + e[1] + e[2]
    probs = [(c / total).alias(k) for c, k in zip(e, ("f", "o", "p"))]
    return rounded(o.select("o_orderpriority", *names).distinct().select("o_orderpriority", *probs), 3)


@query("""WITH g AS (SELECT event_type, ln(avg(value)) AS l FROM events GROUP BY 1), b AS (SELECT l FROM g WHERE event_type = 'click')
SELECT CASE WHEN event_type = 'click' THEN 'intercept' ELSE 'event_type_' || event_type END AS parameter,
  round(CASE WHEN event_type = 'click' THEN g.l ELSE g.l - b.l END, 4) AS estimate FROM g, b""")
def exponential_regression(spark, sf):
    ev, names = dummies(table(spark, sf, "events"), "event_type")
    fit = regress.fit_family(ev, names, "value", "exponential")
    rows = [("intercept", fit.intercepts[0]), *fit.coefs[0].items()]
    return rounded(spark.createDataFrame(rows, "parameter string, estimate double"), 4)


@query("""WITH e AS (SELECT value, CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS g FROM events),
m AS (SELECT g, avg(value) AS m FROM e GROUP BY g),
s AS (SELECT g, avg(ln(greatest((value - m) ** 2, 1e-12))) AS l FROM e JOIN m USING (g) GROUP BY g)
SELECT round(max(CASE WHEN g = 0 THEN m END), 4) AS mean0, round(max(CASE WHEN g = 1 THEN m END) - max(CASE WHEN g = 0 THEN m END), 4) AS mean1,
  round(max(CASE WHEN g = 0 THEN l END), 4) AS scale0, round(max(CASE WHEN g = 1 THEN l END) - max(CASE WHEN g = 0 THEN l END), 4) AS scale1
FROM m JOIN s USING (g)""")
def distributional_regression(spark, sf):
    ev = table(spark, sf, "events").withColumn("g", F.when(F.col("event_type") == "view", 1.0).otherwise(0.0))
    mean, scale = regress.distributional(ev, ["g"], "value", ["g"])
    return rounded(spark.createDataFrame(
        [(mean.intercept, mean.coefs["g"], scale.intercept, scale.coefs["g"])],
        "mean0 double, mean1 double, scale0 double, scale1 double"), 4)


# ---------------------------------------------------------------- curves

_GRID_D = "(i * 72.0 / 99)"


@query(f"""WITH {FEATS}, {OLS2}, g AS (SELECT unnest(range(0, 100)) AS i),
c AS (SELECT 'a' AS term, {_GRID_D} AS t, ca * 0.05 * exp(-0.05 * {_GRID_D}) AS irf FROM o, g
  UNION ALL SELECT 'b', d - 4 * 1.1920928955078125e-07, cb * exp(2.0 * ln(0.1) + ln(d) - 0.1 * d)
  FROM o, (SELECT {_GRID_D} + 4 * 1.1920928955078125e-07 AS d FROM g))
SELECT term, round(t, 5) AS t, round(irf, 6) AS irf FROM c""")
def irf_grid(spark, sf):
    """Curves of the fitted terms over 72 hours."""
    fit = regress.ols(features(spark, sf), ["a", "b"], "y")
    out = irf.curves(irf.time_grid(spark, 72.0, 100), {"a": EXP, "b": GAM}, fit.coefs)
    return out.select("term", F.round("t", 5).alias("t"), F.round("irf", 6).alias("irf"))


@query(f"""WITH {FEATS}, {OLS2}, g AS (SELECT unnest(range(0, 1000)) * 72.0 / 999 AS t)
SELECT 'a' AS term, round(sum(ca * 0.05 * exp(-0.05 * t)) * 72.0 / 1000, 6) AS integral FROM o, g
UNION ALL SELECT 'b', round(sum(cb * exp(2.0 * ln(0.1) + ln(t + 4 * 1.1920928955078125e-07) - 0.1 * (t + 4 * 1.1920928955078125e-07))) * 72.0 / 1000, 6) FROM o, g""")
def irf_integral(spark, sf):
    fit = regress.ols(features(spark, sf), ["a", "b"], "y")
    return rounded(irf.integral_table(spark, {"a": EXP, "b": GAM}, fit.coefs, 72.0, 1000))


@query(f"""WITH {FEATS}, b AS (SELECT regr_slope(y, a) AS c FROM f), r AS (SELECT quantile_cont(value, 0.05) AS lo,
  quantile_cont(value, 0.95) AS hi, avg(value) AS ref FROM x),
g AS (SELECT i // 16 AS i, i % 16 AS j FROM (SELECT unnest(range(0, 256)) AS i))
SELECT round(lo + i * (hi - lo) / 15, 5) AS x, round(j * 72.0 / 15, 5) AS t,
  round((lo + i * (hi - lo) / 15 - ref) * 0.05 * exp(-0.05 * j * 72.0 / 15) * c, 6) AS effect FROM b, r, g""")
def irf_surface(spark, sf):
    """Effect over predictor values (between quantiles of the data) and delays, relative to the mean."""
    X, _ = inputs(spark, sf)
    coef = regress.ols(features(spark, sf), ["a"], "y").coefs["a"]
    lo, hi, ref = X.agg(F.percentile("value", 0.05), F.percentile("value", 0.95), F.avg("value")).first()
    out = irf.surface(spark, (lo, hi), 72.0, EXP, coef, ref, points=16)
    return out.select(F.round("x", 5).alias("x"), F.round("t", 5).alias("t"), F.round("effect", 6).alias("effect"))


@query(f"""WITH {FEATS}, {OLS2}, s AS (SELECT stddev_samp(value) AS sd, avg(value) AS m FROM x)
SELECT 'a' AS predictor, round(ca * 0.05 * exp(-0.05 * 12.0) * m, 6) AS at_reference, round(ca * 0.05 * exp(-0.05 * 12.0) * (m + sd), 6) AS at_step,
  round(ca * 0.05 * exp(-0.05 * 12.0) * sd, 6) AS effect FROM o, s
UNION ALL SELECT 'b', round(w * m, 6), round(w * (m + sd), 6), round(w * sd, 6)
FROM (SELECT cb * exp(2.0 * ln(0.1) + ln(12.0 + 4 * 1.1920928955078125e-07) - 0.1 * (12.0 + 4 * 1.1920928955078125e-07)) AS w, m, sd FROM o, s)""")
def irf_manipulations(spark, sf):
    """A step of one standard deviation from the mean, twelve hours after the event."""
    X, _ = inputs(spark, sf)
    fit = regress.ols(features(spark, sf), ["a", "b"], "y")
    steps, refs, _ = irf.manipulation_settings(X, ["value"], "mean")
    out = irf.manipulations(spark.range(1), fit.coefs, {"a": EXP, "b": GAM}, 12.0,
                            {k: steps["value"] for k in "ab"}, {k: refs["value"] for k in "ab"})
    return rounded(out)


@query(f"""WITH {EV}, l AS (SELECT user_id, time, value, CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END AS mask,
  lag(time) OVER w AS t0, lag(value) OVER w AS v0 FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time, value))
SELECT user_id, count(*) AS points, round(CASE WHEN count(*) > 1 THEN coalesce(sum((value + v0) / 2 * (time - t0) * mask), 0)
  ELSE sum(value * mask) END, 4) AS integral FROM l GROUP BY user_id""")
def trapezoid_integral(spark, sf):
    ev = events(spark, sf).withColumn("mask", F.when(F.col("event_type") == "error", 0.0).otherwise(1.0))
    return rounded(irf.trapezoid(ev, ["user_id"], "time", "value", "mask"), 4)


@query("""WITH l AS (SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice FROM orders)
SELECT o_custkey, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM l GROUP BY 1""")
def series_statistics(spark, sf):
    """Per-level statistics that baselines scale by."""
    return rounded(level_moments(orders_series(spark, sf), ["o_custkey"], "o_totalprice"), 4)


@query("""SELECT l_returnflag, count(*) AS n, round(avg((p - q) ** 2), 4) AS mse, round(avg(abs(p - q)), 4) AS mae,
  round(greatest(0, (1 - avg((p - q) ** 2) / var_pop(p)) * 100), 6) AS pve, round(corr(p, q), 6) AS r
FROM (SELECT l_returnflag, l_extendedprice / 1000 AS p, l_quantity * 1.5 AS q FROM lineitem) GROUP BY 1""")
def error_metrics(spark, sf):
    li = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 1000).alias("p"),
                                             (F.col("l_quantity") * 1.5).alias("q"))
    m = metrics(li, "p", "q", ["l_returnflag"])
    return m.select("l_returnflag", "n", F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"),
                    F.round("pve", 6).alias("pve"), F.round("r", 6).alias("r"))
