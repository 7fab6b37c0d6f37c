"""Regression on feature tables.

Only sufficient statistics leave the cluster: a few sums per pair of columns, gathered by one
aggregation with partial sums on the map side.  The solves on the driver are as small as the number
of features, never as the data.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions.kernels import Kernel
from echoframe.functions.special import chi2_sf, normal_cdf_scalar, normal_quantile
from echoframe.operators.convolve import Conv, weighted_sum
from echoframe.session import checkpointed

# Beyond this many columns products are summed by matrix batches rather than by one aggregate for each pair.
WIDE = 60
# Levels of a grouping factor whose statistics one task of a pass reads.
LEVELS = 50_000


@dataclass
class Gram:
    """Count, means and population covariances of some columns (weighted if weights were given)."""

    names: list[str]
    n: float
    mean: np.ndarray
    cov: np.ndarray

    def index(self, names: Sequence[str]) -> list[int]:
        return [self.names.index(c) for c in names]

    def pick(self, names: Sequence[str]) -> "Gram":
        ix = self.index(names)
        return Gram(list(names), self.n, self.mean[ix], self.cov[np.ix_(ix, ix)])

    def raw(self) -> np.ndarray:
        """Uncentred second moments."""
        return self.cov + np.outer(self.mean, self.mean)


def _doubles(exprs: dict[str, Column]) -> list[Column]:
    return [c.cast("double").alias(n) for n, c in exprs.items()]


def gram(df: DataFrame, columns: Sequence[str] | dict[str, Column], weight: str | None = None) -> Gram:
    """Means and covariances of ``columns`` over complete rows, at any width.

    Few unweighted columns are one aggregation in generated code.  Otherwise means come first, and
    each task then sums products of centred columns batch by batch.  Both give the same numbers.
    """
    exprs = columns if isinstance(columns, dict) else {c: F.col(f"`{c}`") for c in columns}
    names = list(exprs)
    k = len(names)
    flat = df.select(*_doubles({f"_{i}": c for i, c in enumerate(exprs.values())}),
                     *([F.col(weight).cast("double").alias("_w")] if weight else []))
    # Incomplete rows are blanked inside the aggregates: a filter would be pushed below the projection
    # and compute every (possibly costly) column a second time.
    complete = F.expr(" and ".join(f"_{i} is not null and not isnan(_{i})" for i in range(k)))
    if weight is not None or k > WIDE:
        return _wide_gram(flat, names, complete, weight is not None)
    x = [F.when(complete, F.col(f"_{i}")) for i in range(k)]
    aggs = [F.count(x[0]).alias("n")] + [F.avg(x[i]).alias(f"m{i}") for i in range(k)]
    aggs += [F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    row = flat.agg(*aggs).first()
    return _as_gram(names, row)


def _as_gram(names: list[str], row) -> Gram:
    k = len(names)
    mean = np.array([row[f"m{i}"] for i in range(k)], dtype=float)
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return Gram(names, float(row["n"]), mean, cov)


def _wide_gram(flat: DataFrame, names: list[str], complete: Column, weighted: bool) -> Gram:
    """Centred on means of a first pass; a task sends k rows of k sums."""
    k = len(names)
    w = F.when(complete, F.col("_w") if weighted else F.lit(1.0))
    row = flat.agg(F.sum(w).alias("n"), *[F.sum(w * F.col(f"_{i}")).alias(f"m{i}") for i in range(k)]).first()
    n = float(row["n"] or 0.0)
    mean = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else np.nan for i in range(k)], dtype=float) / n if n else np.full(k, np.nan)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for pdf in batches:
            x = pdf.iloc[:, :k].to_numpy(dtype=float)
            v = pdf.iloc[:, k].to_numpy(dtype=float) if weighted else np.ones(len(x))
            ok = ~np.isnan(x).any(axis=1) & ~np.isnan(v)
            d = x[ok] - mean
            total += d.T @ (d * v[ok, None])
        yield pd.DataFrame({"i": np.arange(k, dtype=np.int32), "v": list(total)})

    sums = [F.sum(F.get("v", F.lit(j))).alias(f"s{j}") for j in range(k)]
    got = flat.mapInPandas(products, "i int, v array<double>").groupBy("i").agg(*sums).collect()
    cov = np.zeros((k, k))
    for r in got:
        cov[r["i"]] = [r[f"s{j}"] for j in range(k)]
    return Gram(names, n, mean, cov / max(n, 1e-300))


def gram_by(df: DataFrame, columns: Sequence[str], by: str) -> dict:
    """The Gram of every group of ``by`` (a setting with few values, such as a fold), in one aggregation."""
    names, k = list(columns), len(columns)
    flat = df.where(F.col(f"`{by}`").isNotNull()).select(
        F.col(f"`{by}`").alias("_by"), *_doubles({f"_{i}": F.col(f"`{c}`") for i, c in enumerate(names)}))
    complete = F.expr(" and ".join(f"_{i} is not null and not isnan(_{i})" for i in range(k)))
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(f"_{i}").alias(f"m{i}") for i in range(k)]
    aggs += [F.covar_pop(f"_{i}", f"_{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
    return {r["_by"]: _as_gram(names, r) for r in flat.where(complete).groupBy("_by").agg(*aggs).collect()}


def merged(grams: Sequence[Gram]) -> Gram:
    """The Gram of all rows together."""
    n = sum(g.n for g in grams)
    mean = sum(g.n * g.mean for g in grams) / n
    cov = sum(g.n * (g.cov + np.outer(g.mean - mean, g.mean - mean)) for g in grams) / n
    return Gram(grams[0].names, n, mean, cov)


def crossval(df: DataFrame, features: Sequence[str], response: str, fold: str, into: str = "pred",
             **penalties) -> tuple[DataFrame, dict]:
    """Every row's prediction by a fit on the other folds, and the fits.

    One aggregation makes the sums of each fold; a fold's training sums are those of all others, so no
    row is copied or read again.  Rows of a null fold get no prediction.
    """
    by_fold = gram_by(df, [*features, response], fold)
    if len(by_fold) < 2:
        raise ValueError("cross-validation needs two folds at least")
    fits = {f: solve(merged([g for o, g in by_fold.items() if o != f]), features, response, **penalties) for f in sorted(by_fold)}
    pred = F.lit(None).cast("double")
    for f, fit in fits.items():
        pred = F.when(F.col(f"`{fold}`") == F.lit(f), linear_predictor(fit.coefs, fit.intercept)).otherwise(pred)
    return df.withColumn(into, pred), fits


def upright(H: np.ndarray) -> np.ndarray:
    """A symmetric matrix, near units, with all eigenvalues clearly positive."""
    values, vectors = np.linalg.eigh((H + H.T) / 2)
    return (vectors * np.maximum(np.abs(values), 1e-6)) @ vectors.T


def linear_predictor(coefs: dict[str, float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for name, b in coefs.items():
        out = out + F.col(f"`{name}`").cast("double") * F.lit(float(b))
    return out


@dataclass
class LinearFit:
    response: str
    coefs: dict[str, float]
    intercept: float
    sigma: float
    n: float
    r2: float
    loglik: float
    cov: np.ndarray = field(repr=False)
    fit_intercept: bool = True

    @property
    def names(self) -> list[str]:
        return (["intercept"] if self.fit_intercept else []) + list(self.coefs)

    def predict(self, df: DataFrame, into: str = "pred") -> DataFrame:
        return df.withColumn(into, linear_predictor(self.coefs, self.intercept))

    def parameter_table(self, df: DataFrame, level: float = 95.0) -> DataFrame:
        """Estimates with standard errors and bounds at ``level`` percent."""
        return parameter_table(df.sparkSession, self.names, self.estimates(), self.cov, level)

    def estimates(self) -> np.ndarray:
        head = [self.intercept] if self.fit_intercept else []
        return np.array(head + list(self.coefs.values()))


def parameter_table(spark, names, estimates, cov, level: float = 95.0) -> DataFrame:
    z = normal_quantile(0.5 + level / 200.0)
    se = np.sqrt(np.maximum(np.diag(cov), 0.0))
    rows = [(n, float(e), float(s), float(e - z * s), float(e + z * s))
            for n, e, s in zip(names, estimates, se)]
    return spark.createDataFrame(rows, "parameter string, estimate double, se double, lower double, upper double")


def solve(g: Gram, features: Sequence[str], response: str, intercept: bool = True,
          l2: float | dict[str, float] = 0.0, l1: float | dict[str, float] = 0.0) -> LinearFit:
    """Least squares from sufficient statistics, with optional penalties per feature.

    The objective is mean squared error / 2 + sum l2/2 b^2 + sum l1 |b| over features scaled to unit
    standard deviation; the intercept is free.
    """
    features = list(features)
    g = g.pick([*features, response])
    k = len(features)
    moments = g.cov if intercept else g.raw()
    A, c = moments[:k, :k], moments[:k, k]
    per = lambda p: np.array([p.get(f, 0.0) if isinstance(p, dict) else p for f in features], dtype=float)
    p2, p1 = per(l2), per(l1)
    if p1.any() or p2.any():
        sd = np.sqrt(np.maximum(np.diag(g.cov)[:k], 1e-300))
        b = _descend(A / np.outer(sd, sd), c / sd, p1, p2) / sd
    else:
        b = np.linalg.lstsq(A, c, rcond=1e-12)[0] if k else np.zeros(0)
    b0 = float(g.mean[k] - b @ g.mean[:k]) if intercept else 0.0
    mse = float(moments[k, k] - 2 * b @ c + b @ A @ b)
    mse = max(mse, 0.0)
    dof = max(g.n - k - intercept, 1.0)
    sigma2 = mse * g.n / dof
    X = np.block([[np.ones((1, 1)), g.mean[None, :k]], [g.mean[:k, None], g.raw()[:k, :k]]]) if intercept else A
    cov = np.linalg.pinv(X) * sigma2 / g.n
    var = float(g.cov[k, k])
    loglik = -0.5 * g.n * (math.log(2 * math.pi * mse) + 1) if mse > 0 else math.inf
    return LinearFit(response, dict(zip(features, map(float, b))), b0, math.sqrt(sigma2), g.n,
                     1 - mse / var if var > 0 else math.nan, loglik, cov, intercept)


def _descend(A, c, p1, p2, rounds: int = 10_000, tol: float = 1e-13) -> np.ndarray:
    """Coordinate descent for penalised least squares on a small Gram matrix."""
    b = np.zeros(len(c))
    for _ in range(rounds):
        moved = 0.0
        for i in range(len(c)):
            r = c[i] - A[i] @ b + A[i, i] * b[i]
            new = math.copysign(max(abs(r) - p1[i], 0.0), r) / (A[i, i] + p2[i])
            moved, b[i] = max(moved, abs(new - b[i])), new
        if moved < tol:
            break
    return b


def ols(df: DataFrame, features: Sequence[str], response: str, intercept: bool = True,
        weight: str | None = None, l2=0.0, l1=0.0) -> LinearFit:
    """Linear regression from sums of products, at any width."""
    return solve(gram(df, [*features, response], weight), features, response, intercept, l2, l1)


# ---------------------------------------------------------------- other families


@dataclass
class LinkFit:
    """Coefficients on the scale of the link."""

    family: str
    response: str
    classes: list
    coefs: list[dict[str, float]]
    intercepts: list[float]

    def predict(self, df: DataFrame, into: str = "pred") -> DataFrame:
        etas = [linear_predictor(b, b0) for b, b0 in zip(self.coefs, self.intercepts)]
        if self.family == "bernoulli":
            return df.withColumn(into, F.lit(1.0) / (F.lit(1.0) + F.exp(-etas[0])))
        if self.family == "categorical":
            best = F.array_position(F.array(*etas), F.array_max(F.array(*etas)))
            return df.withColumn(into, F.get(F.lit([str(c) for c in self.classes]), (best - 1).cast("int")))
        return df.withColumn(into, F.exp(etas[0]))

    def logits(self) -> list[Column]:
        return [linear_predictor(b, b0) for b, b0 in zip(self.coefs, self.intercepts)]


def category_codes(df: DataFrame, column: str) -> list:
    from echoframe.functions.transforms import levels

    return levels(df, column)


def category_index(column: str, classes: Sequence) -> Column:
    """Code of a category: its rank among the sorted categories; unseen ones give null."""
    pos = F.array_position(F.lit(list(classes)), F.col(column))
    return F.when(pos > 0, pos - 1).cast("int")


def fit_family(df: DataFrame, features: Sequence[str], response: str, family: str,
               l2: float = 0.0, tol: float = 1e-10, max_iter: int = 100) -> LinkFit:
    """Bernoulli and categorical responses by logistic regression, positive ones by a log link."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    features = list(features)
    assemble = VectorAssembler(inputCols=features, outputCol="_f", handleInvalid="skip")
    if family in ("bernoulli", "categorical"):
        classes = [0, 1] if family == "bernoulli" else category_codes(df, response)
        label = F.col(response).cast("double") if family == "bernoulli" else category_index(
            response, classes).cast("double")
        table = assemble.transform(df.withColumn("_y", label).where("_y is not null")).select("_f", "_y")
        m = LogisticRegression(featuresCol="_f", labelCol="_y", regParam=l2, tol=tol, maxIter=max_iter,
                               family="binomial" if family == "bernoulli" else "multinomial").fit(table)
        if family == "bernoulli":
            rows, heads = [m.coefficients], [m.intercept]
        else:
            rows, heads = m.coefficientMatrix.toArray(), m.interceptVector
        return LinkFit(family, response, list(classes),
                       [dict(zip(features, map(float, r))) for r in rows], [float(h) for h in heads])
    if family == "exponential":
        table = assemble.transform(df.where(F.col(response) > 0)).withColumn(
            "_y", F.col(response).cast("double")).select("_f", "_y")
        m = GeneralizedLinearRegression(family="gamma", link="log", featuresCol="_f", labelCol="_y",
                                        tol=tol, maxIter=max_iter, regParam=l2).fit(table)
        return LinkFit(family, response, [], [dict(zip(features, map(float, m.coefficients)))],
                       [float(m.intercept)])
    raise ValueError(f"no link for family {family!r}")


def distributional(df: DataFrame, features: Sequence[str], response: str,
                   scale_features: Sequence[str], rounds: int = 2) -> tuple[LinearFit, LinearFit]:
    """Mean and log-variance models in alternation, on the same feature table.

    Each round regresses log squared residuals on ``scale_features`` and refits the mean with inverse
    variances as weights.  Residuals of exactly zero are floored, not dropped.
    """
    mean = ols(df, features, response)
    scale = None
    for _ in range(rounds):
        resid = F.col(response).cast("double") - linear_predictor(mean.coefs, mean.intercept)
        table = df.withColumn("_logvar", F.log(F.greatest(resid * resid, F.lit(1e-12))))
        scale = ols(table, scale_features, "_logvar")
        # The mean of log chi-square with one degree of freedom is -1.2703628: undo that bias.
        w = F.exp(-(linear_predictor(scale.coefs, scale.intercept) + 1.2703628454614782))
        mean = ols(df.withColumn("_weight", w), features, response, weight="_weight")
    return mean, scale


# ---------------------------------------------------------------- grouping factors


@dataclass
class MixedFit:
    response: str
    fixed: dict[str, float]
    intercept: float
    sigma: float
    variance: np.ndarray
    random: list[str]
    effects: DataFrame
    level: str
    loglik_trace: list[float]
    converged: bool = True

    def predict(self, df: DataFrame, into: str = "pred") -> DataFrame:
        """Population prediction plus the level's deviations; an unseen level gets none."""
        names = [f"ranef_{r}" for r in self.random]
        joined = lookup_effects(df, self.effects, self.level, names)
        pred = linear_predictor(self.fixed, self.intercept)
        for name, col in zip(self.random, names):
            b = F.col(f"`{col}`")
            pred = pred + (b if name == "intercept" else b * F.col(f"`{name}`").cast("double"))
        return joined.select(*[F.col(f"`{c}`") for c in df.columns], pred.alias(into))


def lookup_effects(df: DataFrame, effects: DataFrame, level: str, names: Sequence[str]) -> DataFrame:
    """Attach the effects of each row's level, 0 where the level is unknown.

    A plain left join: the optimiser broadcasts a small level table and splits skewed levels.
    """
    eff = effects.select(F.col(level).alias("_level"), *[F.col(f"`{n}`") for n in names])
    joined = df.join(eff, df[level] == eff["_level"], "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns],
                         *[F.coalesce(F.col(f"`{n}`"), F.lit(0.0)).alias(n) for n in names])


def level_statistics(df: DataFrame, features: Sequence[str], response: str, level: str) -> DataFrame:
    """X'X, X'y, y'y and n per level, with an intercept column first; partial sums before the shuffle."""
    cols = [F.lit(1.0)] + [F.col(f"`{f}`").cast("double") for f in features]
    y = F.col(f"`{response}`").cast("double")
    k = len(cols)
    ok = F.col(level).isNotNull() & y.isNotNull() & ~F.isnan(y)
    for c in cols[1:]:
        ok = ok & c.isNotNull() & ~F.isnan(c)
    aggs = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    aggs += [F.sum(c * y).alias(f"b{i}") for i, c in enumerate(cols)]
    aggs += [F.sum(y * y).alias("yy"), F.count(F.lit(1)).cast("double").alias("n")]
    return df.where(ok).groupBy(level).agg(*aggs)


def _unpack(pdf: pd.DataFrame, k: int):
    A = np.empty((len(pdf), k, k))
    for i in range(k):
        for j in range(i, k):
            A[:, i, j] = A[:, j, i] = pdf[f"a{i}_{j}"].to_numpy()
    return A, pdf[[f"b{i}" for i in range(k)]].to_numpy(), pdf["yy"].to_numpy(), pdf["n"].to_numpy()


def _posterior(A, b, beta, D, s2, z):
    """Mean and covariance of each level's deviations given the current parameters."""
    Zz = A[:, z][:, :, z]
    M = np.linalg.inv(Zz / s2 + np.linalg.inv(D)[None])
    r = b[:, z] - np.einsum("lij,j->li", A[:, z], beta)
    return Zz, M, np.einsum("lij,lj->li", M, r) / s2


def mixed(df: DataFrame, features: Sequence[str], response: str, level: str,
          random: Sequence[str] = ("intercept",), correlated: bool = True, iterations: int = 600,
          tol: float = 1e-8) -> MixedFit:
    """Linear model with by-level intercepts and slopes, by accelerated expectation-maximisation.

    Two steps and the way they change give a longer one; where that lowers the likelihood the second
    step is taken instead.  Ends when the likelihood gains less than ``tol`` of itself; ``converged``
    tells, and a fit that runs out of ``iterations`` warns.

    Rows are reduced once to per-level sufficient statistics, which later passes read; each pass sends
    one small row of sums per task to the driver.  ``random`` names features or ``intercept``;
    ``correlated=False`` keeps the deviations independent.
    """
    names = ["intercept", *features]
    k, z = len(names), [names.index(r) for r in random]
    q = len(z)
    stats = checkpointed(level_statistics(df, features, response, level))
    first = stats.agg(*[F.sum(c).alias(c) for c in stats.columns if c != level],
                      F.count(F.lit(1)).cast("double").alias("levels")).toPandas()
    A, b, yy, n = _unpack(first, k)
    A, b, yy, n, n_levels = A[0], b[0], float(yy[0]), float(n[0]), float(first["levels"][0])
    # Every pass reads the statistics again: in as few tasks as they fill.
    stats = stats.coalesce(max(1, math.ceil(n_levels / LEVELS)))
    beta = np.linalg.lstsq(A, b, rcond=None)[0]
    s2 = max((yy - beta @ b) / n, 1e-12)
    D = np.eye(q) * s2 / 10
    trace: list[float] = []
    width = q * q + 1 + k * k + k + 1
    schema = ", ".join(f"v{i} double" for i in range(width))

    def partials(beta, D, s2):
        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(width)
            for pdf in batches:
                if not len(pdf):
                    continue
                A, b, yy, n = _unpack(pdf, k)
                Zz, M, u = _posterior(A, b, beta, D, s2, z)
                second = np.einsum("li,lj->ij", u, u) + M.sum(0)
                rss = (yy - 2 * b @ beta + np.einsum("i,lij,j->l", beta, A, beta)
                       - 2 * np.einsum("li,li->l", u, b[:, z] - np.einsum("lij,j->li", A[:, z], beta))
                       + np.einsum("li,lij,lj->l", u, Zz, u))
                rss_total = rss.sum() + np.einsum("lij,lji->", Zz, M)
                XZ = A[:, :, z]
                XVX = A / s2 - np.einsum("lip,lpq,ljq->lij", XZ, M, XZ) / s2**2
                XVy = b / s2 - np.einsum("lip,lpq,lq->li", XZ, M, b[:, z]) / s2**2
                r = b[:, z] - np.einsum("lij,j->li", A[:, z], beta)
                quad = (yy - 2 * b @ beta + np.einsum("i,lij,j->l", beta, A, beta)) / s2 - np.einsum(
                    "li,lij,lj->l", r, M, r) / s2**2
                logdet = n * math.log(s2) + np.linalg.slogdet(D)[1] - np.linalg.slogdet(M)[1]
                ll = -0.5 * (n * math.log(2 * math.pi) + logdet + quad).sum()
                total += np.concatenate([second.ravel(), [rss_total], XVX.sum(0).ravel(),
                                         XVy.sum(0), [ll]])
            yield pd.DataFrame([total], columns=[f"v{i}" for i in range(width)])

        return step

    def pack(beta, D, s2):
        return np.concatenate([beta, D.ravel(), [s2]])

    def unpack(v):
        return v[:k], v[k:k + q * q].reshape(q, q), float(v[-1])

    def em(v):
        """The likelihood at ``v`` and the parameters after one step from it."""
        beta, D, s2 = unpack(v)
        out = stats.mapInPandas(partials(beta, D, s2), schema)
        row = np.array(out.agg(*[F.sum(f"v{i}") for i in range(width)]).first(), dtype=float)
        second, rss, XVX, XVy, ll = np.split(row, np.cumsum([q * q, 1, k * k, k]))
        D = second.reshape(q, q) / n_levels
        D = (D if correlated else np.diag(np.diag(D))) + np.eye(q) * 1e-12
        beta = np.linalg.lstsq(XVX.reshape(k, k), XVy, rcond=None)[0]
        return float(ll[0]), pack(beta, D, max(float(rss[0]) / n, 1e-12))

    v, safe, used, converged = pack(beta, D, s2), None, 0, False
    while used < iterations and not converged:
        ll, one = em(v)
        if safe is not None and ll < trace[-1]:
            v = safe
            ll, one = em(v)
            used += 1
        converged = bool(trace) and abs(ll - trace[-1]) < tol * abs(ll)
        trace.append(ll)
        ll, two = em(one)
        trace.append(ll)
        used += 2
        r, change = one - v, (two - one) - (one - v)
        length = -max(1.0, np.linalg.norm(r) / max(np.linalg.norm(change), 1e-300))
        far = v - 2 * length * r + length**2 * change
        beta, D, s2 = unpack(far)
        inside = s2 > 0 and np.linalg.eigvalsh((D + D.T) / 2).min() > 0
        v, safe = (far if inside else two), two
    beta, D, s2 = unpack(safe)
    if not converged:
        warnings.warn(f"mixed model not converged after {used} passes", stacklevel=2)

    def effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            A, b, _, _ = _unpack(pdf, k)
            _, _, u = _posterior(A, b, beta, D, s2, z)
            yield pd.DataFrame({level: pdf[level], **{f"ranef_{r}": u[:, i] for i, r in enumerate(random)}})

    kind = stats.schema[level].dataType.simpleString()
    table = stats.mapInPandas(effects, ", ".join([f"`{level}` {kind}"] + [f"`ranef_{r}` double" for r in random]))
    return MixedFit(response, dict(zip(features, map(float, beta[1:]))), float(beta[0]), math.sqrt(s2), D,
                    list(random), table, level, trace, converged)


@dataclass
class CrossedFit:
    """Several grouping factors; each fit explains what the others leave over."""

    response: str
    fits: dict[str, MixedFit]

    @property
    def fixed(self) -> MixedFit:
        return list(self.fits.values())[-1]

    def predict(self, df: DataFrame, into: str = "pred") -> DataFrame:
        last = self.fixed
        out = last.predict(df, into)
        for level, f in self.fits.items():
            if f is not last:
                out = _with_offset(out, f, into, into)
        return out


def _with_offset(df: DataFrame, fit: MixedFit, base: str, into: str, sign: int = 1) -> DataFrame:
    """``base`` plus (or minus) the deviations of each row's level."""
    names = [f"ranef_{r}" for r in fit.random]
    joined = lookup_effects(df, fit.effects, fit.level, names)
    shift = F.lit(0.0)
    for r, n in zip(fit.random, names):
        shift = shift + (F.col(f"`{n}`") if r == "intercept" else F.col(f"`{n}`") * F.col(f"`{r}`").cast("double"))
    value = F.col(f"`{base}`").cast("double") + shift * sign
    kept = [F.col(f"`{c}`") for c in df.columns if c != into]
    return joined.select(*kept, value.alias(into))


def crossed(df: DataFrame, features: Sequence[str], response: str, random: dict[str, Sequence[str]],
            cycles: int = 3, **kw) -> CrossedFit:
    """Crossed grouping factors by backfitting: one factor at a time on the response less the others.

    Every cycle reads the rows once per factor; only per-level statistics are kept between.
    """
    fits: dict[str, MixedFit] = {}
    for _ in range(cycles if len(random) > 1 else 1):
        for level, names in random.items():
            rest = df.withColumn("_left", F.col(f"`{response}`").cast("double"))
            for other, f in fits.items():
                if other != level:
                    rest = _with_offset(rest, f, "_left", "_left", -1)
            fit = mixed(rest, features, "_left", level, names, **kw)
            fit.effects = checkpointed(fit.effects)
            fits.pop(level, None)
            fits[level] = fit
    return CrossedFit(response, fits)


# ---------------------------------------------------------------- kernel shapes


@dataclass
class KernelFit:
    kernels: dict[str, Kernel]
    fit: LinearFit
    trace: list[float]
    cov: np.ndarray | None = None
    params: list[tuple[str, str]] = field(default_factory=list)
    gradient: np.ndarray | None = None  # at the end, in units in which 1 is a clear slope
    converged: bool = True


def candidate_scores(windowed: DataFrame, window: str, response: str, value: str,
                     candidates: dict[str, Kernel], response_time: str = "time") -> DataFrame:
    """Fit quality of several kernels for one predictor, all in one pass over the windows."""
    feats = [weighted_sum(window, response_time, value, k).alias(f"_f{i}") for i, k in enumerate(candidates.values())]
    table = windowed.select(F.col(response).cast("double").alias("_y"), *feats)
    aggs = [
        F.struct(
            F.lit(n).alias("candidate"),
            F.regr_r2("_y", f"_f{i}").alias("r2"),
            F.regr_slope("_y", f"_f{i}").alias("slope"),
            F.regr_intercept("_y", f"_f{i}").alias("intercept"),
        )
        for i, n in enumerate(candidates)
    ]
    return table.agg(F.array(*aggs).alias("_a")).select(F.explode("_a").alias("_a")).select("_a.*")


def _free(kernel: Kernel, trainable: Sequence[str] | None) -> list[str]:
    return [p for p in kernel.params if trainable is None or p in trainable]


def to_free(kernel: Kernel, p: str, v: float) -> float:
    """Bounded parameters are searched on a log scale from their bound."""
    low, high = kernel.bounds.get(p, (None, None))
    if low is not None:
        return math.log(v - low)
    if high is not None:
        return math.log(high - v)
    return v


def from_free(kernel: Kernel, p: str, u: float) -> float:
    low, high = kernel.bounds.get(p, (None, None))
    u = min(max(u, -50.0), 50.0) if (low is not None or high is not None) else u
    if low is not None:
        return low + math.exp(u)
    if high is not None:
        return high - math.exp(u)
    return u


def fit_kernels(
    windowed: DataFrame,
    terms: Sequence[Conv],
    response: str,
    window: str = "_window",
    response_time: str = "time",
    others: Sequence[str] = (),
    irf_ids: dict[str, str] | None = None,
    trainable: dict[str, Sequence[str]] | None = None,
    iterations: int = 200,
    tol: float = 1e-10,
) -> KernelFit:
    """Kernel parameters and coefficients by damped Gauss-Newton on the windowed table.

    Coefficients are solved for at every step, so the search is over kernel parameters alone.  A step
    is one aggregation: the moments of the features and of their parameter derivatives at the trial
    point, which tell both whether to accept it and where to go next.  Terms that share an entry in
    ``irf_ids`` share parameters; ``trainable`` limits the free parameters of a term.
    """
    irf_ids, trainable = irf_ids or {}, trainable or {}
    owner = {t.name: irf_ids.get(t.name, t.name) for t in terms}
    kernels = {owner[t.name]: t.kernel for t in reversed(terms)}
    limits = {owner[t.name]: trainable[t.name] for t in terms if t.name in trainable}
    free = [(o, p) for o in kernels for p in _free(kernels[o], limits.get(o))]
    names = [t.name for t in terms]
    features = [*names, *others]
    data = windowed.where(F.col(f"`{response}`").isNotNull()).select(
        F.col(window).alias("_w"), F.col(response_time).cast("double").alias("_ty"),
        F.col(f"`{response}`").cast("double").alias("_resp"),
        *[F.col(f"`{o}`").cast("double") for o in others],
    ).persist(StorageLevel.MEMORY_AND_DISK)
    h = 1e-4

    def at(u: np.ndarray) -> dict[str, Kernel]:
        out = dict(kernels)
        for i, (o, p) in enumerate(free):
            out[o] = out[o].with_params(**{p: from_free(kernels[o], p, u[i])})
        return out

    def columns(u: np.ndarray) -> dict[str, Column]:
        ks = at(u)
        return {t.name: weighted_sum("_w", "_ty", t.value, ks[owner[t.name]]) for t in terms}

    def moments_at(u: np.ndarray) -> tuple[Gram, LinearFit, float]:
        exprs = columns(u)
        for i, (o, _) in enumerate(free):
            e = np.zeros(len(u))
            e[i] = h
            up, down = columns(u + e), columns(u - e)
            exprs |= {f"_d{i}_{t.name}": (up[t.name] - down[t.name]) / (2 * h)
                      for t in terms if owner[t.name] == o}
        g = gram(data, {**exprs, **{o: F.col(f"`{o}`") for o in others}, "_resp": F.col("_resp")})
        fit = solve(g, features, "_resp")
        return g, fit, fit.sigma**2 * max(fit.n - len(features) - 1, 1) / fit.n

    def normal_equations(g: Gram, fit: LinearFit) -> tuple[np.ndarray, np.ndarray]:
        """Curvature and gradient over coefficients, then kernel parameters."""
        J = np.zeros((len(free), len(g.names)))
        for i, (o, _) in enumerate(free):
            for t in terms:
                if owner[t.name] == o:
                    J[i, g.names.index(f"_d{i}_{t.name}")] = fit.coefs[t.name]
        resid = np.zeros(len(g.names))
        resid[g.names.index("_resp")] = 1.0
        for n, b in fit.coefs.items():
            resid[g.names.index(n)] -= b
        G = np.vstack([np.eye(len(g.names))[g.index(features)], J])
        return G @ g.cov @ G.T, G @ g.cov @ resid

    u = np.array([to_free(kernels[o], p, kernels[o].params[p]) for o, p in free])
    damping, converged = 1e-4, not free
    try:
        g, best, mse = moments_at(u)
        H, rhs = normal_equations(g, best)
        trace = [mse]
        for _ in range(iterations if free else 0):
            damped = H + damping * np.diag(np.diag(H)) + 1e-300 * np.eye(len(H))
            step = np.clip(np.linalg.lstsq(damped, rhs, rcond=1e-12)[0][len(features):], -2.0, 2.0)
            if np.abs(step).max() < math.sqrt(tol):
                converged = True
                break
            g2, fit2, mse2 = moments_at(u + step)
            if not mse2 < trace[-1]:
                damping *= 30
                # No shorter step lowers the error either: it is as low as it can be told.
                if damping > 1e12:
                    converged = True
                    break
                continue
            gain = (trace[-1] - mse2) / max(trace[-1], 1e-300)
            u, g, best, damping = u + step, g2, fit2, damping / 10
            H, rhs = normal_equations(g, best)
            trace.append(mse2)
            if gain < tol:
                converged = True
                break
    finally:
        data.unpersist()
    best.response = response
    cov = np.linalg.pinv(H) * trace[-1] / g.n
    final = at(u)
    if not converged and iterations:
        warnings.warn(f"kernels not converged after {iterations} steps", stacklevel=2)
    scale = np.sqrt(np.maximum(np.diag(H), 1e-300) * max(trace[-1], 1e-300))
    return KernelFit({t.name: final[owner[t.name]] for t in terms}, best, trace, cov, free, rhs / scale, converged)


def kernels_by_level(windowed: DataFrame, window: str, response: str, value: str, level: str,
                     candidates: dict[str, Kernel], response_time: str = "time") -> DataFrame:
    """By-level kernel shapes: the best of a grid for each level, in one aggregation."""
    feats = [weighted_sum(window, response_time, value, k).alias(f"_f{i}") for i, k in enumerate(candidates.values())]
    table = windowed.select(level, F.col(response).cast("double").alias("_y"), *feats)
    scored = table.groupBy(level).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.struct(F.coalesce(F.regr_r2("_y", f"_f{i}"), F.lit(-1.0)).alias("r2"),
                           F.lit(-i).alias("order"), F.lit(n).alias("candidate"),
                           F.regr_slope("_y", f"_f{i}").alias("slope"))
                  for i, n in enumerate(candidates)]).alias("_all"),
    )
    return scored.select(level, "n", F.array_max("_all").alias("_b")).select(
        level, "n", "_b.candidate", "_b.r2", "_b.slope")


# ---------------------------------------------------------------- bootstrap

# Cumulative probabilities of the Poisson distribution with mean 1.
POISSON_1 = (0.36787944117144233, 0.73575888234288467, 0.91969860292860584, 0.98101184312384626,
             0.99634015317265634, 0.99940581518241833, 0.99991675885071195, 0.99998980337503271)


def uniform_from(*key: Column) -> Column:
    """A uniform number fixed by its key, so a recomputed task draws the same one."""
    hexed = F.substring(F.md5(F.concat_ws(":", *[k.cast("string") for k in key])), 1, 8)
    return (F.conv(hexed, 16, 10).cast("double") + 0.5) / 4294967296.0


def bootstrap_grams(df: DataFrame, columns: Sequence[str], row_id: str, replicates: int,
                    seed: int = 0) -> DataFrame:
    """Poisson-weighted moments for each replicate: one row per replicate.

    Rows are unfolded into replicates inside the task and summed before the shuffle.
    """
    u = uniform_from(F.lit(seed), F.col(row_id), F.col("replicate"))
    weight = None
    for k, cut in enumerate(POISSON_1):
        weight = F.when(u < cut, float(k)) if weight is None else weight.when(u < cut, float(k))
    weight = weight.otherwise(float(len(POISSON_1)))
    cols = [F.col(f"`{c}`").cast("double") for c in columns]
    k = len(cols)
    unfolded = df.select(F.col(row_id), *[c.alias(f"_{i}") for i, c in enumerate(cols)],
                         F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    unfolded = unfolded.withColumn("_w", weight).where("_w > 0")
    w = F.col("_w")
    aggs = [F.sum(w).alias("n")] + [F.sum(w * F.col(f"_{i}")).alias(f"m{i}") for i in range(k)]
    aggs += [F.sum(w * F.col(f"_{i}") * F.col(f"_{j}")).alias(f"c{i}_{j}")
             for i in range(k) for j in range(i, k)]
    return unfolded.groupBy("replicate").agg(*aggs)


def bootstrap(df: DataFrame, features: Sequence[str], response: str, row_id: str,
              replicates: int = 100, seed: int = 0) -> DataFrame:
    """Coefficient samples: one row per replicate and parameter."""
    columns = [*features, response]
    k = len(columns)
    names = ["intercept", *features]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                r = r._asdict()
                mean = np.array([r[f"m{i}"] for i in range(k)]) / r["n"]
                second = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) / r["n"]
                f = solve(Gram(columns, r["n"], mean, second - np.outer(mean, mean)), features, response)
                out += [(r["replicate"], n, float(e)) for n, e in zip(names, f.estimates())]
            yield pd.DataFrame(out, columns=["replicate", "parameter", "estimate"])

    return bootstrap_grams(df, columns, row_id, replicates, seed).mapInPandas(
        fit, "replicate int, parameter string, estimate double")


def credible(samples: DataFrame, by: Sequence[str], value: str, level: float = 95.0) -> DataFrame:
    """Mean and quantile bounds of samples (linear interpolation between order statistics)."""
    tail = (100.0 - level) / 200.0
    return samples.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, tail).alias("lower"),
        F.percentile(value, 1.0 - tail).alias("upper"),
    )


def likelihood_ratio(loglik_small: float, loglik_large: float, df: int) -> tuple[float, float]:
    """Statistic and tail probability of a likelihood-ratio test."""
    stat = 2.0 * (loglik_large - loglik_small)
    return stat, chi2_sf(max(stat, 0.0), df)
