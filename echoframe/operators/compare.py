"""Scoring predictions and comparing models."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoframe.functions.special import erfc
from echoframe.operators.regress import gram
from echoframe.operators.series import prefix_min, running_count
from echoframe.session import checkpointed

# ---------------------------------------------------------------- metrics


def metrics(df: DataFrame, obs: str, pred: str, by: Sequence[str] = (), loglik: str | None = None) -> DataFrame:
    """n, mse, mae, percent of variance explained, Pearson r, and total log-likelihood."""
    y, p = F.col(obs).cast("double"), F.col(pred).cast("double")
    d = y - p
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg(d * d).alias("mse"),
        F.avg(F.abs(d)).alias("mae"),
        F.greatest(F.lit(0.0), (F.lit(1.0) - F.avg(d * d) / F.var_pop(y)) * 100).alias("pve"),
        F.corr(y, p).alias("r"),
    ]
    if loglik:
        aggs.append(F.sum(loglik).alias("loglik"))
    return df.where(y.isNotNull() & p.isNotNull()).groupBy(*by).agg(*aggs)


def f1(df: DataFrame, obs: str, pred: str) -> DataFrame:
    """Support-weighted and macro F1 of a discrete response, from per-class counts."""
    o, p = F.col(obs).cast("string"), F.col(pred).cast("string")
    per = (
        df.where(o.isNotNull() & p.isNotNull())
        .select(F.explode(F.array(
            F.struct(o.alias("cls"), F.lit(1).alias("actual"), F.lit(0).alias("said"),
                     F.when(o == p, 1).otherwise(0).alias("hit")),
            F.struct(p.alias("cls"), F.lit(0).alias("actual"), F.lit(1).alias("said"), F.lit(0).alias("hit")),
        )).alias("_c"))
        .groupBy("_c.cls")
        .agg(F.sum("_c.actual").alias("actual"), F.sum("_c.said").alias("said"), F.sum("_c.hit").alias("hit"))
        .withColumn("f1", F.col("hit") * 2.0 / (F.col("actual") + F.col("said")))
    )
    return per.agg(
        F.sum("actual").alias("n"),
        (F.sum("hit") / F.sum("actual")).alias("accuracy"),
        (F.sum(F.col("f1") * F.col("actual")) / F.sum("actual")).alias("f1_weighted"),
        F.avg(F.when(F.col("actual") > 0, F.col("f1"))).alias("f1_macro"),
    )


def common_models(tables: Sequence[DataFrame], model: str = "model") -> DataFrame:
    """Names present in every experiment."""
    out = tables[0].select(model)
    for t in tables[1:]:
        out = out.intersect(t.select(model))
    return out.distinct()


def correlations(df: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """Pearson r of every pair (a, b), all in one aggregation, kept within [-1, 1]."""
    pairs = [(a, b) for a in left for b in right]
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"),
                 F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr(f"`{a}`", f"`{b}`"))).alias("r"))
        for a, b in pairs
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.explode("_c").alias("_c")).select("_c.*")


def design_correlations(windowed: DataFrame, window: str, plain: Sequence[str],
                        pairwise: Sequence[str] = ()) -> DataFrame:
    """Correlations between predictors as a model sees them.

    Plain predictors are compared at the latest event of each window (0 where there is none);
    predictors defined per (response, event) pair are compared over all pairs, events of one clock
    being aligned by construction.  Centring there uses sums over pairs.
    """
    out = None
    if plain:
        last = windowed.select(*[
            F.coalesce(F.get(F.col(window), F.size(window) - 1)[p], F.lit(0.0)).alias(p) for p in plain])
        out = correlations(last, plain, plain)
    if pairwise:
        long = windowed.select(F.explode(window).alias("_e")).select("_e.*")
        both = [*plain, *pairwise]
        cells = correlations(long, both, both).where(
            F.col("a").isin(list(pairwise)) | F.col("b").isin(list(pairwise)))
        out = cells if out is None else out.unionByName(cells)
    return out


def elementwise_difference(df: DataFrame, a: str, b: str, obs: str | None = None, mode: str = "err",
                           into: str = "diff") -> DataFrame:
    """b - a per row; for ``corr`` the difference of products of standard scores with the observation."""
    if mode in ("err", "mse", "loss", "loglik"):
        return df.withColumn(into, F.col(b) - F.col(a))
    if mode != "corr" or obs is None:
        raise ValueError(f"unknown mode {mode!r} or missing observations")
    z = standard_scores(df, [a, b, obs])
    return df.withColumn(into, (z[b] - z[a]) * z[obs])


def standard_scores(df: DataFrame, names: Sequence[str]) -> dict[str, Column]:
    from echoframe.functions.transforms import moments

    m = moments(df, {n: F.col(n) for n in names})
    return {n: (F.col(n) - F.lit(m[n].mean)) / F.lit(m[n].sd) for n in names}


@dataclass
class Pca:
    names: list[str]
    mean: np.ndarray
    sd: np.ndarray
    vectors: np.ndarray
    values: np.ndarray

    def project(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        z = [(F.col(n) - F.lit(float(m))) / F.lit(float(s)) for n, m, s in zip(self.names, self.mean, self.sd)]
        cols = {}
        for k in range(self.vectors.shape[1]):
            total = F.lit(0.0)
            for c, v in zip(z, self.vectors[:, k]):
                total = total + c * F.lit(float(v))
            cols[f"{prefix}{k + 1}"] = total
        return df.withColumns(cols)


def pca(df: DataFrame, names: Sequence[str], n_dim: int | None = None) -> Pca:
    """Principal components of standardised columns: population sd for scaling, sample covariance.

    The sign of a component is fixed so that its largest loading is positive.
    """
    g = gram(df, names)
    sd = np.sqrt(np.diag(g.cov))
    c = g.cov / np.outer(sd, sd) * g.n / (g.n - 1)
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[top, range(vectors.shape[1])])
    return Pca(list(names), g.mean, sd, vectors[:, :n_dim], values)


# Acklam's rational approximation of the normal quantile, centre and tails.
QUANTILE_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
              1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
QUANTILE_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
              6.680131188771972e+01, -1.328068155288572e+01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
              -2.549732537343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
              3.754408661415906e+00, 1.0)


def _poly(coefs, x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + F.lit(c)
    return out


def with_normal_quantile(df: DataFrame, p: str, into: str) -> DataFrame:
    """Add the standard normal quantile of the probability in column ``p``.

    Staged in two projections so that the first approximation is computed once, not once per use.
    """
    q = F.col(p) - 0.5
    centre = _poly(QUANTILE_A, q * q) * q / _poly(QUANTILE_B, q * q)
    r = F.sqrt(F.log(F.least(F.col(p), F.lit(1.0) - F.col(p))) * -2.0)
    tail = _poly(QUANTILE_C, r) / _poly(QUANTILE_D, r)
    first = F.when(F.abs(q) <= 0.47575, centre).otherwise(F.when(q < 0, tail).otherwise(-tail))
    # One Newton-Halley step brings the approximation to double precision.
    x = F.col("_x")
    miss = (erfc(F.col("_z")) * 0.5 - F.col(p)) * math.sqrt(2 * math.pi) * F.exp(x * x * 0.5)
    staged = df.withColumn("_x", first).withColumn("_z", x / -math.sqrt(2.0)).withColumn("_miss", miss)
    return staged.withColumn(into, x - F.col("_miss") / (x * F.col("_miss") * 0.5 + 1.0)).drop(
        "_x", "_z", "_miss")


def quantile_table(df: DataFrame, error: str, mean: float | None = None, sd: float | None = None,
                   **layout) -> DataFrame:
    """Sorted errors beside the quantiles a normal error of the same mean and sd would have."""
    from echoframe.functions.transforms import moments

    values = df.where(F.col(error).isNotNull()).select(F.col(error).cast("double").alias("empirical"))
    if mean is None or sd is None:
        m = moments(values, {"e": F.col("empirical")}, population=True)["e"]
        mean, sd = m.mean, m.sd
    n = values.count()
    ranked = running_count(values, [], ["empirical"], name="rank", **layout)
    ranked = with_normal_quantile(ranked.withColumn("_p", (F.col("rank") - 0.5) / n), "_p", "_q")
    return ranked.select(F.col("rank").cast("long").alias("rank"), "empirical",
                         (F.col("_q") * sd + mean).alias("theoretical"))


# ---------------------------------------------------------------- significance

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(z: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: random bits that depend on the key alone."""
    z = (z ^ (z >> np.uint64(30))) * _MIX1
    z = (z ^ (z >> np.uint64(27))) * _MIX2
    return z ^ (z >> np.uint64(31))


@dataclass
class PermutationResult:
    p: float
    a: float
    b: float
    diff: float
    n: int
    diffs: DataFrame | None


#: Iterations of a pair whose signs are unpacked at a time: a multiple of 64.
BLOCK = 1024


def permutation_sums(df: DataFrame, a: Sequence[str], b: Sequence[str], row_id: str,
                     n_iter: int, seed: int = 0) -> DataFrame:
    """Column sums after shuffling the cells of every row, for each of ``n_iter`` shuffles.

    Tasks keep running sums, one row per (iteration, column), and unpack the signs of a block of iterations for a
    stretch of rows at a time, so nothing of size rows x iterations exists anywhere.  The shuffle of a row is a function of its id, the iteration and the seed.
    """
    cells = [f"_c{i}" for i in range(len(a) + len(b))]
    c = len(cells)
    pair = c == 2

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((n_iter, c))
        for pdf in batches:
            v = pdf[cells].to_numpy(dtype=float)
            with np.errstate(over="ignore"):
                key = pdf["_key"].to_numpy().astype(np.uint64) + np.uint64(seed) * _MIX2
                for at in range(0, len(v), 2048):
                    rows, ids = v[at: at + 2048], key[at: at + 2048]
                    if pair:
                        # Signs are one bit each until a block of them is summed.
                        for low in range(0, n_iter, BLOCK):
                            high = min(low + BLOCK, n_iter)
                            words = np.arange(low // 64 + 1, -(-high // 64) + 1, dtype=np.uint64) * _GOLDEN
                            bits = _mix(ids[:, None] + words[None, :])
                            flip = np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :high - low]
                            moved = (rows[:, 1] - rows[:, 0]) @ flip.astype(float)
                            sums[low:high, 0] += rows[:, 0].sum() + moved
                            sums[low:high, 1] += rows[:, 1].sum() - moved
                    else:
                        slots = np.arange(1, c + 1, dtype=np.uint64) * _GOLDEN
                        for it in range(n_iter):
                            order = _mix(_mix(ids + np.uint64(it + 1) * _MIX1)[:, None] + slots[None, :])
                            shuffled = np.take_along_axis(rows, order.argsort(axis=1, kind="stable"), axis=1)
                            sums[it] += shuffled.sum(axis=0)
        yield pd.DataFrame({
            "iteration": np.repeat(np.arange(n_iter), c), "slot": np.tile(np.arange(c), n_iter),
            "total": sums.ravel(),
        })

    keyed = df.select(*[F.col(f"`{x}`").cast("double").alias(n) for x, n in zip([*a, *b], cells)], row_key(df, row_id).alias("_key"))
    return (
        keyed.mapInPandas(step, "iteration int, slot int, total double")
        .groupBy("iteration", "slot").agg(F.sum("total").alias("total"))
    )


def row_key(df: DataFrame, row_id: str) -> Column:
    """A whole number that names a row: the id itself, or a hash of an id that is none."""
    return F.col(row_id).cast("long") if whole(df, row_id) else F.xxhash64(F.col(row_id))


def whole(df: DataFrame, column: str) -> bool:
    return df.schema[column].dataType.typeName() in ("byte", "short", "integer", "long")


_ENSEMBLE = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}


def permutation_test(df: DataFrame, a: Sequence[str] | str, b: Sequence[str] | str, row_id: str,
                     n_iter: int = 10_000, n_tails: int = 2, mode: str = "mse", agg: str = "mean",
                     nested: bool = False, seed: int = 0) -> PermutationResult:
    """Paired permutation test of the columns of two models (several columns each for ensembles).

    ``mse`` compares means, ``loglik`` sums, ``corr`` sums over n - 1.  Where ``nested`` and the second
    (larger) model is no better, p is 1 without resampling.
    """
    a, b = ([a] if isinstance(a, str) else list(a)), ([b] if isinstance(b, str) else list(b))
    if mode not in ("mse", "loglik", "corr") or n_tails not in (1, 2):
        raise ValueError(f"unknown mode {mode!r} or tails {n_tails!r}")
    columns = list(dict.fromkeys([*a, *b]))
    # A number or two for each row, written once: what made them is not run again for the resampling.
    df = checkpointed(df.select(F.col(f"`{row_id}`"), *[F.col(f"`{c}`") for c in columns if c != row_id]))
    row = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(f"`{c}`").cast("double")).alias(c) for c in columns]).first()
    n = row["_n"]
    scale = {"mse": n, "loglik": 1, "corr": n - 1}[mode]
    fold = getattr(np, agg)
    perf_a, perf_b = (float(fold([row[c] for c in cols])) / scale for cols in (a, b))
    diff = perf_a - perf_b
    settled = diff == 0 or (nested and (diff <= 0 if mode == "mse" else diff >= 0))
    if settled:
        return PermutationResult(1.0, perf_a, perf_b, diff, n, None)
    # The sums are few; written once, the resampling is not repeated by what reads them.
    sums = checkpointed(permutation_sums(df, a, b, row_id, n_iter, seed))
    first, fn = F.col("slot") < len(a), _ENSEMBLE[agg]
    diffs = sums.groupBy("iteration").agg(
        ((fn(F.when(first, F.col("total"))) - fn(F.when(~first, F.col("total")))) / scale).alias("diff"))
    if n_tails == 2:
        hit = F.abs("diff") > abs(diff)
    else:
        hit = F.col("diff") <= diff if diff < 0 else F.col("diff") >= diff
    hits = diffs.agg(F.sum(F.when(hit, 1).otherwise(0))).first()[0]
    return PermutationResult((hits + 1) / (n_iter + 1), perf_a, perf_b, diff, n, diffs)


def pooled_scores(experiments: dict[str, DataFrame], a: str, b: str, row_id: str, mode: str = "mse",
                  obs: str | None = None) -> DataFrame:
    """Rows of several experiments on one scale, ready for :func:`permutation_test`.

    For ``mse`` both columns are divided by the joint population sd of the two within the experiment;
    for ``corr`` predictions become products of standard scores.  Row ids are made unique: whole ones by a place
    for each experiment, others by a hash.
    """
    out = None
    for i, (name, df) in enumerate(experiments.items()):
        if mode == "mse":
            both = df.select(F.explode(F.array(F.col(a).cast("double"), F.col(b).cast("double"))).alias("v"))
            sd = both.agg(F.stddev_pop("v")).first()[0]
            cols = {c: F.col(c) / F.lit(sd) for c in (a, b)}
        elif mode == "corr":
            z = standard_scores(df, [a, b, obs])
            cols = {c: z[c] * z[obs] for c in (a, b)}
        else:
            cols = {c: F.col(c) for c in (a, b)}
        part = df.select(
            F.lit(name).alias("experiment"),
            (F.col(row_id).cast("long") * len(experiments) + i if whole(df, row_id) else F.xxhash64(F.lit(name), F.col(row_id))).alias("_row"),
            *[c.cast("double").alias(n) for n, c in cols.items()])
        out = part if out is None else out.unionByName(part)
    return out


def correlation_test(df: DataFrame, obs: str, first: str, second: str, nested: bool = False) -> DataFrame:
    """Difference of two dependent correlations with the observations (Steiger's Z), as one row."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.corr(obs, first).alias("r1"),
                 F.corr(obs, second).alias("r2"), F.corr(first, second).alias("rx"))
    r1, r2, rx, n = F.col("r1"), F.col("r2"), F.col("rx"), F.col("n")
    mean_sq = (r1 * r1 + r2 * r2) / 2
    f = (F.lit(1.0) - rx) / ((F.lit(1.0) - mean_sq) * 2)
    h = (F.lit(1.0) - f * mean_sq) / (F.lit(1.0) - mean_sq)
    z = (F.atanh(r1) - F.atanh(r2)) * F.sqrt((n - 3) / ((F.lit(1.0) - rx) * 2 * h))
    p = erfc(F.abs(z) / math.sqrt(2.0))
    if nested:
        settled = r1 >= r2
        z = F.when(settled, 0.0).otherwise(z)
        p = F.when(settled, 1.0).otherwise(p)
    return row.select("n", "r1", "r2", "rx", (r1 - r2).alias("rdiff"), z.alias("z"), p.alias("p"))


def adjust_p(df: DataFrame, p: str = "p", by: Sequence[str] = (), into: str = "p_adjusted", **layout) -> DataFrame:
    """Benjamini-Yekutieli adjustment within each family (valid under any dependence).

    Ranks and the running minimum from the largest p downwards are both distributed prefix operations,
    so a family may be of any size.
    """
    cols, by = list(df.columns), list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    ranked = running_count(df, by, [p], name="_k", **layout)
    if by:
        ranked = ranked.join(sizes, by)
    else:
        ranked = ranked.withColumn("_m", F.lit(sizes.first()[0]))
    m = F.col("_m").cast("double")
    # Harmonic number: summed while short, by its asymptotic expansion (error below 1e-16) when long.
    summed = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_m"), F.lit(1000)).cast("int")), F.lit(0.0),
                         lambda s, k: s + F.lit(1.0) / k)
    expanded = F.log(m) + 0.5772156649015329 + F.lit(0.5) / m - F.lit(1.0 / 12) / (m * m)
    harmonic = F.when(F.col("_m") <= 1000, summed).otherwise(expanded)
    raw = ranked.select(*cols, (F.col(p) * m * harmonic / F.col("_k")).alias("_raw"), (-F.col("_k")).alias("_down"))
    out = prefix_min(raw, by, ["_down"], "_raw", "_low", **layout)
    return out.select(*cols, F.least(F.lit(1.0), F.col("_low")).alias(into))


def comparison_table(df: DataFrame) -> DataFrame:
    """Comparisons by (response, partition): rounded improvement (negated difference) and p."""
    cells = df.withColumn("_cell", F.concat_ws("_", "response", "partition")).withColumn(
        "_v", F.struct(F.round(-F.col("diff")).cast("long").alias("diff"), F.col("p").alias("p")))
    return cells.groupBy("comparison").pivot("_cell").agg(F.first("_v"))


# ---------------------------------------------------------------- collation


def collate(results: DataFrame, metric: str = "mse", agg: str = "median", collapse: bool = False,
            partitions: Sequence[str] = ("train", "dev", "test")) -> DataFrame:
    """System x task scores per partition from one row per trained model and partition.

    ``results``: task, system, fold, ensemble, partition, value, converged (0/1).  Folds are summed for
    log-likelihoods and averaged otherwise, within an ensemble member; members are then combined by
    ``agg``.  ``collapse`` first sums over tasks.
    """
    keys = ["system"] if collapse else ["task", "system"]
    rows = results
    if collapse:
        rows = rows.groupBy("system", "fold", "ensemble", "partition").agg(
            F.sum("value").alias("value"), F.avg(F.col("converged").cast("double")).alias("converged"))
    over_folds = F.sum("value") if metric.lower() in ("loglik", "ll") else F.avg("value")
    member = rows.groupBy(*keys, "ensemble", "partition").agg(
        over_folds.alias("value"), F.avg(F.col("converged").cast("double")).alias("converged"))
    combined = member.groupBy(*keys, "partition").agg(
        _ENSEMBLE[agg]("value").alias("value"), F.avg("converged").alias("converged"))
    return combined.groupBy(*keys).pivot("partition", list(partitions)).agg(
        F.first("value").alias("value"), F.first("converged").alias("converged"))


def select_models(df: DataFrame, patterns: Sequence[str] = (), model: str = "model",
                  exclude_baselines: bool = False) -> DataFrame:
    """Models whose whole name matches a pattern, tagged with the first pattern that did (``order``)."""
    c = F.col(model)
    if exclude_baselines:
        df = df.where(~c.rlike("^(LM|GAM)"))
    if not patterns:
        return df.withColumn("order", F.lit(0))
    order = None
    for i, p in enumerate(patterns):
        hit = (c == p) | c.rlike(f"^(?:{p})$")
        order = F.when(hit, i) if order is None else order.when(hit, i)
    return df.withColumn("order", order).where("order is not null")


