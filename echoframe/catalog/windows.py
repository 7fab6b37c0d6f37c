"""Window joins and convolutions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from echoframe.catalog.base import (
    EV,
    conv_sql,
    events,
    inputs,
    orders_series,
    pairs_sql,
    query,
    rounded,
    table,
)
from echoframe.functions import kernels as K
from echoframe.operators.convolve import Conv, Source, convolve, convolve_exponential
from echoframe.operators.convolve import convolve_many as many
from echoframe.operators.similarity import similarity_pairs
from echoframe.operators.windows import pairs, window_arrays, window_counts

SERIES = ["user_id"]
TIE = ["event_id"]


def _pair_table(X, Y, **kw):
    X = X.withColumn("x_id", F.col("event_id"))
    w = window_arrays(X, Y, kw.pop("series", SERIES), ["x_id"], tie=TIE, **kw)
    return rounded(pairs(w).select("event_id", "x_id", F.col("t_delta").alias("d")))


@query(f"WITH {EV}, {pairs_sql(8)} SELECT event_id, x_id, round(d, 6) AS d FROM q")
def window_history(spark, sf):
    return _pair_table(*inputs(spark, sf), history=8)


@query(f"WITH {EV}, {pairs_sql(8, 72.0)} SELECT event_id, x_id, round(d, 6) AS d FROM q")
def window_cutoff(spark, sf):
    return _pair_table(*inputs(spark, sf), history=8, cutoff=72.0)


@query(f"WITH {EV}, {pairs_sql(8, strict=True)} SELECT event_id, x_id, round(d, 6) AS d FROM q")
def window_strictly_before(spark, sf):
    return _pair_table(*inputs(spark, sf), history=8, inclusive=False)


# One series holding every row: the block layout, whatever the table's size.
_LAST = """n AS (SELECT count(*) AS n FROM x),
r AS (SELECT event_id AS x_id, time AS x_time, row_number() OVER (ORDER BY time, event_id) AS rn FROM x),
c AS (SELECT y.event_id, y.time AS y_time, r.rn AS hi FROM y ASOF JOIN r ON y.time + 1.1920929e-07 >= r.x_time)"""


@query(f"""WITH {EV}, {_LAST}
SELECT c.event_id, r.x_id, round(y_time - x_time, 6) AS d FROM c JOIN r ON r.rn > hi - 8 AND r.rn <= hi""")
def window_one_series(spark, sf):
    return _pair_table(*inputs(spark, sf), series=[], history=8, layout="blocks")


_FUTURE = """f AS (SELECT * FROM (
  SELECT y.event_id, x.event_id AS x_id, y.time - x.time AS d,
    row_number() OVER (PARTITION BY y.event_id ORDER BY x.time, x.event_id) AS ahead
  FROM y JOIN x ON x.user_id = y.user_id AND x.time >= y.time - 1.1920929e-07) WHERE ahead <= 4)"""


@query(f"WITH {EV}, {_FUTURE} SELECT event_id, x_id, round(d, 6) AS d FROM f")
def future_window(spark, sf):
    return _pair_table(*inputs(spark, sf), history=0, future=4)


@query(f"""WITH {EV}, {pairs_sql(6)}, {_FUTURE}
SELECT event_id, x_id, round(d, 6) AS d FROM (
  SELECT event_id, x_id, d FROM q UNION SELECT event_id, x_id, d FROM f)""")
def combined_window(spark, sf):
    return _pair_table(*inputs(spark, sf), history=6, future=4)


# Orders on a daily clock: many events of a customer share a day, so windows hold ties.
_DAILY = """o AS (SELECT *, floor(epoch_us(o_orderdate) / 86400000000) AS time FROM orders),
p AS (SELECT * FROM (SELECT y.o_orderkey, x.o_orderkey AS x_key, y.time - x.time AS d, x.o_totalprice AS v,
    row_number() OVER (PARTITION BY y.o_orderkey ORDER BY x.time DESC, x.o_orderkey DESC) AS back
  FROM o y JOIN o x ON x.o_custkey = y.o_custkey AND x.time <= y.time + 1.1920929e-07
  WHERE y.o_orderstatus = 'F') WHERE back <= 5)"""


@query(f"WITH {_DAILY} SELECT o_orderkey, x_key, d FROM p")
def window_ties(spark, sf):
    o = orders_series(spark, sf)
    X = o.select("o_custkey", "time", F.col("o_orderkey").alias("x_key"))
    Y = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "time")
    w = window_arrays(X, Y, ["o_custkey"], ["x_key"], history=5, tie=["x_key"])
    return pairs(w).select("o_orderkey", "x_key", F.col("t_delta").alias("d"))


@query(f"""WITH {EV}, c AS (
  SELECT y.event_id, count(x.event_id) AS n_before,
    count(CASE WHEN x.time >= y.time - 72.0 THEN 1 END) AS n_within
  FROM y LEFT JOIN x ON x.user_id = y.user_id AND x.time <= y.time + 1.1920929e-07 GROUP BY y.event_id)
SELECT event_id, n_before, n_within FROM c""")
def window_event_counts(spark, sf):
    X, Y = inputs(spark, sf)
    return window_counts(X, Y, SERIES, 72.0).select("event_id", "n_before", "n_within")


def _conv(spark, sf, kernel, history=8, cutoff=None, name="conv", **kw):
    X, Y = inputs(spark, sf)
    src = Source(X, [Conv(name, "value", kernel)], tie=TIE)
    return rounded(convolve(Y, [src], SERIES, history, cutoff=cutoff, **kw).select("event_id", name))


@query(conv_sql("0.05 * exp(-0.05 * d) * v"))
def convolve_exp(spark, sf):
    return _conv(spark, sf, K.Exp(0.05))


@query(conv_sql("0.05 * exp(-0.05 * d) * v", 128, 168.0))
def convolve_exp_long(spark, sf):
    return _conv(spark, sf, K.Exp(0.05), history=128, cutoff=168.0)


@query(conv_sql("1.5 * exp(-1.5 * d) / (1 - exp(-1.5 * 72.0) + 4 * 1.1920928955078125e-07) * v"))
def convolve_exp_rate_gt1(spark, sf):
    return _conv(spark, sf, K.ExpRateGT1(1.5, support_ub=72.0))


@query(conv_sql("0.05 * exp(-0.05 * d) * v", strict=True))
def convolve_exp_strict(spark, sf):
    return _conv(spark, sf, K.Exp(0.05), inclusive=False)


@query(f"""WITH {EV} SELECT y.event_id, round(coalesce(sum(0.02 * exp(-0.02 * (y.time - x.time)) * x.value), 0), 6) AS conv
FROM y LEFT JOIN x ON x.user_id = y.user_id AND x.time <= y.time + 1.1920929e-07 GROUP BY y.event_id""")
def convolve_exp_unclipped(spark, sf):
    X, Y = inputs(spark, sf)
    return rounded(convolve_exponential(Y, X, SERIES, "value", 0.02, "conv").select("event_id", "conv"))


_D = "(greatest(d, 0) + 4 * 1.1920928955078125e-07)"


def _gamma(a, b, x):
    return f"exp({a} * ln({b}) - lgamma({a}) + ({a} - 1) * ln({x}) - {b} * {x})"


@query(conv_sql(f"{_gamma(2.0, 0.1, _D)} * v"))
def convolve_gamma(spark, sf):
    return _conv(spark, sf, K.Gamma(2.0, 0.1))


@query(conv_sql(f"{_gamma(1.5, 0.2, _D)} * v"))
def convolve_gamma_shape_gt1(spark, sf):
    return _conv(spark, sf, K.GammaShapeGT1(1.5, 0.2))


@query(conv_sql(f"{_gamma(6.0, 1.0, _D)} * v"))
def convolve_hrf_single(spark, sf):
    return _conv(spark, sf, K.HRFSingleGamma())


# cdf of Gamma(2, b) is 1 - exp(-b x)(1 + b x), so the normaliser has a closed form.
@query(conv_sql(
    f"{_gamma(2.0, 0.1, '(greatest(d, 0) + 3.0)')} / (exp(-0.3) * 1.3 + 4 * 1.1920928955078125e-07) * v"))
def convolve_shifted_gamma(spark, sf):
    return _conv(spark, sf, K.ShiftedGamma(2.0, 0.1, -3.0))


@query(conv_sql(
    f"{_gamma(2.0, 0.5, '(greatest(d, 0) + 1.0)')} / (exp(-0.5) * 1.5 + 4 * 1.1920928955078125e-07) * v"))
def convolve_shifted_gamma_shape_gt1(spark, sf):
    return _conv(spark, sf, K.ShiftedGammaShapeGT1(2.0, 0.5, -1.0))


_NORM = 1 - 0.5 * math.erfc(12 / 24 / math.sqrt(2))


@query(conv_sql(f"exp(-0.5 * ((d - 12.0) / 24.0) ** 2) / (24.0 * sqrt(2 * pi())) / ({_NORM!r} + 4 * 1.1920928955078125e-07) * v"))
def convolve_normal(spark, sf):
    return _conv(spark, sf, K.Normal(12.0, 24.0))


# Phi(z) from its power series, independent of the rational approximation the engine uses:
# sum of |z|^(2k+1) / (1 3 5 ... (2k+1)), the odd factorial being 2^(k+1) Gamma(k + 3/2) / Gamma(1/2).
def _phi(z: str) -> str:
    term = (f"exp((2 * k + 1) * ln(abs({z}) + 1e-300) - (lgamma(k + 1.5) - lgamma(0.5) + (k + 1) * ln(2.0)))")
    return (f"(0.5 + sign({z}) * exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) "
            f"* list_sum(list_transform(range(0, 120), lambda k: {term})))")


# The mass above 0 by Simpson's rule, as the kernel's own sum is a trapezoid.
_SKEW = f"""(SELECT list_sum(list_transform(range(0, 4001), lambda i: CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
  * exp(-0.5 * ((i * 0.066 - 12.0) / 24.0) ** 2) / sqrt(2 * pi()) / 12.0 * {_phi('greatest(-8, least(8, 2.0 * (i * 0.066 - 12.0) / 24.0))')})) * 0.066 / 3 + 4 * 1.1920928955078125e-07)"""


@query(conv_sql(f"2 / 24.0 * exp(-0.5 * ((d - 12.0) / 24.0) ** 2) / sqrt(2 * pi()) * "
                f"{_phi('greatest(-8, least(8, 2.0 * (d - 12.0) / 24.0))')} / {_SKEW} * v"))
def convolve_skew_normal(spark, sf):
    return _conv(spark, sf, K.SkewNormal(12.0, 24.0, 2.0))


# One minus the distribution function at 0: Phi(u) - exp(v^2 / 2 - v u) Phi(u - v), u = -6 / 4, v = 0.1 * 4.
_EMG = f"(1 - {_phi('(-1.5)')} + exp(0.08 + 0.6) * {_phi('(-1.9)')} + 4 * 1.1920928955078125e-07)"


@query(conv_sql(f"0.1 * exp(-0.1 * (d - 6.0 - 0.5 * 0.1 * 16.0)) * "
                f"{_phi('greatest(-8, least(8, (d - 6.0 - 0.1 * 16.0) / 4.0))')} / {_EMG} * v"))
def convolve_emg(spark, sf):
    return _conv(spark, sf, K.EMG(6.0, 4.0, 0.1))


_LB = "(lgamma(1.5) + lgamma(2.0) - lgamma(3.5))"


@query(conv_sql(f"exp(0.5 * ln({_D}) - 3.5 * ln(1 + {_D}) - {_LB}) * v"))
def convolve_beta_prime(spark, sf):
    return _conv(spark, sf, K.BetaPrime(1.5, 2.0))


# With beta = 1 the beta-prime distribution function is (x / (1 + x))^alpha.
@query(conv_sql("2.0 * (greatest(d, 0) + 0.5) / (1.5 + greatest(d, 0)) ** 3 "
                "/ (1 - (0.5 / 1.5) ** 2 + 4 * 1.1920928955078125e-07) * v"))
def convolve_shifted_beta_prime(spark, sf):
    return _conv(spark, sf, K.ShiftedBetaPrime(2.0, 1.0, -0.5))


def _hrf(a1, a2, b1, b2, c):
    return (f"({_gamma(a1, b1, _D)} - {c!r} * {_gamma(a2, b2, _D)}) / (1 - {c!r} + 4 * 1.1920928955078125e-07) * v")


_HRF = {
    "convolve_hrf1": (K.HRFDoubleGamma1(beta=0.3), (6.0, 16.0, 0.3, 0.3, 1 / 6)),
    "convolve_hrf2": (K.HRFDoubleGamma2(4.0, 0.2), (4.0, 14.0, 0.2, 0.2, 1 / 6)),
    "convolve_hrf3": (K.HRFDoubleGamma3(c=0.25, alpha=4.0, beta=0.2), (4.0, 14.0, 0.2, 0.2, 0.25)),
    "convolve_hrf4": (K.HRFDoubleGamma4(5.0, 12.0, c=0.2, beta=0.25), (5.0, 12.0, 0.25, 0.25, 0.2)),
    "convolve_hrf5": (K.HRFDoubleGamma5(5.0, 12.0, 0.3, 0.2, 0.2), (5.0, 12.0, 0.3, 0.2, 0.2)),
}
for _name, (_kernel, _args) in _HRF.items():
    query(conv_sql(_hrf(*_args)), name=_name)(lambda spark, sf, k=_kernel: _conv(spark, sf, k))


_CENTRES = (0.0, 12.0, 24.0, 36.0)
_AMPS = (0.4, 0.3, 0.2, 0.1)
_S = 12.0
_LCG_NORM = sum(v * (1 - 0.5 * math.erfc(c / (_S + K.EPSILON) / math.sqrt(2))) for c, v in zip(_CENTRES, _AMPS))


@query(conv_sql("(" + " + ".join(
    f"{v} * exp(-0.5 * ((d - {c}) / {_S + K.EPSILON!r}) ** 2) / ({_S + K.EPSILON!r} * sqrt(2 * pi()))"
    for c, v in zip(_CENTRES, _AMPS)) + f") / ({_LCG_NORM!r} + 4 * 1.1920928955078125e-07) * v"))
def convolve_lcg(spark, sf):
    return _conv(spark, sf, K.LCG(_CENTRES, (_S,) * 4, _AMPS))


# Composing two exponentials on a grid of step s is a geometric sum:
# s a b e^(-b k s) (1 - q^(k+1)) / (1 - q) at grid point k, with q = e^(-(a - b) s); between points, linear.
_STEP = 80.0 / 399


def _composed(k: str) -> str:
    q = f"exp(-(0.05 - 0.2) * {_STEP!r})"
    return f"({_STEP!r} * 0.05 * 0.2 * exp(-0.2 * ({k}) * {_STEP!r}) * (1 - {q} ** (({k}) + 1)) / (1 - {q}))"


_K = f"floor(greatest(d, 0) / {_STEP!r})"


@query(conv_sql(f"({_composed(_K)} + ({_composed(_K + ' + 1')} - {_composed(_K)}) * (greatest(d, 0) / {_STEP!r} - {_K})) * v",
                8, 72.0))
def convolve_composed(spark, sf):
    return _conv(spark, sf, K.Composed(first=K.Exp(0.05), second=K.Exp(0.2), reach=80.0, n_interp=400), cutoff=72.0)


# A shared second event table with its own window: signups beside clicks and views.
@query(f"""WITH {EV}, x2 AS (SELECT * FROM ev WHERE event_type = 'signup'), {pairs_sql(8)},
p2 AS (SELECT * FROM (SELECT y.event_id, y.time - x2.time AS d, x2.value AS v,
    row_number() OVER (PARTITION BY y.event_id ORDER BY x2.time DESC, x2.event_id DESC) AS back
  FROM y JOIN x2 ON x2.user_id = y.user_id AND x2.time <= y.time + 1.1920929e-07) WHERE back <= 8),
a AS (SELECT event_id, sum(0.05 * exp(-0.05 * d) * v) AS f, sum({_gamma(2.0, 0.1, _D)}) AS r FROM q GROUP BY event_id),
b AS (SELECT event_id, sum(0.1 * exp(-0.1 * d) * v) AS f FROM p2 GROUP BY event_id)
SELECT y.event_id, round(coalesce(a.f, 0), 6) AS browse, round(coalesce(a.r, 0), 6) AS rate,
  round(coalesce(b.f, 0), 6) AS signup
FROM y LEFT JOIN a ON y.event_id = a.event_id LEFT JOIN b ON y.event_id = b.event_id""")
def convolve_two_sources(spark, sf):
    X, Y = inputs(spark, sf)
    X = X.withColumn("rate", F.lit(1.0))
    X2 = events(spark, sf).where("event_type = 'signup'")
    sources = [
        Source(X, [Conv("browse", "value", K.Exp(0.05)), Conv("rate", "rate", K.Gamma(2.0, 0.1))], tie=TIE),
        Source(X2, [Conv("signup", "value", K.Exp(0.1))], tie=TIE),
    ]
    return rounded(convolve(Y, sources, SERIES, 8).select("event_id", "browse", "rate", "signup"))


_MANY = " UNION ALL ".join(f"""SELECT {r} AS response, r.event_id, round(coalesce(sum(0.05 * exp(-0.05 * (r.time - c.time)) * c.value), 0), 6) AS clicks,
  (SELECT round(coalesce(sum(0.1 * exp(-0.1 * (r.time - w.time)) * w.value), 0), 6) FROM
    (SELECT * FROM ev WHERE event_type = 'view') w JOIN ranks{r} k ON k.x_id = w.event_id WHERE k.event_id = r.event_id) AS views
FROM y{r} r LEFT JOIN ranks{r} k ON k.event_id = r.event_id LEFT JOIN (SELECT * FROM ev WHERE event_type = 'click') c ON c.event_id = k.x_id
GROUP BY r.event_id, r.time""" for r in (0, 1))


@query(f"""WITH {EV}, y0 AS (SELECT * FROM ev WHERE event_type = 'purchase'), y1 AS (SELECT * FROM ev WHERE event_type = 'signup'),
{", ".join(f"""ranks{r} AS (SELECT event_id, x_id FROM (SELECT y.event_id, x.event_id AS x_id,
  row_number() OVER (PARTITION BY y.event_id, x.event_type ORDER BY x.time DESC, x.event_id DESC) AS back
  FROM y{r} y JOIN x ON x.user_id = y.user_id AND x.time <= y.time + 1.1920929e-07) WHERE back <= 8)""" for r in (0, 1))}
{_MANY}""")
def convolve_many(spark, sf):
    """Two event tables and two response tables after one exchange, windows ranked within each event table."""
    ev = events(spark, sf)
    sources = [Source(ev.where("event_type = 'click'"), [Conv("clicks", "value", K.Exp(0.05))], tie=TIE),
               Source(ev.where("event_type = 'view'"), [Conv("views", "value", K.Exp(0.1))], tie=TIE)]
    found = many([ev.where("event_type = 'purchase'"), ev.where("event_type = 'signup'")], sources, SERIES, 8, layout="series")
    out = [t.select(F.lit(r).alias("response"), "event_id", "clicks", "views") for r, t in enumerate(found)]
    return rounded(out[0].unionByName(out[1]))


@query(f"""WITH {_DAILY} SELECT y.o_orderkey, round(coalesce(sum(CASE WHEN abs(d) <= 1.1920929e-07 THEN v END), 0), 4) AS same_day,
  count(CASE WHEN abs(d) <= 1.1920929e-07 THEN 1 END) AS n
FROM o y LEFT JOIN p ON y.o_orderkey = p.o_orderkey WHERE y.o_orderstatus = 'F' GROUP BY y.o_orderkey""")
def convolve_dirac(spark, sf):
    o = orders_series(spark, sf)
    X = o.select("o_custkey", "time", "o_orderkey", "o_totalprice", F.lit(1.0).alias("rate"))
    Y = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "time")
    src = Source(X, [Conv("same_day", "o_totalprice"), Conv("n", "rate")], tie=["o_orderkey"])
    out = convolve(Y, [src], ["o_custkey"], 5)
    return out.select("o_orderkey", F.round("same_day", 4).alias("same_day"), F.col("n").cast("long").alias("n"))


@query(f"""WITH {EV}, {pairs_sql(8)}, k AS (SELECT event_id,
  sum(0.05 * exp(-0.05 * d) * CASE WHEN k > 50 THEN k END) AS f FROM (
    SELECT *, CAST(json_extract(x_props, '$.k') AS DOUBLE) AS k FROM q) GROUP BY event_id)
SELECT y.event_id, round(coalesce(f, 0), 6) AS conv FROM y LEFT JOIN k ON y.event_id = k.event_id""")
def convolve_missing_values(spark, sf):
    """A predictor out of JSON that is missing half of the time: missing values add nothing."""
    X, Y = inputs(spark, sf)
    k = F.get_json_object("props", "$.k").cast("double")
    X = X.withColumn("k", F.when(k > 50, k))
    src = Source(X, [Conv("conv", "k", K.Exp(0.05))], tie=TIE)
    return rounded(convolve(Y, [src], SERIES, 8).select("event_id", "conv"))


@query(f"""WITH {EV}, {pairs_sql(8)}, s AS (SELECT event_id,
  sum(0.05 * exp(-0.05 * d) * v) AS a, sum({_gamma(2.0, 0.1, _D)} * v) AS b FROM q GROUP BY event_id)
SELECT y.event_id, round(coalesce(a, 0) * coalesce(b, 0), 4) AS a_b, round(coalesce(a, 0) * y.y, 4) AS a_y
FROM y LEFT JOIN s ON y.event_id = s.event_id""")
def convolved_products(spark, sf):
    """Interactions of responses: products taken after convolution."""
    X, Y = inputs(spark, sf)
    src = Source(X, [Conv("a", "value", K.Exp(0.05)), Conv("b", "value", K.Gamma(2.0, 0.1))], tie=TIE)
    out = convolve(Y, [src], SERIES, 8)
    return out.select("event_id", F.round(F.col("a") * F.col("b"), 4).alias("a_b"),
                      F.round(F.col("a") * F.col("y"), 4).alias("a_y"))


# ---------------------------------------------------------------- embeddings

_EMB = """w AS (SELECT * FROM (SELECT y.vec_id, x.vec_id AS x_id, y.embedding AS e0, x.embedding AS e1,
    row_number() OVER (PARTITION BY y.vec_id ORDER BY x.vec_id DESC) AS back
  FROM embeddings y JOIN embeddings x ON x.label = y.label AND x.vec_id <= y.vec_id) WHERE back <= 6)"""


def _vectors(spark, sf, kind):
    e = table(spark, sf, "embeddings").withColumn("time", F.col("vec_id").cast("double"))
    w = window_arrays(e.select("label", "time", "embedding", "vec_id"), e.select("vec_id", "label", "time"),
                      ["label"], ["embedding"], history=6, tie=["vec_id"])
    long = similarity_pairs(w, "embedding", kind)
    return long.select("vec_id", F.col("event_time").cast("long").alias("x_id"), F.round(kind, 5).alias(kind))


@query(f"""WITH {_EMB} SELECT vec_id, x_id, round(list_dot_product(e0::DOUBLE[], e1::DOUBLE[])
  / (sqrt(list_dot_product(e0::DOUBLE[], e0::DOUBLE[])) * sqrt(list_dot_product(e1::DOUBLE[], e1::DOUBLE[]))), 5) AS cosdist2D FROM w""")
def cosdist2d(spark, sf):
    return _vectors(spark, sf, "cosdist2D")


@query(f"WITH {_EMB} SELECT vec_id, x_id, round(list_distance(e0::DOUBLE[], e1::DOUBLE[]), 5) AS eucldist2D FROM w")
def eucldist2d(spark, sf):
    return _vectors(spark, sf, "eucldist2D")




# A normal delay around 0 of sd 50 with an exponential of rate 1: beta * sigma is 50, so exp(lead) alone overflows.
# The scaled tail by its continued fraction, innermost first.
_STEEP_W = "((50.0 - d / 50.0) / sqrt(2.0))"
_STEEP = (f"(exp(-0.5 * (d / 50.0) ** 2) / sqrt(pi()) / list_reduce(list_prepend({_STEEP_W}, list_transform(range(40, 0, -1), "
          f"lambda k: k / 2.0)), lambda f, a: {_STEEP_W} + a / f) * 0.5)")


@query(conv_sql(f"{_STEEP} * 2 * v", history=8, cutoff=72.0))
def convolve_emg_steep(spark, sf):
    X, Y = inputs(spark, sf)
    kernel = K.EMG(0.0, 50.0, 1.0)
    out = convolve(Y, [Source(X, [Conv("conv", "value", kernel)], tie=["event_id"])], ["user_id"], 8, cutoff=72.0)
    return rounded(out.select("event_id", (F.col("conv") * kernel.normaliser() * 2).alias("conv")))


@query(f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY time, event_id) AS rank FROM x),
{pairs_sql(3)} SELECT q.event_id, x_id, rank, rank AS rank_in_blocks FROM q JOIN r ON r.event_id = q.x_id""")
def window_ranks(spark, sf):
    """Positions of events in their series, from whole series and from blocks."""
    X, Y = inputs(spark, sf)
    X = X.withColumn("x_id", F.col("event_id"))
    ranks = [pairs(window_arrays(X, Y, ["user_id"], ["x_id"], 3, tie=["event_id"], layout=kind, blocks=blocks)).select(
        "event_id", "x_id", F.col("event_rank").cast("long").alias(name))
        for kind, blocks, name in (("series", None, "rank"), ("blocks", 7, "rank_in_blocks"))]
    return ranks[0].join(ranks[1], ["event_id", "x_id"], "full_outer")
