"""Scores, correlations, significance tests and collation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from echoframe.catalog.base import EV, inputs, pairs_sql, query, rounded, table
from echoframe.catalog.fitting import FEATS, OLS2, features
from echoframe.catalog.windows import _phi
from echoframe.operators import compare, irf, partition, regress
from echoframe.operators.windows import WINDOW, pairs, window_arrays

# ---------------------------------------------------------------- aggregates


@query("""WITH c AS (SELECT quality::VARCHAR AS o, (1 - toxic)::VARCHAR AS p FROM labels),
k AS (SELECT cls, (SELECT count(*) FROM c WHERE o = cls) AS actual, (SELECT count(*) FROM c WHERE p = cls) AS said,
  (SELECT count(*) FROM c WHERE p = cls AND o = cls) AS hit FROM (VALUES ('0'), ('1')) v(cls)),
f AS (SELECT *, hit * 2.0 / (actual + said) AS f1 FROM k)
SELECT sum(actual)::BIGINT AS n, round(sum(hit) / sum(actual), 6) AS accuracy, round(sum(f1 * actual) / sum(actual), 6) AS f1_weighted,
  round(avg(f1), 6) AS f1_macro FROM f""")
def f1_score(spark, sf):
    lb = table(spark, sf, "labels").select("quality", (1 - F.col("toxic")).alias("pred"))
    return rounded(compare.f1(lb, "quality", "pred"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
                          for a in _COLS[:2] for b in _COLS[1:]))
def correlation_matrix(spark, sf):
    return rounded(compare.correlations(table(spark, sf, "lineitem"), _COLS[:2], _COLS[1:]))


@query(f"""WITH {EV}, {pairs_sql(8)}, k AS (SELECT *, CAST(json_extract(x_props, '$.k') AS DOUBLE) AS k,
  abs(v - last_value(v) OVER (PARTITION BY event_id ORDER BY back DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS g FROM q),
l AS (SELECT y.event_id, coalesce(k.v, 0) AS v, coalesce(k.k, 0) AS k FROM y LEFT JOIN k ON y.event_id = k.event_id AND back = 1)
SELECT 'value' AS a, 'k' AS b, round(corr(v, k), 6) AS r FROM l UNION ALL SELECT 'k', 'value', round(corr(v, k), 6) FROM l
UNION ALL SELECT 'value', 'value', 1.0 UNION ALL SELECT 'k', 'k', 1.0
UNION ALL SELECT 'gap', 'value', round(corr(g, v), 6) FROM k UNION ALL SELECT 'value', 'gap', round(corr(g, v), 6) FROM k
UNION ALL SELECT 'gap', 'k', round(corr(g, k), 6) FROM k UNION ALL SELECT 'k', 'gap', round(corr(g, k), 6) FROM k
UNION ALL SELECT 'gap', 'gap', 1.0""")
def design_correlation(spark, sf):
    """Two plain predictors at the latest event, one pairwise predictor over all pairs."""
    X, Y = inputs(spark, sf)
    X = X.withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    w = window_arrays(X, Y, ["user_id"], ["value", "k"], 8, tie=["event_id"])
    last = F.get(F.col(WINDOW), F.size(WINDOW) - 1)["value"]
    w = w.withColumn(WINDOW, F.transform(WINDOW, lambda e: e.withField("gap", F.abs(e["value"] - last))))
    return rounded(compare.design_correlations(w, WINDOW, ["value", "k"], ["gap"]))


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp,
  stddev_samp(l_extendedprice) AS sp, avg(l_tax) AS mt, stddev_samp(l_tax) AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, round(l_discount - l_tax, 6) AS err,
  round(((l_tax - mt) / st - (l_quantity - mq) / sq) * (l_extendedprice - mp) / sp, 6) AS cor FROM lineitem, s""")
def elementwise_difference(spark, sf):
    li = table(spark, sf, "lineitem")
    li = compare.elementwise_difference(li, "l_tax", "l_discount", into="err")
    li = compare.elementwise_difference(li, "l_quantity", "l_tax", "l_extendedprice", "corr", into="cor")
    return rounded(li.select("l_orderkey", "l_linenumber", "err", "cor"))


@query("""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq, avg(l_extendedprice) AS mp,
  stddev_pop(l_extendedprice) AS sp, corr(l_quantity, l_extendedprice) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, round(((l_quantity - mq) / sq + sign(r) * (l_extendedprice - mp) / sp) / sqrt(2), 5) AS pc1,
  round(abs((l_quantity - mq) / sq - sign(r) * (l_extendedprice - mp) / sp) / sqrt(2), 5) AS pc2 FROM lineitem, s""")
def principal_components(spark, sf):
    li = table(spark, sf, "lineitem")
    out = compare.pca(li, ["l_quantity", "l_extendedprice"]).project(li)
    return rounded(out.select("l_orderkey", "l_linenumber", "pc1", F.abs("pc2").alias("pc2")), 5)


@query("""WITH e AS (SELECT value - (SELECT avg(value) FROM events) AS e FROM events),
s AS (SELECT avg(e) AS m, stddev_pop(e) AS sd, count(*) AS n FROM e),
r AS (SELECT e, row_number() OVER (ORDER BY e) AS rank, m, sd, n FROM e, s)
SELECT rank, round(e, 6) AS empirical, round(m + sd * list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(0, 44), lambda i: 4.0 / 2 ** i)),
  lambda z, step: z + step * sign((rank - 0.5) / n - """ + _phi("z") + """)), 5) AS theoretical FROM r""")
def error_quantiles(spark, sf):
    """Sorted errors beside normal quantiles, which SQL finds by halving steps."""
    mean = table(spark, sf, "events").agg(F.avg("value")).first()[0]
    errors = table(spark, sf, "events").select((F.col("value") - F.lit(mean)).alias("e"))
    out = compare.quantile_table(errors, "e")
    return out.select("rank", F.round("empirical", 6).alias("empirical"), F.round("theoretical", 5).alias("theoretical"))


@query("""WITH l AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) / 1000 AS a FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, round(exp(a) / sum(exp(a)) OVER (PARTITION BY o_orderpriority), 6) AS weight FROM l""")
def softmax_weights(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        (F.avg("o_totalprice") / 1000).alias("a"))
    return rounded(partition.softmax(g, "a", ["o_orderpriority"]).select("o_orderpriority", "o_orderstatus", "weight"))


# Members of an ensemble: per user, the mean value of one event type predicts the purchases.
_MEMBERS = f"""{EV}, e AS (SELECT y.event_id, m.event_type AS model, m.v AS pred, -0.5 * ln(2 * pi() * 2500) - (y.y - m.v) ** 2 / 5000 AS ll
  FROM y JOIN (SELECT user_id, event_type, avg(value) AS v FROM ev WHERE event_type != 'purchase' GROUP BY 1, 2) m USING (user_id)),
w AS (SELECT model, avg(ll) * 100 AS a FROM e GROUP BY model),
k AS (SELECT model, exp(a - (SELECT max(a) FROM w)) AS k FROM w)"""


@query(f"""WITH {_MEMBERS} SELECT event_id, round(avg(pred), 6) AS even, round(sum(k * pred) / sum(k), 6) AS weighted
FROM e JOIN k USING (model) GROUP BY event_id""")
def ensemble_predictions(spark, sf):
    from echoframe.catalog.base import events
    from echoframe.functions.distributions import normal

    ev = events(spark, sf)
    _, Y = inputs(spark, sf)
    members = ev.where("event_type != 'purchase'").groupBy("user_id", F.col("event_type").alias("model")).agg(
        F.avg("value").alias("pred"))
    e = Y.join(members, "user_id").withColumn("ll", normal(F.col("y"), F.col("pred"), 50.0))
    weights = partition.softmax(e.groupBy("model").agg((F.avg("ll") * 100).alias("a")), "a").select("model", "weight")
    even = partition.ensemble_predictions(e, "event_id", "model", "pred", into="even")
    best = partition.ensemble_predictions(e, "event_id", "model", "pred", weights, into="weighted")
    return rounded(even.join(best, "event_id"))


# ---------------------------------------------------------------- collation

# One result per task (event type), system, fold and ensemble member.
_RESULTS = """r AS (SELECT event_type AS task, system, user_id % 3 AS fold, user_id % 2 AS ensemble,
  CASE WHEN event_id % 2 = 0 THEN 'train' ELSE 'test' END AS part, avg((value - guess) ** 2) AS value, (min(value) < 1)::INT AS converged
  FROM events, (VALUES ('low', 30.0), ('high', 60.0)) s(system, guess) GROUP BY ALL),
m AS (SELECT task, system, ensemble, part, avg(value) AS mean, sum(value) AS total, avg(converged) AS c FROM r GROUP BY ALL)"""


def _results(spark, sf):
    ev = table(spark, sf, "events")
    guess = F.explode(F.array(F.struct(F.lit("low").alias("system"), F.lit(30.0).alias("guess")),
                              F.struct(F.lit("high").alias("system"), F.lit(60.0).alias("guess"))))
    ev = ev.select("*", guess.alias("_g")).select("*", "_g.*")
    return ev.groupBy(
        F.col("event_type").alias("task"), "system", (F.col("user_id") % 3).alias("fold"),
        (F.col("user_id") % 2).alias("ensemble"),
        F.when(F.col("event_id") % 2 == 0, "train").otherwise("test").alias("partition"),
    ).agg(F.avg(F.pow(F.col("value") - F.col("guess"), 2.0)).alias("value"),
          F.when(F.min("value") < 1, 1).otherwise(0).alias("converged"))


@query(f"""WITH {_RESULTS} SELECT task, system, round(median(mean) FILTER (part = 'train'), 4) AS train_value,
  round(avg(c) FILTER (part = 'train'), 4) AS train_converged, round(median(mean) FILTER (part = 'test'), 4) AS test_value,
  round(avg(c) FILTER (part = 'test'), 4) AS test_converged FROM m GROUP BY task, system""")
def collate_results(spark, sf):
    return rounded(compare.collate(_results(spark, sf), "mse", "median", partitions=("train", "test")), 4)


@query(f"""WITH {_RESULTS}, c AS (SELECT system, fold, ensemble, part, sum(value) AS value, avg(converged) AS c FROM r GROUP BY ALL),
k AS (SELECT system, ensemble, part, sum(value) AS value, avg(c) AS c FROM c GROUP BY ALL)
SELECT system, round(max(value) FILTER (part = 'train'), 3) AS train_value, round(avg(c) FILTER (part = 'train'), 3) AS train_converged,
  round(max(value) FILTER (part = 'test'), 3) AS test_value, round(avg(c) FILTER (part = 'test'), 3) AS test_converged
FROM k GROUP BY system""")
def collate_loglik(spark, sf):
    return rounded(compare.collate(_results(spark, sf), "loglik", "max", True, ("train", "test")), 3)


@query("""SELECT DISTINCT p_brand AS model, CASE WHEN regexp_full_match(p_brand, 'Brand#2[0-9]') THEN 0 WHEN p_brand = 'Brand#3' THEN 1 ELSE 2 END AS "order"
FROM part WHERE regexp_full_match(p_brand, 'Brand#2[0-9]') OR p_brand = 'Brand#3' OR regexp_full_match(p_brand, '.*1')""")
def select_models(spark, sf):
    models = table(spark, sf, "part").select(F.col("p_brand").alias("model")).distinct()
    return compare.select_models(models, ["Brand#2[0-9]", "Brand#3", ".*1"], exclude_baselines=True)


@query("""SELECT o_custkey AS model FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def common_models(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("model"), "o_orderstatus")
    return compare.common_models([o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'")])


@query("""WITH m AS (SELECT o_orderstatus AS b, [] AS s FROM orders GROUP BY 1
  UNION SELECT o_orderstatus, [left(o_orderpriority, 1)] FROM orders
  UNION SELECT o_orderstatus, list_sort([left(o_orderpriority, 1), 'x' || (o_custkey % 3)]) FROM orders),
n AS (SELECT b, s, CASE WHEN len(s) = 0 THEN b ELSE b || '!' || array_to_string(s, '!') END AS name FROM m)
SELECT a.name AS smaller, c.name AS larger FROM n a JOIN n c ON a.b = c.b AND len(a.s) = len(c.s) + 1
WHERE len(list_intersect(a.s, c.s)) = len(c.s)""")
def nested_models(spark, sf):
    o = table(spark, sf, "orders")
    p, x = F.substring("o_orderpriority", 1, 1), F.concat(F.lit("x"), F.col("o_custkey") % 3)
    names = [F.col("o_orderstatus"), F.concat_ws("!", "o_orderstatus", p), F.concat_ws("!", "o_orderstatus", p, x)]
    models = o.select(F.explode(F.array(*names)).alias("model")).distinct()
    return partition.nested_models(models)


# ---------------------------------------------------------------- significance

_ERRS = f"""{FEATS}, {OLS2}, e AS (SELECT event_id, y, c0 + ca * a + cb * b AS p1, my AS mean, (y - c0 - ca * a - cb * b) ** 2 AS e1,
  (y - my) ** 2 AS e0 FROM f, o)"""


def _errors(spark, sf):
    """Squared errors of the constant model (e0) and of the two-predictor model (e1) per purchase."""
    feats = features(spark, sf)
    g = regress.gram(feats, ["a", "b", "y"])
    fit, null = regress.solve(g, ["a", "b"], "y"), regress.solve(g, [], "y")
    out = fit.predict(feats, "p1").withColumn("p0", F.lit(null.intercept))
    return out.select("event_id", "user_id", "y", "a", "b", "p1",
                      F.pow(F.col("y") - F.col("p0"), 2.0).alias("e0"), F.pow(F.col("y") - F.col("p1"), 2.0).alias("e1"))


_M64 = "18446744073709551616::UHUGEINT"


def _mix_sql(z: str, name: str, source: str) -> str:
    """splitmix64 in 128-bit arithmetic, one step per common table."""
    return f"""{name}1 AS (SELECT *, ({z}) % {_M64} AS z0 FROM {source}),
{name}2 AS (SELECT *, (xor(z0, z0 // 1073741824::UHUGEINT) * 13787848793156543929::UHUGEINT) % {_M64} AS z1 FROM {name}1),
{name}3 AS (SELECT *, (xor(z1, z1 // 134217728::UHUGEINT) * 10723151780598845931::UHUGEINT) % {_M64} AS z2 FROM {name}2),
{name} AS (SELECT *, xor(z2, z2 // 2147483648::UHUGEINT) AS bits FROM {name}3)"""


_N_ITER = 128


@query(f"""WITH {_ERRS}, w AS (SELECT event_id, e0, e1, unnest(range(1, {_N_ITER // 64 + 1})) AS word FROM e),
{_mix_sql('event_id::UHUGEINT + word::UHUGEINT * 11400714819323198485::UHUGEINT', 'h', 'w')},
i AS (SELECT e0, e1, word, bits, unnest(range(0, 64)) AS bit FROM h),
d AS (SELECT (word - 1) * 64 + bit AS iteration, avg(CASE WHEN (bits // (2 ** bit)::UHUGEINT) % 2 = 1 THEN e1 - e0 ELSE e0 - e1 END) AS diff FROM i GROUP BY 1)
SELECT iteration::INTEGER AS iteration, round(diff, 4) AS diff FROM d""")
def permutation_differences(spark, sf):
    """Null distribution of the difference in mean squared error."""
    res = compare.permutation_test(_errors(spark, sf), "e0", "e1", "event_id", n_iter=_N_ITER)
    return rounded(res.diffs, 4)


@query(f"""WITH {_ERRS}, s AS (SELECT avg(e0) AS a, avg(e1) AS b, count(*) AS n FROM e),
w AS (SELECT event_id, e0, e1, unnest(range(1, 158)) AS word FROM e),
{_mix_sql('event_id::UHUGEINT + word::UHUGEINT * 11400714819323198485::UHUGEINT', 'h', 'w')},
i AS (SELECT e0, e1, word, bits, unnest(range(0, 64)) AS bit FROM h),
d AS (SELECT (word - 1) * 64 + bit AS it, avg(CASE WHEN (bits // (2 ** bit)::UHUGEINT) % 2 = 1 THEN e1 - e0 ELSE e0 - e1 END) AS diff FROM i GROUP BY 1)
SELECT n, round(a, 4) AS a, round(b, 4) AS b, round(a - b, 4) AS diff,
  round(((SELECT count(*) FROM d WHERE it < 10000 AND abs(d.diff) > abs(a - b)) + 1) / 10001.0, 6) AS p FROM s""")
def permutation_p(spark, sf):
    r = compare.permutation_test(_errors(spark, sf), "e0", "e1", "event_id", n_iter=10_000)
    return spark.createDataFrame([(r.n, round(r.a, 4), round(r.b, 4), round(r.diff, 4), round(r.p, 6))],
                                 "n long, a double, b double, diff double, p double")


@query(f"""WITH {_ERRS}, w AS (SELECT event_id, [e0, e0 * 1.01, e1, e1 * 0.99] AS cells, unnest(range(0, 100)) AS it FROM e),
{_mix_sql('event_id::UHUGEINT + (it + 1)::UHUGEINT * 13787848793156543929::UHUGEINT', 'h', 'w')},
c AS (SELECT event_id, it, cells, bits AS seed, unnest(range(1, 5)) AS cell FROM h),
{_mix_sql('seed + cell::UHUGEINT * 11400714819323198485::UHUGEINT', 'kk', 'c')},
moved AS (SELECT it, cells[cell] AS v, row_number() OVER (PARTITION BY event_id, it ORDER BY bits, cell) AS slot FROM kk),
sums AS (SELECT it, slot, sum(v) AS total FROM moved GROUP BY it, slot)
SELECT it::INTEGER AS iteration, round((avg(total) FILTER (slot <= 2) - avg(total) FILTER (slot > 2)) / (SELECT count(*) FROM e), 4) AS diff
FROM sums GROUP BY it""")
def permutation_ensemble(spark, sf):
    """Two members per model: cells of a row are reordered over four columns, by a hash of row, iteration and cell."""
    e = _errors(spark, sf).withColumn("e0b", F.col("e0") * 1.01).withColumn("e1b", F.col("e1") * 0.99)
    r = compare.permutation_test(e, ["e0", "e0b"], ["e1", "e1b"], "event_id", n_iter=100, agg="median")
    return rounded(r.diffs, 4)


@query(f"""WITH {_ERRS}, g AS (SELECT event_id, e0, e1, event_id % 2 AS exp FROM e),
s AS (SELECT exp, stddev_pop(v) AS sd FROM (SELECT exp, e0 AS v FROM g UNION ALL SELECT exp, e1 FROM g) GROUP BY exp)
SELECT 'exp' || exp AS experiment, count(*) AS n, round(sum(e0 / sd), 4) AS e0, round(sum(e1 / sd), 4) AS e1
FROM g JOIN s USING (exp) GROUP BY exp""")
def pooled_scores(spark, sf):
    e = _errors(spark, sf)
    parts = {f"exp{i}": e.where(F.col("event_id") % 2 == i) for i in (0, 1)}
    pooled = compare.pooled_scores(parts, "e0", "e1", "event_id")
    return rounded(pooled.groupBy("experiment").agg(F.count(F.lit(1)).alias("n"), F.sum("e0").alias("e0"),
                                                    F.sum("e1").alias("e1")), 4)


@query(f"""WITH {_ERRS}, g AS (SELECT event_id * 2 + event_id % 2 AS id, e0, e1, event_id % 2 AS exp FROM e),
sd AS (SELECT exp, stddev_pop(v) AS sd FROM (SELECT exp, e0 AS v FROM g UNION ALL SELECT exp, e1 FROM g) GROUP BY exp),
z AS (SELECT id, e0 / sd AS e0, e1 / sd AS e1 FROM g JOIN sd USING (exp)), s AS (SELECT avg(e0) AS a, avg(e1) AS b, count(*) AS n FROM z),
w AS (SELECT id, e0, e1, unnest(range(1, 158)) AS word FROM z),
{_mix_sql('id::UHUGEINT + word::UHUGEINT * 11400714819323198485::UHUGEINT', 'h', 'w')},
i AS (SELECT e0, e1, word, bits, unnest(range(0, 64)) AS bit FROM h),
d AS (SELECT (word - 1) * 64 + bit AS it, avg(CASE WHEN (bits // (2 ** bit)::UHUGEINT) % 2 = 1 THEN e1 - e0 ELSE e0 - e1 END) AS diff FROM i GROUP BY 1)
SELECT n, round(a - b, 6) AS diff, round(((SELECT count(*) FROM d WHERE it < 10000 AND abs(d.diff) > abs(a - b)) + 1) / 10001.0, 6) AS p FROM s""")
def pooled_permutation_p(spark, sf):
    """Two experiments on one scale, tested together in ten thousand shuffles."""
    e = _errors(spark, sf)
    pooled = compare.pooled_scores({f"exp{i}": e.where(F.col("event_id") % 2 == i) for i in (0, 1)}, "e0", "e1", "event_id")
    r = compare.permutation_test(pooled, "e0", "e1", "_row", n_iter=10_000)
    return spark.createDataFrame([(r.n, round(r.diff, 6), round(r.p, 6))], "n long, diff double, p double")


_TAIL = ("(1 - 2 * exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 120), lambda k: "
         "exp((2 * k + 1) * ln({z} + 1e-300) - (lgamma(k + 1.5) - lgamma(0.5) + (k + 1) * ln(2.0))))))")


@query(f"""WITH {FEATS}, c AS (SELECT count(*) AS n, corr(y, a) AS r1, corr(y, b) AS r2, corr(a, b) AS rx FROM f),
h AS (SELECT *, (r1 * r1 + r2 * r2) / 2 AS m, (1 - rx) / (2 * (1 - (r1 * r1 + r2 * r2) / 2)) AS ff FROM c),
z AS (SELECT *, (atanh(r1) - atanh(r2)) * sqrt((n - 3) / (2 * (1 - rx) * ((1 - ff * m) / (1 - m)))) AS z FROM h)
SELECT n, round(r1, 6) AS r1, round(r2, 6) AS r2, round(rx, 6) AS rx, round(r1 - r2, 6) AS rdiff, round(z, 6) AS z,
  round({_TAIL.format(z='abs(z)')}, 6) AS p FROM z""")
def steiger(spark, sf):
    return rounded(compare.correlation_test(features(spark, sf), "y", "a", "b"))


@query(f"""WITH {FEATS}, {OLS2}, s AS (SELECT n * (ln(yy) - ln(mse)) AS stat FROM o)
SELECT round(stat, 5) AS stat, round(exp(-stat / 2), 6) AS p FROM s""")
def likelihood_ratio(spark, sf):
    """Two predictors against none: chi-square with two degrees of freedom."""
    g = regress.gram(features(spark, sf), ["a", "b", "y"])
    small, large = regress.solve(g, [], "y"), regress.solve(g, ["a", "b"], "y")
    stat, p = regress.likelihood_ratio(small.loglik, large.loglik, 2)
    return spark.createDataFrame([(round(stat, 5), round(p, 6))], "stat double, p double")


@query(f"""WITH {FEATS}, {OLS2}, s AS (SELECT 400 + n * (ln(yy) - ln(mse)) AS stat FROM o)
SELECT round(stat, 5) AS stat, round(-stat / 2, 6) AS log_p FROM s""")
def likelihood_ratio_large(spark, sf):
    """A statistic far out, where one minus the distribution function would be 0."""
    g = regress.gram(features(spark, sf), ["a", "b", "y"])
    small, large = regress.solve(g, [], "y"), regress.solve(g, ["a", "b"], "y")
    stat, p = regress.likelihood_ratio(small.loglik, large.loglik + 200, 2)
    return spark.createDataFrame([(round(stat, 5), round(math.log(p), 6))], "stat double, log_p double")


@query("""WITH t AS (SELECT event_type, user_id, exp(-avg(value) / 12) AS p FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM t),
h AS (SELECT *, p * m * list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / i)) / k AS raw FROM r)
SELECT event_type, user_id, round(p, 6) AS p,
  round(least(1, min(raw) OVER (PARTITION BY event_type ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS p_adjusted FROM h""")
def adjusted_p(spark, sf):
    t = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.exp(-F.avg("value") / 12).alias("p"))
    return rounded(compare.adjust_p(t, "p", ["event_type"]))


@query("""WITH t AS (SELECT 'm' || (user_id % 7) AS comparison, CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'test' END AS part,
  sum(value) - 3000 AS diff, exp(-avg(value) / 12) AS p FROM events GROUP BY 1, 2)
SELECT comparison, (max(round(-diff)) FILTER (part = 'train'))::BIGINT AS train_diff, round(max(p) FILTER (part = 'train'), 6) AS train_p,
  (max(round(-diff)) FILTER (part = 'test'))::BIGINT AS test_diff, round(max(p) FILTER (part = 'test'), 6) AS test_p FROM t GROUP BY 1""")
def comparison_table(spark, sf):
    t = table(spark, sf, "events").groupBy(
        F.concat(F.lit("m"), F.col("user_id") % 7).alias("comparison"), F.lit("y").alias("response"),
        F.when(F.col("user_id") % 2 == 0, "train").otherwise("test").alias("partition"),
    ).agg((F.sum("value") - 3000).alias("diff"), F.exp(-F.avg("value") / 12).alias("p"))
    out = compare.comparison_table(t)
    return out.select("comparison", F.col("y_train.diff").alias("train_diff"), F.round("y_train.p", 6).alias("train_p"),
                      F.col("y_test.diff").alias("test_diff"), F.round("y_test.p", 6).alias("test_p"))


# ---------------------------------------------------------------- uncertainty

_POISSON = " ".join(f"WHEN u < {c!r} THEN {k}" for k, c in enumerate(regress.POISSON_1))
_BOOT = f"""{FEATS}, b AS (SELECT *, unnest(range(0, 20)) AS replicate FROM f),
u AS (SELECT *, (('0x' || substr(md5('0:' || event_id || ':' || replicate), 1, 8))::BIGINT + 0.5) / 4294967296.0 AS u FROM b),
w AS (SELECT *, CASE {_POISSON} ELSE {len(regress.POISSON_1)} END AS w FROM u),
s AS (SELECT replicate, sum(w) AS n, sum(w * a) AS sa, sum(w * y) AS sy, sum(w * a * a) AS saa, sum(w * a * y) AS say FROM w GROUP BY 1),
c AS (SELECT replicate, (say / n - sa / n * sy / n) / (saa / n - (sa / n) ** 2) AS b1, sa / n AS ma, sy / n AS my FROM s),
e AS (SELECT replicate::INTEGER AS replicate, 'a' AS parameter, b1 AS estimate FROM c
  UNION ALL SELECT replicate::INTEGER, 'intercept', my - b1 * ma FROM c)"""


@query(f"WITH {_BOOT} SELECT replicate, parameter, round(estimate, 6) AS estimate FROM e")
def bootstrap_coefs(spark, sf):
    return rounded(regress.bootstrap(features(spark, sf), ["a"], "y", "event_id", 20))


@query(f"""WITH {_BOOT} SELECT parameter, round(avg(estimate), 6) AS mean, round(quantile_cont(estimate, 0.025), 6) AS lower,
  round(quantile_cont(estimate, 0.975), 6) AS upper FROM e GROUP BY parameter""")
def credible_bounds(spark, sf):
    samples = regress.bootstrap(features(spark, sf), ["a"], "y", "event_id", 20)
    return rounded(regress.credible(samples, ["parameter"], "estimate"))


# Contrasts over samples: users stand for samples, their mean values per event type for estimates.
@query("""WITH s AS (SELECT user_id, avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'view') AS v,
  avg(value) FILTER (event_type = 'signup') AS s, avg(value) FILTER (event_type = 'error') AS e FROM events GROUP BY 1),
t AS (SELECT 'click_view' AS contrast, c - v AS x FROM s UNION ALL SELECT 'interaction', (c - v) - (s - e) FROM s)
SELECT contrast, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.025), 6) AS lower, round(quantile_cont(x, 0.975), 6) AS upper FROM t GROUP BY 1""")
def contrasts(spark, sf):
    samples = table(spark, sf, "events").groupBy(F.col("user_id").alias("sample"), F.col("event_type").alias("name")).agg(
        F.avg("value").alias("estimate"))
    trees = {"click_view": ("click", "view"), "interaction": (("click", "view"), ("signup", "error"))}
    return rounded(irf.contrasts(samples, trees))


@query(f"""WITH {EV}, {pairs_sql(8)} SELECT event_id, count(*) AS n, round(sum(v), 4) AS total FROM q GROUP BY event_id""")
def expand_windows(spark, sf):
    """Windows in long form, regrouped."""
    X, Y = inputs(spark, sf)
    w = window_arrays(X, Y, ["user_id"], ["value"], 8, tie=["event_id"])
    return pairs(w).groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
