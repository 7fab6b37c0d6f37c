"""Sources, filters, transforms, window functions and partitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from echoframe.catalog.base import EV, events, inputs, orders_series, pairs_sql, query, rounded, table
from echoframe.functions import transforms as T
from echoframe.operators import filters, partition
from echoframe.operators.series import prefix_sum, running_count, spillover
from echoframe.operators.windows import pairs, window_arrays
from echoframe.session import fresh_folder
from echoframe.sources import tables as S
from echoframe.sources.tables import prepare_events

# ---------------------------------------------------------------- sources


@query(f"""WITH {EV} SELECT event_id, 1.0::DOUBLE AS rate,
  row_number() OVER (PARTITION BY user_id ORDER BY time)::DOUBLE AS trial FROM ev""")
def events_with_trial(spark, sf):
    return prepare_events(events(spark, sf), ["user_id"]).select("event_id", "rate", "trial")


@query("""SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position FROM events""")
def running_count_one_series(spark, sf):
    """All rows in one series: counted block by block."""
    out = running_count(events(spark, sf), [], ["time", "event_id"], "position", layout="blocks")
    return out.select("event_id", F.col("position").cast("long").alias("position"))


@query("""SELECT o_orderstatus || ':' || o_orderpriority AS key, count(*) AS n, round(avg(o_totalprice), 4) AS mean
FROM orders GROUP BY 1""")
def categorical_ids(spark, sf):
    o = T.with_categoricals(table(spark, sf, "orders"), ["o_orderstatus", "o_orderstatus:o_orderpriority"])
    return o.groupBy(F.col("`o_orderstatus:o_orderpriority`").alias("key")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT l_returnflag || '_' || l_linestatus AS key, count(*) AS n FROM lineitem GROUP BY 1")
def composite_key(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(T.composite_key(["l_returnflag", "l_linestatus"]).alias("key")).agg(
        F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
  SELECT event_type, value FROM events WHERE event_type = 'click'
  UNION ALL SELECT event_type, value FROM events WHERE event_type = 'view') GROUP BY event_type""")
def concat_tables(spark, sf):
    """Two files whose columns stand in another order, read as one table."""
    ev, at = table(spark, sf, "events"), fresh_folder(spark, "concat")
    ev.where("event_type = 'click'").select("event_type", "value").write.options(sep=" ", header=True).csv(f"{at}/a")
    ev.where("event_type = 'view'").select("value", "event_id", "event_type").write.options(sep=" ", header=True).csv(f"{at}/b")
    both = S.read_table(spark, [f"{at}/a", f"{at}/b"], "event_type string, value double")
    return both.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT o_custkey::VARCHAR AS o_custkey, 1.0::DOUBLE AS rate, count(*) AS n, round(sum(o_totalprice), 2) AS price,
  max(trial)::DOUBLE AS trial, sum(CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderkey END)::BIGINT AS shipping FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS trial FROM orders) GROUP BY 1""")
def read_column_files(spark, sf):
    """Event files of two clocks, two parts each, with nan for missing values; the first clock's table."""
    at, o = fresh_folder(spark, "columns"), orders_series(spark, sf)
    o = o.withColumn("shipping", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderkey").cast("int")))
    for i in (0, 1):
        part = o.where(F.col("o_orderkey") % 2 == i)
        S.write_partitions(part.select("o_custkey", "time", "o_totalprice", "shipping", F.lit("x").alias("part")), f"{at}/x{i}")
        S.write_partitions(part.select("time", "o_custkey", F.lit("x").alias("part")), f"{at}/z{i}")
        S.write_partitions(part.select("o_custkey", "time", "o_orderkey", F.lit("y").alias("part")), f"{at}/y{i}")
    schema = "o_custkey string, time double, o_totalprice double, shipping int"
    X, _ = S.read_tabular_data(spark, [f"{at}/x{i}/part=x;{at}/z{i}/part=x" for i in (0, 1)], [f"{at}/y{i}/part=y" for i in (0, 1)],
                               ["o_custkey"], x_schemas=[schema, "o_custkey string, time double"])
    return X[0].groupBy("o_custkey", "rate").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.max("trial").alias("trial"),
        F.sum("shipping").alias("shipping"))


@query("""SELECT part, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(*) FILTER (o_orderstatus != 'F') AS known
FROM (SELECT *, CASE WHEN o_custkey % 4 <= 1 THEN 'train' WHEN o_custkey % 4 = 2 THEN 'dev' ELSE 'test' END AS part FROM orders)
WHERE part != 'test' GROUP BY part""")
def partition_sink_roundtrip(spark, sf):
    """Written by part with nan for missing values, then read by a list of parts."""
    o = table(spark, sf, "orders").withColumn("part", F.get(F.lit(["train", "dev", "test"]), partition.part_of(F.col("o_custkey"))))
    at = fresh_folder(spark, "parts")
    S.write_partitions(o.select("o_orderkey", "o_totalprice", F.when(F.col("o_orderstatus") != "F", F.col("o_orderkey")).alias("known"), "part"), at)
    paths = {p: [f"{at}/part={p}"] for p in ("train", "dev", "test")}
    frames = [S.read_table(spark, S.partition_paths(p, paths), "o_orderkey long, o_totalprice double, known long").withColumn("part", F.lit(p))
              for p in S.partition_names("train-dev")]
    return frames[0].unionByName(frames[1]).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("known").alias("known"))


@query("""WITH l AS (SELECT l_orderkey % 3 AS fold, l_extendedprice / 1000 AS obs, l_quantity * 1.5 AS pred FROM lineitem)
SELECT 'mse' AS metric, 'wide' AS model, fold::VARCHAR AS fold, '1' AS member, count(*) AS n, round(sum((obs - pred) ** 2), 3) AS total FROM l GROUP BY fold
UNION ALL SELECT 'mse', 'plain', NULL, NULL, count(*), round(sum((obs - pred + 1) ** 2), 3) FROM l
UNION ALL SELECT 'loglik', 'plain', NULL, NULL, count(*), round(-sum((obs - pred) ** 2), 3) FROM l
UNION ALL SELECT 'loss', 'losses', NULL, NULL, count(*), round(sum(abs(obs - pred)), 3) FROM l
UNION ALL SELECT 'corr', 'wide', fold::VARCHAR, '1', count(*), round(sum(pred), 3) FROM l GROUP BY fold
UNION ALL SELECT 'corr', 'plain', NULL, NULL, count(*), round(sum(pred - 1), 3) FROM l""")
def results_roundtrip(spark, sf):
    """Results of three models (folds and a member; likelihoods; losses only) written one by one and read by metric."""
    at = fresh_folder(spark, "results")
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 3).alias("f"), (F.col("l_extendedprice") / 1000).alias("obs"),
                                             (F.col("l_quantity") * 1.5).alias("pred"))
    S.write_results(li.drop("f").withColumn("loglik", -F.pow(F.col("obs") - F.col("pred"), 2)).withColumn("pred", F.col("pred") - 1), at,
                    {"model": "plain", "kind": "direct", "response": "y", "partition": "dev"})
    S.write_results(li, at, {"model": "wide", "kind": "direct", "fold": F.col("f"), "member": "1", "response": "y", "partition": "dev"})
    S.write_results(li.select(F.abs(F.col("obs") - F.col("pred")).alias("loss")), at, {"model": "losses", "partition": "dev"})
    out = None
    for metric in S.METRICS:
        one = S.read_results(spark, at, metric).groupBy("model", "fold", "member").agg(
            F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).withColumn("metric", F.lit(metric))
        out = one if out is None else out.unionByName(one)
    return out


# ---------------------------------------------------------------- filters

_LI = "l_orderkey, l_linenumber, l_quantity, l_extendedprice"
_LI_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"]


@query(f"""SELECT {_LI} FROM lineitem WHERE l_quantity <= 10 AND l_discount > 0.05 AND l_returnflag != 'N'
  AND l_linestatus = 'F' AND l_extendedprice < 'inf'::DOUBLE""")
def filter_conjunction(spark, sf):
    return filters.apply_filters(table(spark, sf, "lineitem"), [
        ("l_quantity", "<= 10"), ("l_discount", "> 0.05"), ("l_returnflag", "!= N"),
        ("l_linestatus", "== F"), ("l_extendedprice", "< inf"),
    ]).select(*_LI_COLS)


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax > l_discount")
def filter_other_column(spark, sf):
    return filters.apply_filters(table(spark, sf, "lineitem"), [("l_tax", "> l_discount")]).select(
        "l_orderkey", "l_linenumber", "l_tax", "l_discount")


@query("SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem WHERE l_tax >= 0.04 AND l_discount >= 0.04")
def filter_regex_columns(spark, sf):
    return filters.apply_filters(table(spark, sf, "lineitem"), [("l_(tax|disc)", ">= 0.04")]).select(
        "l_orderkey", "l_linenumber", "l_tax", "l_discount")


@query("""WITH k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS c FROM events WHERE value > 20)
SELECT event_id, user_id FROM k WHERE c >= 40""")
def filter_count(spark, sf):
    return filters.apply_filters(table(spark, sf, "events"), [
        ("value", "> 20"), ("user_idnunique", ">= 40")]).select("event_id", "user_id")


@query("""WITH r AS (SELECT event_id, user_id % 5 AS fold, CASE WHEN value > 100 THEN NULL WHEN value > 60
  THEN 'nan'::DOUBLE ELSE value END AS a, CASE WHEN value < 80 THEN NULL ELSE value END AS b FROM events)
SELECT event_id, fold FROM r WHERE ((a IS NOT NULL AND NOT isnan(a)) OR b IS NOT NULL) AND fold IN (0, 2, 3)""")
def valid_responses(spark, sf):
    v = F.col("value")
    ev = table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 5).alias("fold"),
        F.when(v > 60, F.when(v <= 100, float("nan"))).otherwise(v).alias("a"), F.when(v >= 80, v).alias("b"))
    return filters.valid_responses(ev, ["a", "b"], "fold", [0, 2, 3]).select("event_id", "fold")


@query("""WITH r AS (SELECT event_type, CASE WHEN value > 100 THEN NULL ELSE value END AS v FROM events)
SELECT event_type, round(sum(coalesce(v, 0)), 4) AS total, sum(CASE WHEN v IS NULL THEN 0 ELSE 1 END)::DOUBLE AS present
FROM r GROUP BY event_type""")
def mask_and_fill(spark, sf):
    ev = table(spark, sf, "events").withColumn("value", F.when(F.col("value") <= 100, F.col("value")))
    out = T.mask_and_fill(ev, ["value"])
    return out.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"),
                                         F.sum("value_mask").alias("present"))


@query("SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def regex_predictors(spark, sf):
    li = table(spark, sf, "lineitem")
    chosen = T.matching("l_(quantity|tax)", li.columns)
    return rounded(li.agg(*[F.avg(c).alias(c) for c in chosen]))


# ---------------------------------------------------------------- transforms

_STATS = "s AS (SELECT avg(value) AS m, stddev_samp(value) AS sd FROM events)"


@query(f"""WITH {_STATS} SELECT event_id, round(value - m, 6) AS c, round((value - m) / sd, 6) AS z,
  round(value / sd, 6) AS s FROM events, s""")
def standardised(spark, sf):
    out = T.apply_ops(table(spark, sf, "events"), ["c(value)", "z(value)", "s(value)"])
    return rounded(out.select("event_id", F.col("`c(value)`").alias("c"), F.col("`z(value)`").alias("z"),
                              F.col("`s(value)`").alias("s")))


@query("""SELECT event_id, round(ln(greatest(value - 1, 1e-12)), 6) AS log, round(ln(1 + value), 6) AS log1p,
  round(exp(value / 100), 6) AS exp, round(pow(value, 0.5), 6) AS root, round(value * 3 + 2, 6) AS lin FROM events""")
def pointwise_transforms(spark, sf):
    names = {"log(subtract1(value))": "log", "log1p(value)": "log1p", "exp(divide100(value))": "exp",
             "pow0.5(value)": "root", "add2(multiply3(value))": "lin"}
    out = T.apply_ops(table(spark, sf, "events"), list(names))
    return rounded(out.select("event_id", *[F.col(f"`{k}`").alias(v) for k, v in names.items()]))


@query("""WITH l AS (SELECT event_id, ln(greatest(value, 1e-12)) AS v FROM events),
z AS (SELECT event_id, (v - (SELECT avg(v) FROM l)) / (SELECT stddev_samp(v) FROM l) AS v FROM l),
e AS (SELECT event_id, exp(v) AS v FROM z)
SELECT event_id, round(v - (SELECT avg(v) FROM e), 6) AS v FROM e""")
def composed_transforms(spark, sf):
    out = T.apply_ops(table(spark, sf, "events"), ["c(exp(z(log(value))))"])
    return rounded(out.select("event_id", F.col("`c(exp(z(log(value))))`").alias("v")))


@query("""WITH l AS (SELECT o_orderkey, ln(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, round(v, 6) AS logged, round((v - (SELECT avg(v) FROM l)) / (SELECT stddev_samp(v) FROM l), 6) AS scored
FROM l""")
def response_transforms(spark, sf):
    o = filters.apply_filters(table(spark, sf, "orders"), [("o_orderstatus", "= F")])
    out = T.add_responses(o, ["log(o_totalprice)", "z(log(o_totalprice))"])
    return rounded(out.select("o_orderkey", F.col("`log(o_totalprice)`").alias("logged"),
                              F.col("`z(log(o_totalprice))`").alias("scored")))


_PRIO = {"o_orderpriority_2_HIGH": "2-HIGH", "o_orderpriority_3_MEDIUM": "3-MEDIUM",
         "o_orderpriority_4_NOT_SPECIFIED": "4-NOT SPECIFIED", "o_orderpriority_5_LOW": "5-LOW"}


@query("SELECT o_orderkey, " + ", ".join(
    f"(CASE WHEN o_orderpriority = '{v}' THEN 1.0 ELSE 0.0 END)::DOUBLE AS {k}" for k, v in _PRIO.items()) + " FROM orders")
def dummies(spark, sf):
    out, names = T.dummies(table(spark, sf, "orders"), "o_orderpriority")
    return out.select("o_orderkey", *names)


@query("""SELECT DISTINCT o_orderpriority AS level FROM orders""")
def distinct_levels(spark, sf):
    return spark.createDataFrame([(v,) for v in T.levels(table(spark, sf, "orders"), "o_orderpriority")], "level string")


@query("""SELECT o_orderkey, (CASE WHEN k = 'b c' THEN 1.0 ELSE 0.0 END)::DOUBLE AS "k_b_c", (CASE WHEN k = 'b-c' THEN 1.0 ELSE 0.0 END)::DOUBLE AS "k_b_c_2",
  (CASE WHEN k = 'b_c' THEN 1.0 ELSE 0.0 END)::DOUBLE AS "k_b_c_3"
FROM (SELECT o_orderkey, ['a', 'b c', 'b-c', 'b_c'][1 + o_custkey % 4] AS k FROM orders)""")
def dummies_clash(spark, sf):
    """Levels whose names differ in characters only that a column name cannot have."""
    o = table(spark, sf, "orders").withColumn("k", F.get(F.lit(["a", "b c", "b-c", "b_c"]), (F.col("o_custkey") % 4).cast("int")))
    out, names = T.dummies(o, "k")
    return out.select("o_orderkey", *names)


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * coalesce(CASE WHEN l_tax > 0.02 THEN l_tax END, 1), 6) AS qt,
  (CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END)::DOUBLE AS q_n,
  (CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::DOUBLE AS q_r FROM lineitem""")
def interactions(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("tax", F.when(F.col("l_tax") > 0.02, F.col("l_tax")))
    li, flags = T.dummies(li, "l_returnflag")
    out, names = T.interactions(li, [("l_quantity", "tax"), ("l_quantity", "l_returnflag")], {"l_returnflag": flags})
    return rounded(out.select("l_orderkey", "l_linenumber",
                              *[F.col(f"`{n}`").alias(a) for n, a in zip(names, ("qt", "q_n", "q_r"))]))


@query("""SELECT round(sum(l_quantity), 4) AS a, round(sum(l_tax), 4) AS b, round(sum(l_discount), 4) AS c,
  round(sum(l_quantity * l_tax), 4) AS ab, round(sum(l_quantity * l_discount), 4) AS ac,
  round(sum(l_tax * l_discount), 4) AS bc FROM lineitem""")
def interactions_to_order(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"),
                                             F.col("l_discount").alias("c"))
    out, names = T.interactions(li, T.up_to_order(["a", "b", "c"], 2))
    return rounded(out.agg(*[F.sum(f"`{n}`").alias(n.replace(":", "")) for n in names]), 4)


@query("""SELECT round(sum(l_quantity), 4) AS a, round(sum(l_tax), 4) AS b, round(sum(l_discount), 4) AS c,
  round(sum(l_quantity * l_tax), 4) AS ab, round(sum(l_quantity * l_discount), 4) AS ac,
  round(sum(l_tax * l_discount), 4) AS bc, round(sum(l_quantity * l_tax * l_discount), 4) AS abc FROM lineitem""")
def all_interactions(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"),
                                             F.col("l_discount").alias("c"))
    out, names = T.interactions(li, T.all_interactions(["a", "b", "c"]))
    return rounded(out.agg(*[F.sum(f"`{n}`").alias(n.replace(":", "")) for n in names]), 4)


@query(f"""WITH {EV}, {pairs_sql(8)}, s AS (SELECT avg(v) AS m, stddev_pop(v) AS sd FROM q)
SELECT event_id, x_id, round((v - m) / sd, 6) AS z, round(ln(1 + v), 6) AS log1p FROM q, s""")
def pairwise_transforms(spark, sf):
    X, Y = inputs(spark, sf)
    w = window_arrays(X.withColumn("x_id", F.col("event_id")), Y, ["user_id"], ["x_id", "value"], 8, tie=["event_id"])
    long = T.masked_ops(pairs(w), "value", "z", "z")
    long = T.masked_ops(long, "value", "log1p", "log1p")
    return rounded(long.select("event_id", "x_id", "z", "log1p"))


_NAMES = {"s": "order status", "status": "status code", "P": "partial", "priority": "priority"}


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'partial' ELSE o_orderstatus END AS short,
  CASE WHEN contains(o_orderpriority, 'MEDIUM') THEN 'middling' WHEN contains(o_orderpriority, 'LOW') THEN 'low'
    WHEN contains(o_orderpriority, '-') THEN 'other' ELSE o_orderpriority END AS long FROM orders""")
def display_names(spark, sf):
    o = table(spark, sf, "orders")
    o = T.display_names(o, "o_orderstatus", _NAMES, "short")
    o = T.display_names(o, "o_orderpriority", {"-": "other", "LOW": "low", "MEDIUM": "middling"}, "long")
    return o.select("o_orderkey", "short", "long")


# ---------------------------------------------------------------- window functions


@query(f"""WITH {EV} SELECT event_id,
  coalesce(lag(value, 1) OVER w, 0) AS "valueS1", coalesce(lag(time, 2) OVER w, 0) > 0 AS has2
FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY time, event_id)""")
def lag_spillover(spark, sf):
    out = spillover(events(spark, sf), ["user_id"], ["time", "event_id"], {"value": 1, "time": 2})
    return out.select("event_id", "valueS1", (F.col("timeS2") > 0).alias("has2"))


@query("""SELECT event_id, coalesce(lag(value, 2) OVER (ORDER BY ts, event_id), 0) AS "valueS2" FROM events""")
def lag_one_series(spark, sf):
    out = spillover(events(spark, sf), [], ["time", "event_id"], {"value": 2}, layout="blocks")
    return out.select("event_id", "valueS2")


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey
  ROWS UNBOUNDED PRECEDING), 4) AS spent FROM orders""")
def running_totals(spark, sf):
    out = prefix_sum(orders_series(spark, sf), ["o_custkey"], ["time", "o_orderkey"], {"spent": F.col("o_totalprice")})
    return rounded(out.select("o_orderkey", "spent"), 4)


@query("""SELECT o_orderpriority AS level, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS code
FROM (SELECT DISTINCT o_orderpriority FROM orders)""")
def level_codes(spark, sf):
    return partition.level_codes(table(spark, sf, "orders"), "o_orderpriority").toDF("level", "code")


# ---------------------------------------------------------------- partitions

_SPLIT = """c AS (SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_custkey) - 1
  + dense_rank() OVER (ORDER BY o_orderpriority) - 1)::INTEGER AS id FROM orders)"""


@query(f"""WITH {_SPLIT} SELECT o_orderkey, id AS "splitID",
  CASE WHEN id % 4 <= 1 THEN 'train' WHEN id % 4 = 2 THEN 'dev' ELSE 'test' END AS part FROM c""")
def partition_mod(spark, sf):
    out = partition.modular_partition(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])
    return out.select("o_orderkey", "splitID", "part")


@query("""WITH f AS (SELECT unnest([0, 1, 2, 3, 4]) AS model_fold), e AS (SELECT event_id, user_id % 5 AS fold, value FROM events)
SELECT model_fold, CASE WHEN fold = model_fold THEN 'test' WHEN fold = (model_fold + 4) % 5 THEN 'dev' ELSE 'train' END AS role,
  count(*) AS n, round(sum(value), 4) AS total FROM e, f GROUP BY 1, 2""")
def crossval_folds(spark, sf):
    ev = table(spark, sf, "events").withColumn("fold", F.col("user_id") % 5)
    out = partition.fold_roles(ev, "fold", [0, 1, 2, 3, 4])
    return out.groupBy("model_fold", "role").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
