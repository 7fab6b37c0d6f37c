"""Windows and convolutions against brute force, in both layouts."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoframe.functions import kernels as K
from echoframe.functions.transforms import zero_filled
from echoframe.operators.convolve import Conv, Source, convolve, convolve_exponential, convolve_many
from echoframe.operators.windows import WINDOW, pairs, window_arrays, window_counts

EPS = 1.1920929e-07
LAYOUTS = [dict(layout="series"), dict(layout="blocks", blocks=7)]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    X = pd.DataFrame(dict(s=rng.choice([1, 2, 3], 200, p=[0.8, 0.15, 0.05]), time=rng.integers(0, 50, 200) * 1.0,
                          v=rng.normal(size=200), id=np.arange(200)))
    Y = pd.DataFrame(dict(s=rng.choice([1, 2, 4], 120), time=rng.integers(0, 50, 120) * 1.0, rid=np.arange(120)))
    return X, Y


def brute(X, Y, history, future, cutoff, inclusive=True):
    out = {}
    for y in Y.itertuples():
        e = X[X.s == y.s].sort_values(["time", "id"])
        t = e.time.to_numpy()
        n = int((t <= y.time + EPS).sum() if inclusive else (t < y.time).sum())
        m = int((t < y.time - EPS).sum())
        lo = max(n - history, 0) if history else m
        hi = n if not future else min(max(n if history else m, m + future), len(t))
        w = e.iloc[lo:hi]
        if cutoff:
            w = w[(w.time - y.time).abs() <= cutoff]
        out[y.rid] = list(w.id)
    return out


@pytest.mark.parametrize("layout", LAYOUTS, ids=["series", "blocks"])
@pytest.mark.parametrize("history,future,cutoff,inclusive", [
    (5, 0, None, True), (5, 0, 3.0, True), (3, 2, None, True), (0, 4, None, True), (1, 6, 2.0, True),
    (4, 0, None, False), (300, 0, None, True)])
def test_windows_match_brute_force(spark, data, history, future, cutoff, inclusive, layout):
    X, Y = data
    w = window_arrays(spark.createDataFrame(X), spark.createDataFrame(Y), ["s"], ["id"], history, future, cutoff,
                      tie=["id"], inclusive=inclusive, **layout)
    got = {r.rid: [e.id for e in r[WINDOW]] for r in w.collect()}
    assert got == brute(X, Y, history, future, cutoff, inclusive)


@pytest.mark.parametrize("layout", LAYOUTS, ids=["series", "blocks"])
def test_copies_of_events_and_responses(spark, layout):
    """Copies may be most of the table: all responses come back, windows hold what they should."""
    X = spark.createDataFrame([(1, 5.0, 2.0)] * 300 + [(1, float(t), 1.0) for t in range(10)], "s int, time double, v double")
    Y = spark.createDataFrame([(1, 5.5, "a")] * 40 + [(1, 9.0, "b")], "s int, time double, k string")
    rows = convolve(Y, [Source(X, [Conv("f", "v", K.Exp(0.5))])], ["s"], 6, **layout).collect()
    assert len(rows) == 41
    a = {round(r.f, 9) for r in rows if r.k == "a"}
    at = 0.5 * math.exp(-0.25)
    assert a in ({round(6 * 2 * at, 9)}, {round((5 * 2 + 1) * at, 9)})
    # At 9: events at 9, 8, 7, 6, then two of the copies at 5 (or one copy and the other event there).
    b = [r.f for r in rows if r.k == "b"][0]
    recent = sum(0.5 * math.exp(-0.5 * d) for d in (0, 1, 2, 3))
    assert any(abs(b - recent - x * 0.5 * math.exp(-2.0)) < 1e-9 for x in (4.0, 3.0))


def frame(spark, rows, schema="s int, time double, v double"):
    return spark.createDataFrame(rows, schema)


def windows_of(spark, X, Y, **kw):
    w = window_arrays(frame(spark, X), frame(spark, Y, "s int, time double"), ["s"], ["v"], **kw)
    return {(r.s, r.time): [e.time for e in r[WINDOW]] for r in w.collect()}


def test_tie_is_included(spark):
    got = window_arrays(frame(spark, [(1, 0.0, 2.0), (1, 5.0, 3.0)]), frame(spark, [(1, 5.0)], "s int, time double"),
                        ["s"], ["v"])
    assert [round(r.t_delta, 9) for r in pairs(got).orderBy("t_delta").collect()] == [0.0, 5.0]


def test_cutoff_edge(spark):
    X = [(1, float(t), 1.0) for t in range(1, 8)]
    got = windows_of(spark, X, [(1, 4.0), (1, 6.0)], cutoff=3.0)
    assert got == {(1, 4.0): [1, 2, 3, 4], (1, 6.0): [3, 4, 5, 6]}


def test_history_clip_and_future(spark):
    X = [(1, float(t), 1.0) for t in range(10)]
    assert windows_of(spark, X, [(1, 9.0)], history=3) == {(1, 9.0): [7, 8, 9]}
    assert windows_of(spark, X, [(1, 4.0)], history=2, future=2) == {(1, 4.0): [3, 4, 5]}


def test_empty_windows_and_gap_series(spark):
    assert windows_of(spark, [(1, 5.0, 1.0)], [(1, 1.0), (2, 9.0)]) == {(1, 1.0): [], (2, 9.0): []}
    X = [(1, 0.0, 1.0), (3, 0.0, 1.0)]
    assert windows_of(spark, X, [(1, 1.0), (2, 1.0), (3, 1.0)]) == {(1, 1.0): [0], (2, 1.0): [], (3, 1.0): [0]}


def test_null_series_matches_nothing(spark):
    assert windows_of(spark, [(None, 0.0, 1.0)], [(None, 1.0)]) == {(None, 1.0): []}


def test_missing_values_add_nothing(spark):
    X = frame(spark, [(1, 0.0, None), (1, 1.0, float("nan")), (1, 2.0, 1.0)])
    Y = frame(spark, [(1, 2.0)], "s int, time double")
    row = convolve(Y, [Source(X, [Conv("f", "v", K.Exp(1.0)), Conv("g", "v")])], ["s"]).first()
    assert row.f == pytest.approx(1.0) and row.g == pytest.approx(1.0)
    assert [r.v for r in X.select(zero_filled(X, "v").alias("v")).collect()] == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("layout", LAYOUTS, ids=["series", "blocks"])
def test_unclipped_exponential_equals_windows(spark, data, layout):
    X, Y = (spark.createDataFrame(d) for d in data)
    a = convolve(Y, [Source(X, [Conv("f", "v", K.Exp(0.3))], tie=["id"])], ["s"], 100_000)
    b = convolve_exponential(Y, X, ["s"], "v", 0.3, "g", **layout)
    both = a.select("rid", "f").join(b.select("rid", "g"), "rid")
    assert both.count() == 120
    assert both.agg(F.max(F.abs(F.col("f") - F.col("g")))).first()[0] < 1e-9
    steep = convolve_exponential(Y, X, ["s"], "v", 40.0, "g", **layout).agg(F.count("g")).first()[0]
    assert steep == 120


def test_convolution_is_linear_and_shift_invariant(spark, data):
    X, Y = (spark.createDataFrame(d) for d in data)
    X = X.withColumn("w", F.col("v") * 2 + 1).withColumn("one", F.lit(1.0))
    k = K.Gamma(2.0, 0.4)
    src = Source(X, [Conv("v1", "v", k), Conv("w1", "w", k), Conv("o1", "one", k)], tie=["id"])
    base = convolve(Y, [src], ["s"], 6)
    assert base.agg(F.max(F.abs(F.col("w1") - F.col("v1") * 2 - F.col("o1")))).first()[0] < 1e-9
    moved = convolve(Y.withColumn("time", F.col("time") + 1000),
                     [Source(X.withColumn("time", F.col("time") + 1000), [Conv("m1", "v", k)], tie=["id"])], ["s"], 6)
    both = base.select("rid", "v1").join(moved.select("rid", "m1"), "rid")
    assert both.agg(F.max(F.abs(F.col("v1") - F.col("m1")))).first()[0] < 1e-6


@pytest.mark.parametrize("layout", LAYOUTS, ids=["series", "blocks"])
def test_counts(spark, data, layout):
    X, Y = data
    got = {r.rid: (r.n_before, r.n_within) for r in window_counts(
        spark.createDataFrame(X), spark.createDataFrame(Y), ["s"], 5.0, **layout).collect()}
    for y in Y.itertuples():
        t = X[X.s == y.s].time
        before = t[t <= y.time + EPS]
        assert got[y.rid] == (len(before), int((before >= y.time - 5.0).sum()))


def test_causal_kernels_refuse_future(spark, data):
    X, Y = (spark.createDataFrame(d) for d in data)
    with pytest.raises(ValueError):
        convolve(Y, [Source(X, [Conv("f", "v", K.Exp(1.0))])], ["s"], 3, future=2)
    convolve(Y, [Source(X, [Conv("f", "v", K.Normal(0.0, 1.0))])], ["s"], 3, future=2)


def test_one_shuffle_for_windows(spark, data):
    """The windows themselves are never shuffled: one exchange, however long the history."""
    X, Y = (spark.createDataFrame(d) for d in data)
    out = convolve(Y, [Source(X, [Conv("f", "v", K.Exp(1.0))], tie=["id"])], ["s"], 128, layout="series")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.mark.parametrize("layout", LAYOUTS, ids=["series", "blocks"])
def test_responses_with_map_columns(spark, layout):
    X = frame(spark, [(1, float(t), 1.0) for t in range(6)])
    Y = spark.createDataFrame([(1, 5.0, {"a": 1})], "s int, time double, m map<string, int>")
    w = window_arrays(X, Y, ["s"], ["v"], 3, **layout).first()
    assert [e.time for e in w[WINDOW]] == [3.0, 4.0, 5.0] and w.m == {"a": 1}
    assert convolve(Y, [Source(X, [Conv("f", "v", K.Exp(1.0))])], ["s"], 3, **layout).first().f > 1


def test_long_form_of_future_windows(spark):
    """Unfolding a window must not meet ranges of rows that are no responses."""
    X = frame(spark, [(1, float(t), 1.0) for t in range(40)])
    Y = frame(spark, [(1, float(t) + 0.5) for t in range(40)], "s int, time double")
    got = pairs(window_arrays(X, Y, ["s"], ["v"], 3, 2)).groupBy("time").count()
    assert {r.time: r["count"] for r in got.collect()}[20.5] == 5


@pytest.mark.parametrize("blocks", [2, 5, 9])
@pytest.mark.parametrize("tie", [[], ["id"]])
def test_ranks_in_both_layouts(spark, blocks, tie):
    """An event's position in its series, whatever the layout; identical events count each."""
    rows = [(s, float(t // 3), 1.0, i) for s in (1, 2) for i, t in enumerate(range(40))]
    X = spark.createDataFrame(rows + [(1, 5.0, 1.0, 100)] * 12, "s int, time double, v double, id long")
    X = X if tie else X.drop("id")
    Y = frame(spark, [(s, float(t) + 0.5) for s in (1, 2) for t in range(0, 13, 2)], "s int, time double")
    got = []
    for layout in ({"layout": "series"}, {"layout": "blocks", "blocks": blocks}):
        w = pairs(window_arrays(X, Y, ["s"], ["v"], 4, 2, tie=tie, **layout))
        got.append(sorted((r.s, r.time, r.event_time, r.event_rank) for r in w.collect()))
    assert got[0] == got[1]


@pytest.mark.parametrize("history,future", [(3, 0), (2, 3), (0, 2), (7, 1)])
def test_many_tables_in_one_exchange(spark, history, future):
    """Several event and response tables at once give what each pair of them gives."""
    rng = np.random.default_rng(history + 10 * future)
    frame = lambda n, c: spark.createDataFrame([(int(s) if s < 4 else None, float(t), i, float(v)) for i, (s, t, v) in enumerate(zip(
        rng.integers(0, 5, n), rng.integers(0, 30, n), rng.normal(size=n)))], f"s int, time double, id long, {c} double")
    x1, x2, ys = frame(80, "u"), frame(60, "v"), [frame(40, "y"), frame(25, "z")]
    kernel = (K.Normal(0.0, 4.0, support_lb=None), K.Normal(1.0, 3.0, support_lb=None))
    sources = [Source(x1, [Conv("a", "u", kernel[0]), Conv("b", "u", kernel[1])], tie=["id"]), Source(x2, [Conv("c", "v", kernel[0])], tie=["id"])]
    got = convolve_many(ys, sources, ["s"], history, future, cutoff=6.0, layout="series")
    for y, table in zip(ys, got):
        for src in sources:
            names = [t.name for t in src.terms]
            want = {r["id"]: [r[n] for n in names] for r in convolve(y, [src], ["s"], history, future, cutoff=6.0, layout="series").collect()}
            have = {r["id"]: [r[n] for n in names] for r in table.collect()}
            assert set(want) == set(have) and all(have[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    plan = got[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange ") == 1
