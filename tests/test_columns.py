import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echoframe.functions import transforms as T
from echoframe.operators import filters, partition
from echoframe.operators.irf import trapezoid
from echoframe.operators.series import collapse, prefix_min, prefix_sum, repeated, running_count, spillover

LAYOUTS = [dict(layout="series"), dict(layout="blocks", blocks=5)]
IDS = ["series", "blocks"]


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(2)
    n = 150
    df = pd.DataFrame(dict(s=rng.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), t=np.arange(n) * 1.0,
                           v=rng.normal(size=n).round(3)))
    return df


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_running_count_and_sum(spark, walk, layout):
    sdf = spark.createDataFrame(walk)
    got = running_count(sdf, ["s"], ["t"], **layout).toPandas().sort_values("t")
    want = walk.groupby("s").cumcount() + 1
    assert (got.trial.to_numpy() == want.to_numpy()).all()
    got = prefix_sum(sdf, ["s"], ["t"], {"run": F.col("v")}, **layout).toPandas().sort_values("t")
    assert np.allclose(got.run, walk.groupby("s").v.cumsum())
    got = prefix_min(sdf, ["s"], ["t"], "v", "low", **layout).toPandas().sort_values("t")
    assert np.allclose(got.low, walk.groupby("s").v.cummin())


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_spillover(spark, walk, layout):
    got = spillover(spark.createDataFrame(walk), ["s"], ["t"], {"v": 3}, **layout).toPandas().sort_values("t")
    assert np.allclose(got.vS3, walk.groupby("s").v.shift(3).fillna(0.0))


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_copies_in_ordered_operations(spark, layout):
    rows = [("a", 1.0, 2.0)] * 50 + [("a", 2.0, 3.0), ("a", 3.0, 4.0)]
    sdf = spark.createDataFrame(rows, "s string, t double, v double")
    got = sorted(r.run for r in prefix_sum(sdf, ["s"], ["t"], {"run": F.col("v")}, **layout).collect())
    assert got == [2.0 * i for i in range(1, 51)] + [103.0, 107.0]
    lagged = spillover(sdf, ["s"], ["t"], {"v": 2}, **layout).collect()
    assert len(lagged) == 52
    assert sorted(r.vS2 for r in lagged) == [0.0, 0.0] + [2.0] * 50
    assert {(r.t, r.vS2) for r in lagged if r.t > 1} == {(2.0, 2.0), (3.0, 2.0)}


def test_collapse_and_repeat(spark):
    sdf = spark.createDataFrame([(1,)] * 25 + [(2,)], "k int")
    for piece in (4, 100):
        out = repeated(collapse(sdf), 25, piece=piece)
        assert {(r.k, r._copy) for r in out.collect()} == {(1, i) for i in range(1, 26)} | {(2, 1)}


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_trapezoid(spark, walk, layout):
    got = {r.s: (r.points, r.integral) for r in trapezoid(spark.createDataFrame(walk), ["s"], "t", "v", **layout).collect()}
    for s, g in walk.groupby("s"):
        assert got[s][0] == len(g)
        assert got[s][1] == pytest.approx(np.trapezoid(g.v, g.t))
    one = trapezoid(spark.createDataFrame([("z", 1.0, 5.0)], "s string, t double, v double"), ["s"], "t", "v", **layout)
    assert one.first().integral == 5.0


def test_filters(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 1.0), ("b", 3.0, float("nan")), ("b", None, 9.0)],
                               "g string, v double, w double")
    keep = lambda *f: sorted(str(r.v) for r in filters.apply_filters(df, f).collect())
    assert keep(("v", ">= 2")) == ["2.0", "3.0"]
    assert keep(("v", "!= 2")) == ["1.0", "3.0"]
    assert keep(("w", "< inf")) == ["2.0", "None"]
    assert keep(("v", "> w")) == ["2.0"]
    assert keep(("g", "= a")) == ["1.0", "2.0"]
    assert keep(("[vw]", "> 0.5")) == ["2.0"]
    assert keep(("v", "!= abc")) == ["1.0", "2.0", "3.0"]
    assert keep(("v", "> 1"), ("gnunique", ">= 1")) == ["2.0", "3.0"]
    assert keep(("gnunique", "> 2")) == []
    with pytest.raises(ValueError):
        filters.condition(df, "v", "~ 3")


def test_valid_responses(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (float("inf"), 2.0), (float("nan"), float("inf"))],
                               "a double, b double")
    assert filters.valid_responses(df, ["a", "b"]).count() == 2


def test_transforms(spark):
    v = np.array([1.0, 2.0, 4.0, 9.0])
    df = spark.createDataFrame([(float(x),) for x in v], "x double").coalesce(1)
    out = T.apply_ops(df, ["z(log(x))", "c(x)", "s(x)", "pow0.5(x)", "divide2(add1(x))", "z.(x)"]).toPandas().sort_values("x")
    lg = np.log(v)
    assert np.allclose(out["z(log(x))"], (lg - lg.mean()) / lg.std(ddof=1))
    assert np.allclose(out["c(x)"], v - v.mean())
    assert np.allclose(out["s(x)"], v / v.std(ddof=1))
    assert np.allclose(out["pow0.5(x)"], np.sqrt(v))
    assert np.allclose(out["divide2(add1(x))"], (v + 1) / 2)
    stats: dict = {}
    T.apply_ops(df, ["z(x)"], stats=stats)
    again = T.apply_ops(spark.createDataFrame([(4.0,)], "x double"), ["z(x)"], stats=stats).first()["z(x)"]
    assert again == pytest.approx((4 - v.mean()) / v.std(ddof=1))


def test_dummies_compare_typed_values(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    out, names = T.dummies(df, "k")
    assert names == ["k_2", "k_3"]
    assert [(r.k_2, r.k_3) for r in out.orderBy("k").collect()] == [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]


def test_term_algebra():
    assert T.up_to_order(["a", "b", "c"], 2) == [("a",), ("b",), ("c",), ("a", "b"), ("a", "c"), ("b", "c")]
    assert T.crossed(["a"], ["b"]) == [("a",), ("b",), ("a", "b")]
    assert len(T.all_interactions(["a", "b", "c", "d"])) == 15
    assert T.matching("a.", ["ab", "abc", "xab"]) == ["ab"]
    assert T.identifier("4-NOT x") == "_4_NOT_x"


def test_product_skips_missing(spark):
    df = spark.createDataFrame([(2.0, None), (2.0, float("nan")), (2.0, 3.0)], "a double, b double")
    assert sorted(r[0] for r in df.select(T.product(df, ["a", "b"])).collect()) == [2.0, 2.0, 6.0]


def test_modular_partition(spark):
    df = spark.range(8).select(F.col("id").alias("splitID"))
    got = {r.splitID: r.p for r in df.select("splitID", partition.part_of(F.col("splitID")).alias("p")).collect()}
    assert [k for k, p in got.items() if p == 0] == [0, 1, 4, 5]
    assert [k for k, p in got.items() if p == 1] == [2, 6]
    assert [k for k, p in got.items() if p == 2] == [3, 7]


@pytest.mark.parametrize("layout", LAYOUTS, ids=IDS)
def test_split_id(spark, layout):
    df = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", None)], "p string, q string")
    got = {r.p: r.splitID for r in partition.split_id(df, ["p", "q"], **layout).collect()}
    assert got == {"b": 1, "a": 1, "c": 1}


def test_folds_and_names():
    plan = partition.fold_plan(["a", "b", "c"])
    assert plan[0] == {"fold": "a", "dev_fold": "c", "train": ["b"]}
    assert partition.is_nested("m!a", "m!a!b") and not partition.is_nested("m!a", "m!b")
    assert not partition.is_nested("m", "n!a") and not partition.is_nested("m", "m!a!b")
    assert list(partition.ablation_family("m", ["a", "b"])) == ["m", "m!a", "m!b", "m!a!b"]


def test_display_names(spark):
    df = spark.createDataFrame([("ab",), ("abc",), ("zz",)], "n string")
    out = T.display_names(df, "n", {"ab": "short", "abc": "long", "b": "b"}, "d")
    assert [r.d for r in out.orderBy("n").collect()] == ["short", "long", "zz"]
