import pytest
from pyspark.sql import functions as F

from echoframe.operators.compare import metrics
from echoframe.sources import tables as S


def test_reading_and_joining_column_files(spark, tmp_path):
    (tmp_path / "x1.csv").write_text("subject time a\n1 0.5 2\n1 0.1 3\n2 1.0 nan\n")
    (tmp_path / "x2.csv").write_text("subject time a b\n1 2.5 4 7\n")
    (tmp_path / "f1.csv").write_text("subject time c\n1 0.2 1\n")
    (tmp_path / "f2.csv").write_text("subject time c\n2 0.2 1\n")
    (tmp_path / "y.csv").write_text("subject time y item\n1 3 10 3\n2 4 11 4\n")
    p = lambda n: str(tmp_path / n)
    X, Y = S.read_tabular_data(spark, [f"{p('x1.csv')};{p('f1.csv')}", f"{p('x2.csv')};{p('f2.csv')}"], p("y.csv"),
                               ["subject"], ["item", "subject:item"])
    assert len(X) == 2 and len(Y) == 1
    rows = {(r.subject, r.time): (r.a, r.b, r.rate, r.trial) for r in X[0].collect()}
    assert rows[("1", 0.1)] == (3.0, None, 1.0, 1.0) and rows[("1", 2.5)] == (4.0, 7, 1.0, 3.0)
    assert rows[("2", 1.0)][0] is None
    assert [r["subject:item"] for r in Y[0].orderBy("time").collect()] == ["1:3", "2:4"]
    with pytest.raises(ValueError):
        S.split_column_files(["a;b", "c"])
    with pytest.raises(ValueError):
        S.prepare_events(spark.createDataFrame([(1.0, 1.0)], "time double, rate double"), [])


def test_partition_strings():
    for spec in ("train-dev", "train+dev", "train:dev", "train dev", ["train", "dev"]):
        assert S.partition_names(spec) == ["train", "dev"]
    paths = {"train": ["a", "b"], "dev": ["b", "c"]}
    assert S.partition_paths("train-dev", paths) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        S.partition_paths("test", paths)


def test_partitioned_sink(spark, tmp_path):
    df = spark.createDataFrame([(1.0, "train"), (None, "dev")], "v double, part string")
    S.write_partitions(df, str(tmp_path / "out"))
    text = next((tmp_path / "out" / "part=dev").glob("*.csv")).read_text().split()
    assert text == ["v", "nan"]
    S.write_results(df, str(tmp_path / "res"), {"model": "m", "partition": F.col("part")})
    assert spark.read.parquet(str(tmp_path / "res")).where("model = 'm'").count() == 2
    with pytest.raises(ValueError):
        S.write_results(df, str(tmp_path / "res"), {"fol": "a"})


def test_columns_meet_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time x\n1 10\n")
    (tmp_path / "b.csv").write_text("x time z\n20 2 5\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    for schema in (None, "time double, x int, z int"):
        got = {(r.time, r.x, r.z) for r in S.read_table(spark, paths, schema).collect()}
        assert got == {(1.0, 10, None), (2.0, 20, 5)}


def test_reading_results(spark, tmp_path):
    at = str(tmp_path / "results")

    def put(keys, rows, columns="obs double, pred double, loglik double, n_obs int"):
        S.write_results(spark.createDataFrame(rows, columns), at, keys)

    put({"model": "m", "kind": "direct", "response": "y", "partition": "dev"}, [(1.0, 2.0, -1.0, 9), (3.0, 3.0, -2.0, 9)])
    put({"model": "m", "fold": "01", "member": "1", "response": "y", "partition": "test"}, [(1.0, 0.0, -1.0, 9)])
    put({"model": "m", "fold": "b", "member": "1", "response": "y", "partition": "test"}, [(5.0, 2.0, -4.0, 9)])
    put({"model": "x", "kind": "2step", "partition": "train"}, [(4.0,)], "loss double")
    df = S.read_results(spark, at)
    got = {(r.model, r.kind, r.fold, r.member, r.response, r.partition, r.value) for r in df.collect()}
    assert got == {("m", "direct", None, None, "y", "dev", 1.0), ("m", "direct", None, None, "y", "dev", 0.0),
                   ("m", None, "01", "1", "y", "test", 1.0), ("m", None, "b", "1", "y", "test", 9.0)}
    assert S.read_results(spark, at, "loglik").agg(F.sum("value")).first()[0] == -8.0
    assert [(r.model, r.value) for r in S.read_results(spark, at, "loss").collect()] == [("x", 4.0)]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 4.0), (3.0, 3.0)], "y double, p double")
    m = metrics(df, "y", "p").first()
    assert m.mse == pytest.approx(4 / 3) and m.mae == pytest.approx(2 / 3) and m.pve == 0.0
