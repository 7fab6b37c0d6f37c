import math

import pytest
from pyspark.sql import functions as F

from echoframe.llm import quality as q
from tests.llm.conftest import ODD_ROWS


def test_held_out_accuracy(spark, docs):
    """Labels of one half; the other half is to be told."""
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    known = labels.where("doc_id % 2 = 0")
    got = q.classify(docs, "doc_id", "text", F.col("source"), F.col("lang"), known, "doc_id", ["quality", "toxic"])
    told = got.join(labels.where("doc_id % 2 = 1"), F.col("key") == F.col("doc_id"))
    good, clean, caught = told.agg(
        F.avg(((F.col("quality_probability") >= 0.5) == (F.col("quality") == 1)).cast("int")),
        F.avg(F.when(F.col("toxic") == 0, (F.col("toxic_probability") < 0.5).cast("int"))),
        F.avg(F.when(F.col("toxic") == 1, (F.col("toxic_probability") >= 0.5).cast("int")))).head()
    assert good > 0.97 and clean > 0.98 and caught > 0.8


def posteriors(spark, rows):
    df = spark.createDataFrame(rows, "id long, h string, p string, e double")
    return {r["id"]: r["site"] for r in q.site_posteriors(df, "h", "p", "e").collect()}


def test_against_the_formula(spark):
    rows = [(i, f"h{i % 4}", f"p{i % 3}", float((i * 7 % 10) < (2, 9, 5, 5)[i % 4])) for i in range(120)]
    got = posteriors(spark, rows)
    mean = sum(r[3] for r in rows) / len(rows)

    def group(of):
        out = {}
        for r in rows:
            g = out.setdefault(of(r), [0.0, 0])
            g[0] += r[3]
            g[1] += 1
        return out

    hosts, paths = group(lambda r: r[1]), group(lambda r: (r[1], r[2]))

    def strength(groups, prior):
        n = sum(g[1] for g in groups.values())
        squares = sum(g[1] * (g[0] / g[1] - prior(k)) ** 2 for k, g in groups.items())
        noise = sum(prior(k) * (1 - prior(k)) for k in groups)
        spread = sum(g[1] * prior(k) * (1 - prior(k)) for k, g in groups.items())
        if squares <= noise:
            return q.MOST_PRIOR
        return min(max(spread / n / ((squares - noise) / n) - 1, q.LEAST_PRIOR), q.MOST_PRIOR)

    s0 = strength(hosts, lambda k: mean)
    host_mean = {k: (g[0] + s0 * mean) / (g[1] + s0) for k, g in hosts.items()}
    s1 = strength(paths, lambda k: host_mean[k[0]])
    for i, h, p, e in rows:
        hm = (hosts[h][0] - e + s0 * mean) / (hosts[h][1] - 1 + s0)
        x = (paths[h, p][0] - e + s1 * hm) / (paths[h, p][1] - 1 + s1)
        assert got[i] == pytest.approx(math.log(x / (1 - x)) - math.log(mean / (1 - mean)))


def test_sparse_sites_stay_near_the_prior(spark):
    rows = [(i, "bad" if i % 2 else "good", "", 0.0 if i % 2 else 1.0) for i in range(200)] + [(900, "new", "", 0.0), (901, "new", "", 0.0)]
    got = posteriors(spark, rows)
    assert got[0] > 1 and got[1] < -1 and -abs(got[1]) < got[900] < 0


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1, 0), (3, 0, 1), (3, 0, 1), (None, 1, 0), (8, None, None), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = q.classify(odd, "doc_id", "text", F.col("source"), F.col("lang"), labels, "doc_id", ["quality", "toxic"]).collect()
    assert len(got) == len(ODD_ROWS) and all(0 <= r["quality_probability"] <= 1 for r in got)
    empty = labels.where("false")
    got = q.classify(odd, "doc_id", "text", F.col("source"), F.col("lang"), empty, "doc_id", ["quality"]).collect()
    assert {round(r["quality_probability"], 6) for r in got} == {0.5}
    assert q.classify(none, "doc_id", "text", F.col("source"), F.col("lang"), labels, "doc_id", ["quality"]).collect() == []


def test_addresses(spark):
    df = spark.createDataFrame([("http://www.A.org/x/y?z",), ("https://b.org",), ("no address",), (None,)], "u string")
    got = [tuple(r) for r in df.select(q.host_of(F.col("u")), q.path_of(F.col("u"))).collect()]
    assert got == [("a.org", "x"), ("b.org", ""), (None, ""), (None, "")]


def test_one_key_for_all_rows(spark, monkeypatch):
    rows = [(1, f"some words of text number {i}", i % 2) for i in range(5000)]
    seen = []
    monkeypatch.setattr(q, "train", lambda s, of, at, y: seen.append(len(y)))
    q.fit(spark.createDataFrame(rows, "k long, text string, label int"), "k", "text", "label", sample=300)
    q.fit(spark.createDataFrame([(1, "the same", 1)] * 5000, "k long, text string, label int"), "k", "text", "label", sample=300)
    assert 200 < seen[0] <= 300 and seen[1] == 1
