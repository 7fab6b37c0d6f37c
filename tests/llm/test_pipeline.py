"""The pipeline's stages against plain versions of them."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from echoframe.llm import language, secrets
from tests.llm import plain
from tests.llm.conftest import SMALL


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(small):
    return {r["doc_id"]: r["text"] for r in small.collect()}


def kept(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_languages(spark, small, texts):
    more = small.unionByName(spark.createDataFrame([(9001, "1234 !!", "en", "s", 7), (9002, None, "en", "s", 0)], small.schema))
    left = kept(cp.known_languages(spark, more, SMALL))
    assert len(texts) - len(left) <= 0.02 * len(texts) and set(left) <= set(texts)
    network = language.fit(more, "doc_id", "text", "lang", F.lit(True))
    scored = language.predict(more, "doc_id", "text", network).where("lang_pred <> 'und' and score >= 0.4")
    assert {r["key"] for r in scored.collect()} == set(left)


def test_near_duplicates(spark, small, texts):
    classes, _ = plain.near(texts)
    assert set(kept(cp.without_near_duplicates(spark, small, SMALL))) == {k for k, (c, _) in classes.items() if c == k}


def test_benchmark(spark, small, texts):
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    want = {k for k, (_, hit, _) in plain.passages(texts, items).items() if not hit}
    assert set(kept(cp.without_benchmark(spark, small, SMALL))) == want


def test_secrets(spark, small, texts):
    planted = [(9001, "so token = 'abcdefgh12' is", "en", "s", 26), (9002, "AKIA" + "Z" * 16, "en", "s", 20), (9003, None, None, None, 1)]
    small = small.unionByName(spark.createDataFrame(planted, small.schema))
    texts = texts | {k: t for k, t, *_ in planted}
    left = cp.without_secrets(spark, small, SMALL)
    assert left.columns == small.columns and left.where("n_chars <> coalesce(length(text), -1) and text is not null").isEmpty()
    got = kept(left)
    changed = 0
    for k, t in texts.items():
        if not any(m.end(r.group) - m.start(r.group) >= r.least for r in secrets.RULES for m in re.finditer(r.pattern, t or "")):
            assert got[k] == t
        else:
            changed += 1
            assert got[k] != t and not re.search(r"AKIA[A-Z0-9]{12}|[0-9a-f]{32}", got[k])
    assert changed >= 2


def test_run(spark):
    rows = cp.run(spark, SMALL).collect()
    docs, n = {r["doc_id"] for r in rows}, {}
    for r in rows:
        n[r["sequence_id"]] = n.get(r["sequence_id"], 0) + r["length"]
    assert len(docs) > 100 and max(n.values()) == 2048 and sum(v < 2048 for v in n.values()) <= 1


def test_empty(spark, small, none):
    docs = none.select(*small.columns)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SMALL)
        assert docs.collect() == []
        docs = none.select(*small.columns)
