import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from echoframe.llm import near
from tests.llm.conftest import CLASHING
from tests.llm.plain import near as plain


def table(spark, texts):
    return spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")


def result(df):
    return {r["key"]: (r["class_id"], r["n_links"]) for r in df.collect()}


@pytest.fixture(scope="module")
def families():
    """Groups of near copies with one to many changed words, exact copies, and texts of their own."""
    rng, texts, key = random.Random(5), {}, 0
    for size in (1, 1, 2, 3, 5, 40, 90):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = f"v{rng.randrange(10**6)}"
            texts[key] = " ".join(w)
            key += 1
    return texts


@pytest.mark.parametrize("block", [400, 16])
def test_against_all_pairs(spark, families, block, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", block)
    want, pairs = plain(families)
    assert result(near.near_duplicates(table(spark, families), "doc_id", "text")) == want
    got = near.near_duplicates(table(spark, families), "doc_id", "text", list_pairs=True)
    # Pairs are of classes of equal sets: each has one representative.
    first = {}
    for k, t in sorted(families.items()):
        first.setdefault(t, k)
    rep = {k: first[t] for k, t in families.items()}
    assert {tuple(sorted((r["one"], r["two"]))) for r in got.collect()} == {tuple(sorted((rep[a], rep[b]))) for a, b in pairs}


@pytest.mark.parametrize("threshold", [1.0, 0.95, 0.8, 0.5, 0.2])
def test_forest_holds_at_the_threshold(threshold):
    trees, depth = near.forest(threshold)
    assert 1 - (1 - threshold**depth) ** trees >= near.RECALL
    assert depth == near.LONGEST or 1 - (1 - threshold ** (depth + 1)) ** trees < near.RECALL


def test_easy_links_hide_no_hard_ones(spark):
    """A large group of lightly edited copies takes no links from pairs that are just similar enough."""
    rng, texts = random.Random(9), {}
    base = [f"w{i}" for i in range(200)]
    for k in range(2500):
        w = list(base)
        w[rng.randrange(200)] = f"v{k}"
        texts[k] = " ".join(w)
    for k in range(100):
        w = [f"p{k}x{i}" for i in range(184)]
        texts[5000 + 2 * k] = " ".join(w)
        for i in (20, 60, 100, 140):
            w[i] = "changed"
        texts[5001 + 2 * k] = " ".join(w)
    got = result(near.near_duplicates(table(spark, texts), "doc_id", "text"))
    # 160 of 200 shingles are shared: the similarity is the threshold.
    assert sum(got[5001 + 2 * k] == (5000 + 2 * k, 1) for k in range(100)) >= 99
    assert all(got[k] == (0, 2499) for k in range(2500))


def test_documents(docs, texts):
    want, _ = plain(texts)
    got = result(near.near_duplicates(docs, "doc_id", "text"))
    found = sum(n for _, n in got.values())
    assert set(got) == set(want) and found >= 0.99 * sum(n for _, n in want.values())
    assert all(got[k][1] <= want[k][1] for k in want)


def test_odd_rows(spark, odd, none):
    got = near.near_duplicates(odd, "doc_id", "text").collect()
    assert len(got) == odd.count()
    same = [r for r in got if r["n_links"]]
    assert sorted(str(r["key"]) for r in same) == ["5", "5", "6", "None"] and {(r["class_id"], r["n_links"]) for r in same} == {(5, 3)}
    assert near.near_duplicates(none, "doc_id", "text").collect() == []
    left = near.deduplicate(odd, "doc_id", "text").collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted(["1", "2", "3", "4", "5", "7", "8", "None"])
    assert all(r[c] == c for r in left for c in CLASHING)
    assert near.deduplicate(none, "doc_id", "text").columns == none.columns


def test_survivors_of_null_and_repeated_keys(spark):
    w = [f"w{i}" for i in range(100)]
    texts = {n: " ".join([*w[:50], n, *w[51:]]) for n in "abc"}
    other = {n: " ".join(["z" + x for x in w[:50]] + [n] + ["z" + x for x in w[51:]]) for n in "de"}
    rows = [(None, texts["a"], "1"), (None, texts["b"], "2"), (None, texts["c"], "3"), (7, other["d"], "4"), (7, other["e"], "5"), (None, other["d"], "6"),
            *[(None, t, str(n)) for n, t in enumerate((None, None, "", "", "!!!", "!!!"), 7)], (9, "é", "13"), (9, "é", "14"), (9, "é.", "15")]
    got = [r["more"] for r in near.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, more string"), "doc_id", "text").collect()]
    assert len(got) == len(set(got)) == 9 and set(got) >= {str(n) for n in range(7, 13)}
    assert [len(set(got) & x) for x in ({"1", "2", "3"}, {"4", "5"}, {"13", "14", "15"})] == [1, 1, 1]


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (102, 101)], "node long, leader long")
    got = {r["node"]: r["root"] for r in near.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in (100, 101, 102))


def edges(spark, texts, threshold=0.8):
    trees, depth = near.forest(threshold)
    rows = near.signatures(table(spark, texts), "doc_id", "text", trees, depth).withColumnRenamed("at", "node")
    return near.candidates(rows.select("node", "prefixes", "sketch").cache(), trees, depth, threshold).cache()


def test_shared_templates_make_no_cells(spark):
    """Documents that have a passage in common, but are not similar, are not even compared."""
    rng = random.Random(6)
    template = [f"t{i}" for i in range(100)]
    texts = {k: " ".join(template + [f"w{rng.randrange(10**7)}" for _ in range(115)]) for k in range(2000)}
    assert edges(spark, texts).count() <= 5
    assert all(n == 0 for _, n in result(near.near_duplicates(table(spark, texts), "doc_id", "text")).values())


def test_prefixes_are_shortened(spark):
    """Copies meet at the longest prefixes, pairs at the threshold at short ones; a leader stands for its copies."""
    rng, texts = random.Random(7), {}
    base = [f"w{i}" for i in range(200)]
    for k in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"v{k}"
        texts[k] = " ".join(w)
    found = edges(spark, texts)
    assert found.agg(F.max("length")).head()[0] == near.LONGEST
    few = near.contracted(near.contracted(found)).collect()
    assert len(few) < 1.5 * 300 and len({r["node"] for r in few}) == 299
    assert {r["root"] for r in near.components(found).collect()} == {r["root"] for r in near.components(near.contracted(found)).collect()} == {0}
    hard = {}
    for k in range(150):
        w = [f"p{k}x{i}" for i in range(184)]
        hard[2 * k] = " ".join(w)
        for i in (20, 60, 100, 140):
            w[i] = "changed"
        hard[2 * k + 1] = " ".join(w)
    got = edges(spark, hard).collect()
    short = Counter(r["length"] for r in got)
    assert sum(short.values()) >= 149 and len(short) >= 3


def test_hot_prefixes_are_dealt_out(spark, families, monkeypatch):
    monkeypatch.setattr(near, "HOT", 8)
    want, _ = plain(families)
    assert result(near.near_duplicates(table(spark, families), "doc_id", "text")) == want


def test_survivor_among_rows_equal_in_key_and_text(spark):
    rows = [(1, "one two three four five six", str(n)) for n in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, more string")
    first = {near.deduplicate(df.repartition(n), "doc_id", "text").collect()[0]["more"] for n in (1, 3, 7)}
    assert len(first) == 1
