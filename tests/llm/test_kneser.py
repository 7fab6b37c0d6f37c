import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.llm import arrays, kneser


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


class Plain:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = [*plain_words(t), None]
            self.uni.update(w)
            self.bi.update(zip(["^", *w[:-1]], w))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.a, self.after = Counter(w for _, w in self.bi), defaultdict(list)
        for (v, _), c in self.bi.items():
            self.after[v].append(c)
        self.d1, self.d2 = self.of(self.a.values()), self.of(self.bi.values())

    @staticmethod
    def of(counts):
        n = Counter(counts)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]

    def low(self, w):
        rest = sum(self.d1[min(c, 3)] for c in self.a.values()) / len(self.bi) if self.bi else 1
        a = self.a.get(w, 0)
        return (max(a - self.d1[min(a, 3)], 0) / len(self.bi) if a else 0) + rest / (self.v + 1)

    def p(self, v, w):
        if v not in self.after:
            return self.low(w)
        total, c = sum(self.after[v]), self.bi.get((v, w), 0)
        return max(c - self.d2[min(c, 3)], 0) / total + sum(self.d2[min(x, 3)] for x in self.after[v]) / total * self.low(w)

    def score(self, text):
        w = [*plain_words(text), None]
        base = sum(math.log10((self.uni[x] + 0.1) / (self.n + 0.1 * (self.v + 1))) for x in w)
        return len(w), sum(x in self.uni for x in w), base, sum(math.log10(self.p(v, x)) for v, x in zip(["^", *w[:-1]], w))


def check(spark, rows, usable):
    df = spark.createDataFrame(rows, "k long, text string, use boolean").repartition(3)
    model = kneser.fit(df, "text", usable)
    want = Plain([t for _, t, u in rows if u])
    assert (model.tokens, model.distinct, model.kinds) == (want.n, want.v, len(want.bi))
    got = sorted(((r["key"] is None, r["key"] or 0, r["n_tokens"], r["n_known"], r["base_score"], r["score"])
                  for r in kneser.score(df, "k", "text", model).collect()))
    told = sorted((k is None, k or 0, *want.score(t)) for k, t, _ in rows)
    assert len(got) == len(told)
    for g, w in zip(got, told):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    names = [f"w{i}" for i in range(60)] + ["The", "the", "É", "\x00", "日本"]
    return [" ".join(rng.choice(names[:rng.choice((3, 20, 65))]) for _ in range(rng.randrange(0, 80))) for _ in range(150)]


def test_against_dictionaries(spark, texts):
    rows = [(i, t, i % 4 != 0) for i, t in enumerate(texts)]
    check(spark, [*rows, (None, None, True), (900, "", False), (901, " \t\n\x0b", True), (5, texts[5], True), (5, texts[5], True),
                  (902, "unseen words only here", False), (903, "a " * 40_000 + "end", True)], F.col("use"))


def test_many_shards_and_frequent_words(spark, texts, monkeypatch):
    """Counts pass on early, and the pairs of frequent words are in several shards."""
    for module, name, value in ((kneser, "COUNTED", 50), (kneser, "SHARD_KEYS", 100), (arrays, "SHARD_KEYS", 100), (arrays, "MAPPED", 3)):
        monkeypatch.setattr(module, name, value)
    check(spark, [(i, t, i % 4 != 0) for i, t in enumerate(texts)], F.col("use"))


def test_probabilities_of_all_words_add_up_to_one(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    model = kneser.fit(df, "text", F.lit(True))
    words = sorted({w for t in texts for w in plain_words(t)})
    h = np.concatenate([kneser.tokens(*kneser.utf8(kneser.pa.array([w])))[0][:1] for w in words])
    for before in (h[0], h[5], None):
        total = 0.0
        for x in [*h, kneser.END, np.uint64(12345)]:
            pair = np.array([x] if before is None else [before, x], np.uint64)
            total += 10 ** model.log10(pair, np.array([0]))[2][-1]
        assert total == pytest.approx(1, abs=1e-9)


def test_nothing_to_learn_from(spark, none, odd):
    assert kneser.score(none, "doc_id", "text", kneser.fit(none, "text", F.lit(True))).collect() == []
    model = kneser.fit(odd, "text", F.lit(False))
    got = kneser.score(odd, "doc_id", "text", model).collect()
    assert len(got) == odd.count() and all(r["n_known"] == 0 and r["score"] == 0 for r in got)
    assert len(kneser.score(odd, "doc_id", "text", kneser.fit(odd, "text", F.lit(True))).collect()) == odd.count()


def test_arrays_are_the_same_when_written_again(spark, tmp_path):
    rows = [(int(k % 3), int(k), int(v)) for k, v in zip([5, 1, 1, 2**62, -1, -1, 4, 7], range(8))]
    df = spark.createDataFrame(rows, "shard int, key long, n long")
    made, written = arrays.store(df, [("n", "<i8")], str(tmp_path), 3, "n")
    first = sorted(map(tuple, written.collect()))
    assert sorted(map(tuple, written.collect())) == first and sum(n for _, n in first) == 6
    keys = np.array([1, 2, 2**64 - 1, 5], np.uint64)
    known, got = made(keys, np.array([1, 2, -1 % 3, 2], np.int32))
    assert known.tolist() == [True, False, True, True] and got["n"].tolist() == [3, 0, 9, 0]
    assert made(keys[:0])[0].tolist() == []
