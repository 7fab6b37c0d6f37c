import itertools

import numpy as np
import pytest

from echoframe.llm import personal as p
from tests.llm.conftest import MEDIUM, ODD_ROWS


@pytest.fixture(scope="module")
def model(spark):
    return p.fit(spark.read.parquet(f"{MEDIUM}/documents.parquet"), "doc_id", "text")


def test_stated():
    text = "a.b@c.de, 1.2.3.4; 1.2.3.256; 4111 1111 1111 1111; 4111 1111 1111 1112; +49 (30) 1234567; +1 23"
    got = [(text[s:e], p.KINDS[k]) for s, e, k in p.stated(text)]
    assert got == [("a.b@c.de", "email"), ("1.2.3.4", "ip"), ("4111 1111 1111 1111", "card"), ("+49 (30) 1234567", "phone")]
    assert p.stated("none at all") == [] and p.holds("ip", "001.2.3.4") and not p.holds("ip", "1.2.3.999")
    assert p.luhn("4111111111111111") and not p.luhn("4111111111111112")


def test_field_finds_what_is_stated(model, texts):
    """Without the guarantee, over all texts: the field by itself gives the stated spans."""
    want = found = extra = 0
    for t in texts.values():
        gold, got = set(p.stated(t)), set()
        for r in p.regions(t):
            got |= set(model.best(t, p.candidates(t, r, gold)))
        want, found, extra = want + len(gold), found + len(gold & got), extra + len(got - gold)
    assert want > 50 and found >= 0.95 * want and extra <= 0.1 * want


def test_other_ways_of_writing(model):
    text = "write to jane.doe (at) mail.example.com today"
    assert [text[s:e] for s, e, _ in p.spans_of(text, model)] == ["jane.doe (at) mail.example.com"]
    assert p.spans_of("page 17 of 2034 in 1999", model) == []


def test_best_is_the_best(model):
    """Dynamic programming against every set of spans that do not overlap."""
    text = "mail x.y@host.org 10.0.0.1 +49 301 234 5678 and 4111 1111 1111 1111"
    for region in p.regions(text):
        spans = p.candidates(text, region, p.stated(text))[:12]
        n, ends, have = model.lattice(text, spans)
        score = model.scores(have)
        top = 0.0
        for size in range(len(spans) + 1):
            for some in itertools.combinations(range(len(spans)), size):
                if all(spans[a][1] <= spans[b][0] for a, b in zip(some, some[1:])):
                    top = max(top, sum(score[i].max() for i in some))
        got = model.best(text, spans)
        assert sum(score[spans.index((s, e))][k] for s, e, k in got) == pytest.approx(top)


def test_marginals_sum_over_segmentations(model):
    text = "to +49 301 234 5678 now"
    spans = p.candidates(text, p.regions(text)[0], [])[:8]
    n, ends, have = model.lattice(text, spans)
    score = model.scores(have)
    total, mass = 0.0, np.zeros_like(score)
    for size in range(len(spans) + 1):
        for some in itertools.combinations(range(len(spans)), size):
            if all(spans[a][1] <= spans[b][0] for a, b in zip(some, some[1:])):
                for kinds in itertools.product(range(len(p.KINDS)), repeat=size):
                    w = np.exp(sum(score[i, k] for i, k in zip(some, kinds)))
                    total += w
                    for i, k in zip(some, kinds):
                        mass[i, k] += w
    assert np.allclose(model.marginals(n, ends, score), mass / total)


def test_odd_rows(odd, none, model):
    got = p.find_personal(odd, "doc_id", "text", model).collect()
    assert len(got) == len(ODD_ROWS) and not any(r["spans"] for r in got)
    assert p.find_personal(none, "doc_id", "text", p.fit(none, "doc_id", "text")).collect() == []


def test_untrained_field_adds_nothing(spark):
    df = spark.createDataFrame([(1, "x.y@host.org"), (1, "x.y@host.org")], "id long, text string")
    got = p.find_personal(df, "id", "text", p.Field()).collect()
    assert [[x["kind"] for x in r["spans"]] for r in got] == [["email"], ["email"]]
