import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from echoframe.llm import language as lg
from echoframe.llm.queries import held_out
from echoframe.llm.text import utf8
from tests.llm.conftest import CLASHING, ODD_ROWS


@pytest.fixture(scope="module")
def network(docs):
    return lg.fit(docs, "doc_id", "text", "lang", ~held_out("doc_id"), per_language=600)


def test_held_out_accuracy(docs, network):
    got = lg.predict(docs, "doc_id", "text", network).join(docs, F.col("key") == F.col("doc_id"))
    right = got.where(held_out("doc_id")).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).head()
    assert right[0] > 0.97 and right[1] > 200


def test_same_rows_same_network(docs, network):
    again = lg.fit(docs.repartition(5), "doc_id", "text", "lang", ~held_out("doc_id"), per_language=600)
    assert all((a == b).all() for a, b in zip(network.filters, again.filters))


def test_tables_are_the_convolution(network):
    rng = np.random.default_rng(1)
    m = rng.integers(0, 256, (5, lg.WINDOW)).astype(np.uint8)
    got = network.pooled(m, network.tables())
    want = []
    for f in network.filters:
        n = lg.WINDOW - len(f) + 1
        want.append(sum(f[j][m[:, j:j + n]] for j in range(len(f))).max(axis=1))
    assert np.allclose(got, np.maximum(np.concatenate(want, axis=1) + network.bias, 0), atol=1e-4)


def test_windows_cover_texts():
    data, at = utf8(pa.array(["a" * 600, "", None, "B1"]))
    start, end, text = lg.windows(data, at)
    assert text.tolist() == [0, 0, 0, 3] and (end - start).sum() == 602
    assert lg.matrix(data, start, end)[3, :3].tolist() == [0x62, 0x20, 0x20]


def test_odd_rows(spark, odd, none, network):
    got = {(r["key"], r["lang_pred"] == "und", r["score"] > 0) for r in lg.predict(odd, "doc_id", "text", network).collect()}
    assert {(1, True, False), (2, True, False), (4, True, False), (3, False, True), (7, False, True)} <= got
    assert lg.predict(none, "doc_id", "text", network).collect() == []
    df = spark.createDataFrame([(1, "日本語"), (2, "١٢٣ ²"), (3, "É")], "id long, text string")
    assert [r["lang_pred"] == "und" for r in lg.predict(df, "id", "text", network).orderBy("key").collect()] == [False, True, False]
    kept = lg.keep_known(odd, "text", network).collect()
    assert {r["doc_id"] for r in kept} >= {5, 6, 7} and {r["doc_id"] for r in kept}.isdisjoint({1, 2, 4})
    assert all(r[c] == c for r in kept for c in CLASHING) and len(kept) < len(ODD_ROWS)


def test_nothing_to_learn_from(odd, none):
    assert lg.fit(none, "doc_id", "text", "lang", F.lit(True)) is None
    assert {r["lang_pred"] for r in lg.predict(odd, "doc_id", "text", None).collect()} == {"und"}


def test_one_key_for_all_rows(spark, monkeypatch):
    """A shared key draws neither everything nor nothing; copies of one row neither."""
    rows = [(102, f"some words of text number {i}", "en") for i in range(4000)] + [(59, f"quelques mots du texte {i}", "fr") for i in range(4000)]
    rows += [(None, "immer derselbe Text", "de")] * 2000
    seen = []
    monkeypatch.setattr(lg, "train", lambda m, y, languages, **kw: seen.append((len(m), languages, sorted(set(y.tolist())))))
    lg.fit(spark.createDataFrame(rows, "k long, text string, lang string"), "k", "text", "lang", F.lit(True), per_language=200)
    n, languages, labels = seen[0]
    assert languages == ["de", "en", "fr"] and labels == [0, 1, 2] and 300 < n <= 1200
