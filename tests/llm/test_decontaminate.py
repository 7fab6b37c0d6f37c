import pytest

from echoframe.llm import decontaminate as d
from tests.llm.conftest import CLASHING, ODD_ROWS
from tests.llm.plain import passages, words

ITEMS = [(1, "un deux trois quatre cinq six sept huit neuf dix onze"), (2, "same words are written here once more and then again for"),
         (3, "word"), (4, None), (None, "café"), (5, "..."), (3, "word"), (10, "nowhere to be found at all")]


def rows(df):
    return sorted(((r["key"], r["n_words"], r["n_hit"], r["items"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [200_000, 5])
def test_against_every_place(spark, odd, block, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_WORDS", block)
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = rows(d.decontaminate(odd, "doc_id", "text", tests, "item_id", "text"))
    items = [(i, t) for i, t in ITEMS if i is not None]
    want = []
    for key, text, *_ in ODD_ROWS:
        n, hit, own = passages({0: text}, items)[0]
        want.append((key, n, hit, own))
    assert got == sorted(want, key=str)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "x a b zz c d y"), (3, "a q q q b q c d"), (4, "d c b a")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    found = {s: {r["key"] for r in d.decontaminate(docs, "doc_id", "text", tests, "item_id", "text", 4, s).collect() if r["items"]} for s in (0, 1, 2)}
    assert found[0] == {1} and found[1] == {1, 2} and 3 not in found[2] and 4 not in found[1]


def test_no_rows(spark, none, odd):
    tests = spark.createDataFrame([], "item_id long, text string")
    assert all(r["n_hit"] == 0 for r in d.decontaminate(odd, "doc_id", "text", tests, "item_id", "text").collect())
    assert d.decontaminate(none, "doc_id", "text", tests, "item_id", "text").collect() == []


def test_drop(spark, odd):
    tests = spark.createDataFrame(ITEMS, "item_id long, text string")
    left = d.drop_contaminated(odd, "doc_id", "text", tests, "item_id", "text").collect()
    # The row without key and text is clean, though another row without key is not.
    assert sorted(str(r["doc_id"]) for r in left) == ["1", "2", "4", "7", "None"]
    assert all(r[c] == c for r in left for c in CLASHING)


def test_words_of_items():
    assert len(d.word_list("A b-c 9é")) == len(words("A b-c 9é")) == 4


def test_rows_are_dropped_by_their_own_text(spark, monkeypatch):
    """A shared or null key takes no clean row with it; many blocks of tests read the corpus once."""
    passage = "these ten words are the passage of a hidden test item"
    rows = [(None, f"so {passage} there"), (None, "a clean text"), (None, None), (1, passage), (1, "clean too"), (1, "clean too"), (2, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(i, f"{passage} {i}" if i == 3 else f"word{i} " * 12) for i in range(40)], "item_id int, text string")
    for words in (d.BLOCK_WORDS, 20):
        monkeypatch.setattr(d, "BLOCK_WORDS", words)
        left = d.drop_contaminated(docs, "doc_id", "text", items, "item_id", "text")
        assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted(
            [("None", "a clean text"), ("None", ""), ("1", "clean too"), ("1", "clean too"), ("2", "")])
        assert left.columns == docs.columns
