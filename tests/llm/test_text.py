import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from echoframe.llm import text
from tests.llm.plain import shingle_set, words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbZz09é ü.-\n", max_size=40)), max_size=8))
def test_words_and_shingles(texts):
    data, at = text.utf8(pa.array(texts, pa.string()))
    h, start, end, before = text.words(data, at)
    names, seen = {}, {}
    for i, t in enumerate(texts):
        own = words(t)
        assert before[i + 1] - before[i] == len(own)
        for w, x in zip(own, h[before[i]:before[i + 1]].tolist()):
            assert names.setdefault(x, w) == w and seen.setdefault(w, x) == x
    s, first = text.shingles(h, before)
    sets = {}
    for i, t in enumerate(texts):
        want = shingle_set(t)
        got = set(s[first[i]:first[i + 1]].tolist())
        assert len(got) == len(want)
        assert sets.setdefault(frozenset(got), want) == want


def test_long_text_in_pieces(monkeypatch):
    t = "abc déf " * 2000 + "x" * 5000 + " end"
    whole = text.words(*text.utf8(pa.array([t, "tail"])))
    monkeypatch.setattr(text, "CHUNK", 512)
    parts = text.words(*text.utf8(pa.array([t, "tail"])))
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_ranges():
    at = np.array([0, 5, 5, 30, 31])
    assert list(text.chunks(at, 10)) == [(0, 2), (2, 3), (3, 4)]
    which, place = text.expand(np.array([3, 9]), np.array([2, 1]))
    assert which.tolist() == [0, 0, 1] and place.tolist() == [3, 4, 9]
