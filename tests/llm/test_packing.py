import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from echoframe.llm import packing
from echoframe.llm.queries import public_tokenizer
from tests.llm.conftest import ODD_ROWS

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer()["definition"])


def check(rows, texts, tokenizer, window, cut):
    """Every document's ids come back from its pieces, and every sequence is filled without gaps."""
    own, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        own[r["key"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    full = sum(sum(n for _, n in p) == window for p in sequences.values())
    assert full >= len(sequences) - cut
    want = defaultdict(list)
    for key, text in texts:
        want[key].append(np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4"))
    assert set(own) == set(want)
    for key, ids in want.items():
        left = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own[key])
        expected = sorted(len(i) for i in ids)
        assert sum(n for _, n, _, _ in left) == sum(expected)
        if len(ids) == 1:
            at = 0
            for start, n, crc, total in left:
                assert start == at and total == len(ids[0]) and crc == zlib.crc32(ids[0][at:at + n].tobytes())
                at += n


def test_documents(docs, texts, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 100_000)
    rows = packing.pack(docs, "doc_id", "text", **public_tokenizer(), with_ids=False).collect()
    check(rows, texts.items(), tokenizer, 2048, 20)


def test_odd_rows(odd, none, tokenizer):
    for window in (16, 2048):
        rows = packing.pack(odd, "doc_id", "text", **public_tokenizer(), window=window).collect()
        check(rows, [(r[0], r[1]) for r in ODD_ROWS], tokenizer, window, 1)
        assert all(len(r["ids"]) == 2 * r["length"] for r in rows)
    assert packing.pack(none, "doc_id", "text", **public_tokenizer()).collect() == []


@pytest.mark.parametrize("ranks", [True, False])
def test_texts_of_all_kinds(ranks, tokenizer):
    files = public_tokenizer()
    fast = open(files["ranks"], "rb").read() if ranks else None
    t = packing.Tokenizer(open(files["definition"]).read(), fast, files["pattern"])
    for text in ("a b", " a", "a ", "a  b", "a\n b", "a \nb", "a.\nB c", "don't we'll it's 'tis", "x... y!! (z)", "é ü ß", "a\tb c", "",
                 "a b  c", "1,000 2²", "<|endoftext|> b <|endoftext|>", "a\n\nb c", "word, word, word", "\x1c a \x85 b", "日本 語"):
        for _ in range(3):
            assert np.frombuffer(t(text), t.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("end", ["", "\n\nb", "\n c", "."])
def test_many_lines(tokenizer, end):
    """A list of words, a column of numbers: one word for each line, and no space or empty line for long."""
    files = public_tokenizer()
    t = packing.Tokenizer(open(files["definition"]).read(), open(files["ranks"], "rb").read(), files["pattern"])
    text = "a list\n" + "\n".join(f"w{i % 5000}." if i % 3 else str(i) for i in range(100_000)) + end
    assert np.frombuffer(t(text), t.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_new_words_in_one_call(tokenizer):
    """A text is given to the vocabulary whole, not once for each word that is not yet known."""
    files = public_tokenizer()
    t = packing.Tokenizer(open(files["definition"]).read(), open(files["ranks"], "rb").read(), files["pattern"])
    calls, encode = [], t.fast.encode_ordinary
    t.fast.encode_ordinary = lambda text: calls.append(text) or encode(text)
    text = " ".join(f"wört{i}er, x{i}\ny" for i in range(5000))
    assert np.frombuffer(t(text), t.kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(calls) == 1


def test_white_space(spark, tokenizer):
    """Runs of white space of all kinds, by the operator: their last character belongs to what follows."""
    rng = random.Random(1)
    parts = [" ", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u200b", "\u2028", "\u3000",
             "\ufeff", "\0", "a", "the", "é", "日", "1", "²", ".", "!!", "'", "'s", "'ll", "😀", "\u0301"]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)] + [" " * 100_000 + "a", "\n" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = packing.tokenize(df, "id", "text", **public_tokenizer()).collect()
    assert len(got) == len(texts)
    for r in got:
        assert np.frombuffer(r["ids"], "<u2").tolist() == [*tokenizer.encode(texts[r["key"]], add_special_tokens=False).ids, 1]


def test_neighbours_follow_their_seed():
    """Of two topics that alternate, windows hold one."""
    ids = np.concatenate([np.full(10, i % 2) + np.arange(10) * 2 for i in range(40)])
    index = packing.Shard(ids, np.arange(0, 401, 10), np.log(np.full(20, 2.0)), 10.0)
    pieces = packing.fill(np.full(40, 10), index.neighbours, 100)
    by = defaultdict(set)
    for doc, _, _, sequence, _ in pieces:
        by[sequence].add(doc % 2)
    assert [len(by[s]) for s in range(4)] == [1] * 4


def test_neighbours_by_all_terms():
    """The ranking is that of all shared terms, however many a seed has."""
    rng, size = np.random.default_rng(3), 600
    chance = np.linspace(0.02, 0.9, size)
    docs = [np.repeat(t, rng.integers(1, 4, len(t))) for t in (np.flatnonzero(rng.random(size) < chance) for _ in range(60))]
    before = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    idf, average = np.log(1 + 1 / np.linspace(0.05, 0.9, size)), before[-1] / 60
    index = packing.Shard(np.concatenate(docs), before, idf, average)
    used = np.arange(60) % 7 == 0
    for seed in range(60):
        score = {}
        for k, d in enumerate(docs):
            tf = np.bincount(d, minlength=size)
            w = idf * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / average))
            score[k] = w[np.unique(docs[seed])].sum()
        want = sorted((k for k in score if not used[k] and score[k]), key=lambda k: -score[k])
        assert index.neighbours(seed, used).tolist() == want
