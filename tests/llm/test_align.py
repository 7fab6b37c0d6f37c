import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from echoframe.llm import align
from echoframe.llm.queries import op13_alignment, public_tokenizer
from tests.llm.conftest import CLASHING, SMALL

FILES = (*(public_tokenizer()[k] for k in ("definition", "ranks", "pattern")), P.path("piece_bpe_32k.model"))
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")


@pytest.fixture(scope="module")
def encoders():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[3])
    char = align.byte_level()

    def tokens(text):
        one = a.encode(" " + text, add_special_tokens=False)
        x = [(i, bytes(char[c] for c in t)) for i, t in zip(one.ids, one.tokens)]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
             for i in b.encode(text) for p in [b.id_to_piece(i)]]
        return x, y

    return tokens


def plain(texts, tokens):
    """One document at a time, one byte offset at a time."""
    out, linked = [], []
    for text in texts:
        x, y = tokens(text) if text else ([], [])
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            out.append([0, 0, 0, 0, ""])
            linked.append(Counter())
            continue
        at = [0, 0]
        groups, sides, rest = [], ([], []), [list(x), list(y)]
        while rest[0] or rest[1]:
            side = 0 if rest[0] and at[0] <= at[1] else 1
            i, t = rest[side].pop(0)
            at[side] += len(t)
            sides[side].append(i)
            if at[0] == at[1]:
                groups.append(sides)
                sides = ([], [])
        pairs = Counter((i, j) for g, h in groups for i in g for j in h)
        linked.append(pairs)
        out.append([len(x), len(y), len(groups), sum(pairs.values()), ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)])
    count = Counter(p for pairs in linked for p in pairs)
    top = defaultdict(int)
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return [(*o[:4], sum(m for p, m in pairs.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in pairs.items()), o[4])
            for o, pairs in zip(out, linked)]


ODD = [None, "", " ", "  two  spaces  ", "word", "a<|endoftext|>b <s> </s>", "▁mark", "tab\tand\nlines\r\n here", "café naïve 北京 😀😀 ẞ", "\x00\x01 x", "١٢٣",
       "x" * 400, "ab" * 300 + " " + "é" * 200, "1234567890 " * 50, "same again", "same again", "trailing ", " leading", "no break　wide", "é combining"]


def test_against_plain(spark, encoders, monkeypatch):
    monkeypatch.setattr(align, "LISTED", 4)
    rng, alphabet = random.Random(2), "abcdefg   ,.\n'été日本🙂0123"
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "null key")], "doc_id long, text string").withColumns(
        {c: F.lit(c) for c in CLASHING})
    got = {r["key"]: tuple(r[c] for c in COLUMNS) for r in align.align(df, "doc_id", "text", *FILES).collect()}
    want = plain([*texts, "null key"], encoders)
    for i, (t, w) in enumerate(zip([*texts, "null key"], want)):
        assert got[i if i < len(texts) else None] == w, t
    assert want[6][0] == 0 and want[4][0] > 0


def test_lanes(encoders, monkeypatch):
    """Long documents divided into lanes have the groups of undivided ones."""
    rng = random.Random(4)
    ends = [sorted(rng.sample(range(1, 60_000), 20_000)) + [60_000 + k] for k in range(6)]
    docs = [(np.array(ends[2 * k]), np.array(ends[2 * k + 1][:-1] + [ends[2 * k][-1]])) for k in range(3)] + [(np.array([5]), np.array([5]))]
    base, a, b, first = 0, [], [], []
    for x, y in docs:
        first.append(sum(map(len, a)))
        a.append(x + base)
        b.append(y + base)
        base += x[-1]
    a, b, first = np.concatenate(a), np.concatenate(b), np.array(first)
    ca, cb = align.merge(a, b, first)
    both = np.intersect1d(a, b)
    assert (a[ca] == both).all() and (b[cb] == both).all()
    starts, stops = align.lanes(first, np.append(first[1:], len(a)), a, b)
    assert len(starts) > 90 and (stops[:-1] == starts[1:]).all()
    monkeypatch.setattr(align, "LANE", 10**9)
    assert all((x == y).all() for x, y in zip(align.merge(a, b, first), (ca, cb)))


def test_no_rows(spark, none):
    assert align.align(none, "doc_id", "text", *FILES).collect() == []


def test_packed():
    pair, times = np.array([3, 3 + 2**33, 2**40]), np.array([1, 2**35, 7])
    assert all((x == y).all() for x, y in zip(align.unpacked(align.packed(pair, times), 3), (pair, times)))


def test_query(spark, encoders):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in rows], plain([r["text"] for r in rows], encoders)))
    got = op13_alignment(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r["doc_id"]]
        assert tuple(r[c] for c in COLUMNS[:-1]) == w[:-1]
        assert r["groups_sha256"] == (hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "")
