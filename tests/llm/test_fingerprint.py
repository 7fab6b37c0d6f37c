import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.llm import fingerprint as fp
from tests.llm.conftest import ODD_ROWS


def plain(text):
    """Order MinHash by dictionaries: number occurrences, sort each slot, put the least in text order."""
    if not text:
        return [0] * fp.SLOTS
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    h, _, _ = fp._kmers(codes, np.array([0, len(text)]))
    seen, slots = {}, {}
    for place, x in enumerate(h.tolist()):
        k = seen[x] = seen.get(x, -1) + 1
        g = int(fp.mix(np.array([((x + k * fp.BASE) % 2**64) ^ fp.SEED], np.uint64))[0])
        slots.setdefault(g >> 58, []).append((g, place, x))
    out = [0] * fp.SLOTS
    for s, own in slots.items():
        total = 0
        for r, (_, _, x) in enumerate(sorted(sorted(own)[:fp.TUPLE], key=lambda o: o[1])):
            total = ((total + x) * fp.BASE + r + 1) % 2**64
        out[s] = int(fp.mix(np.array([total], np.uint64))[0] % np.uint64(65535)) + 1
    return out


def test_against_dictionaries(texts):
    some = [t for t in texts.values()][:40] + ["", "a", "abc" * 400, "x" * 5000, "é" * 9, "0123456789"]
    got = fp.fingerprints(some)
    assert got.tolist() == [plain(t) for t in some]
    # A text's fingerprint does not depend on what is beside it.
    assert all((fp.fingerprints([t])[0] == f).all() for t, f in zip(some, got))


def test_order_and_edits():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(200)]
    base = " ".join(words)
    edit, order = base.replace(words[50], "qqq"), " ".join(words[100:] + words[:100])
    f = fp.fingerprints([base, edit, order, "".join(rng.choices("klmnop", k=len(base)))])
    near = fp.likeness(np.repeat(f[:1], 4, axis=0), f)
    assert near[0] == 1 and near[1] > 0.8 and near[1] > near[2] > near[3] == 0


@pytest.mark.parametrize("size", [24 << 20, 1 << 16])
def test_successors(docs, texts, size, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", size)
    got = {r["key"]: r for r in fp.with_successors(docs.repartition(3), "doc_id", "text").collect()}
    keys = sorted(texts)
    assert sorted(got) == keys
    for k, after in list(zip(keys, keys[1:] + keys[:1]))[::7]:
        own, new = texts[k], fp.edited(texts[k], texts[after])
        one, two, nxt = fp.fingerprints([own, new, texts[after]])
        r = got[k]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == one.astype(">u2").tobytes().hex() and r["edited_fingerprint"] == two.astype(">u2").tobytes().hex()
        assert (r["near_edited"], r["near_next"]) == (fp.likeness(one[None], two[None])[0], fp.likeness(one[None], nxt[None])[0])


def test_edited():
    assert fp.edited("abcdef", "xyz123") == "abcxyz" and fp.edited("abcdefg", "x") == "abcdx" and fp.edited("", "x") == ""


@pytest.mark.parametrize("size", [24 << 20, 64])
def test_odd_rows(odd, none, size, monkeypatch):
    monkeypatch.setattr(fp, "RANGE_BYTES", size)
    got = fp.with_successors(odd, "doc_id", "text").collect()
    assert sorted(str(r["key"]) for r in got) == sorted(str(r[0]) for r in ODD_ROWS)
    empty = [r for r in got if r["n_chars"] == 0]
    assert len(empty) == 3 and all(set(r["fingerprint"]) == {"0"} and r["near_edited"] == 1 for r in empty)
    assert fp.with_successors(none, "doc_id", "text").collect() == []
    one = fp.with_successors(odd.where("doc_id = 3"), "doc_id", "text").collect()
    assert [(r["key"], r["near_next"]) for r in one] == [(3, 1.0)]
    column = odd.select(fp.fingerprint_texts(odd, "text").alias("f"), F.col("doc_id")).collect()
    assert {r["f"] for r in column if r["doc_id"] == 5} == {r["fingerprint"] for r in got if r["key"] == 6}
