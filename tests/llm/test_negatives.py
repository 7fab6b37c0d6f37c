import numpy as np
import pytest
from pyspark.sql import functions as F

from echoframe.llm import negatives
from tests.llm.conftest import CLASHING

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("size,width", [(3, 1), (120, 64), (5000, 100), (2_000_000, 64), (2**24, 70)])
def test_products_are_exact(size, width):
    a, b = (RNG.integers(-size, size + 1, (n, width)) for n in (7, 11))
    bound = int(max((a.astype(object) ** 2).sum(axis=1).max(), (b.astype(object) ** 2).sum(axis=1).max()))
    got = negatives.Products(b, bound)(a)
    assert (got == (a.astype(object) @ b.T.astype(object))).all()
    ends = negatives.Products(np.full((1, width), size), width * size**2)
    assert ends(np.full((1, width), size))[0, 0] == width * size**2 and ends(np.full((1, width), -size))[0, 0] == -width * size**2


def test_residues_stay_exact_in_single_precision():
    p = negatives.moduli(2**50)
    assert len(set(p)) == len(p) and (max(p) // 2) ** 2 * negatives.DEPTH < 2**24


def plain(rows, positives=5, count=3):
    """rows: (id, vector, label) in stored order."""
    ok = [(n, k, np.floor(256 * np.array(v, float)), lab) for n, (k, v, lab) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v, _ in ok), default=0)
    ok = [(n, k, np.pad(v, (0, width - len(v))), lab) for n, k, v, lab in ok]
    out = []
    for n, k, v, lab in ok:
        if k is None or k % 50:
            continue
        scored = sorted(((int(v @ w), m, o, l2) for m, o, w, l2 in ok if m != n), key=lambda r: (-r[0], r[2] is None, r[2] or 0, r[1]))
        for s, _, o, _ in [r for r in scored if r[3] == lab][:positives]:
            some = [r for r in scored if r[3] != lab and 50 * s <= 100 * r[0] <= 95 * s][:count]
            out += [(k, o, i, r[2], s, r[0]) for i, r in enumerate(some, 1)]
    return sorted(out, key=str)


def result(df, **kw):
    rows = negatives.mine(df, "vec_id", "embedding", F.col("label"), F.col("id") % 50 == 0, **kw).collect()
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in rows), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_against_all_pairs(spark, monkeypatch):
    """Small blocks, so that results are put together from many; ties, copies, a hot vector, odd vectors."""
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    monkeypatch.setattr(negatives, "STRIP", 3)
    rows = [(int(i), [float(np.float32(x)) for x in RNG.integers(-3, 4, 6) / 4], int(RNG.integers(0, 3))) for i in range(200)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(70)] + [rows[0], rows[50], rows[7]]
    rows += [(None, rows[3][1], 1), (250, None, 1), (300, rows[1][1], None), (350, [1.0, None], 1), (400, [float("nan")], 2),
             (450, [float("inf")], 2), (500, [], 1), (550, [0.5, 0.25], 0), (-50, rows[9][1], 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumns({c: F.lit(c) for c in CLASHING})
    stored = [(r["vec_id"], r["embedding"], r["label"]) for r in df.collect()]
    assert result(df) == plain(stored)


def test_large_components_and_empty_tables(spark):
    rows = [(i, [float(x) for x in RNG.integers(-(2**17), 2**17, 4)], i % 3) for i in range(120)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    assert result(spark.createDataFrame([], SCHEMA)) == []
    assert result(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)) == []
    with pytest.raises(Exception, match="32 bits"):
        result(spark.createDataFrame([(0, [1e30], 1)], SCHEMA))
