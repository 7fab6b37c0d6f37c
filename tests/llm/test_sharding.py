import pytest
from pyspark.sql import functions as F

from echoframe.llm.sharding import shard, text_bytes
from tests.llm.conftest import CLASHING, ODD_ROWS


@pytest.mark.parametrize("parts,shards", [(1, 8), (5, 3), (7, 1), (4, 50)])
def test_against_prefix_sums(spark, parts, shards):
    df = spark.range(400, numPartitions=parts).select("id", (F.col("id") * 7919 % 97 + 1).alias("size"))
    got = shard(df, shards, F.col("size")).orderBy("id").collect()
    whole, before, count = sum(r["size"] for r in got), 0, {}
    for r in got:
        s = min((2 * before + r["size"]) * shards // (2 * whole), shards - 1)
        assert (r["shard"], r["slot"]) == (s, count.get(s, 0))
        count[s] = count.get(s, 0) + 1
        before += r["size"]


def test_one_large_row_and_zero_sizes(spark):
    df = spark.createDataFrame([(0, 1), (1, 1000), (2, None), (3, 1), (4, -5)], "id long, size long").coalesce(1)
    got = {r["id"]: r for r in shard(df, 4, F.col("size")).collect()}
    assert len(got) == 5 and got[1]["slot"] == 0
    assert {r["shard"] for r in shard(df, 4, F.lit(0)).collect()} == {0}


def test_odd_rows(odd, none):
    got = shard(odd, 3, text_bytes("text"))
    assert sorted(got.columns) == sorted([*odd.columns])
    rows = got.collect()
    assert len(rows) == len(ODD_ROWS) and all(r[c] == c for r in rows for c in CLASHING if c not in ("shard", "slot"))
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert shard(none, 3, text_bytes("text")).collect() == []
