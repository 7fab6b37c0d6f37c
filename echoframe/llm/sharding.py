"""Contiguous shards of nearly equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echoframe.session import checkpointed

#: monotonically_increasing_id keeps a row's place in its partition in this many low bits.
PLACE_BITS = 33

TABLE = "part long, rows_before long, begins array<struct<at: long, shard: int, row: long>>"


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text plus one for its end mark; null has none."""
    return (F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)) + 1).cast("long")


def shard(df: DataFrame, shards: int, size: Column) -> DataFrame:
    """``df`` with ``shard`` (0 to shards - 1) and ``slot`` (place in its shard, from 0).

    Rows keep their stored order, and shards are runs of it.  Bytes and rows are summed per partition;
    prefix sums of these totals tell which partitions lie in one shard and which hold a cut (at multiples
    of total / shards).  Only the latter, fewer than ``shards``, are summed row by row.  A row goes to
    the shard that holds the middle of its bytes, so no shard is off its target by more than a row.

    The numbered rows are checkpointed once, so that a recomputed task sees the same places: pass ids
    and sizes, or whole rows where the shards are to be written out.  The driver holds a few numbers for
    each partition.

    Null or negative sizes count as 0; if all are 0, every row goes to shard 0.  Repeated rows are each
    placed.  A shard can be empty if one row is larger than a shard.  Columns named shard or slot are
    replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]).alias("row")
    size = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("_size")
    rows = checkpointed(df.select(kept, size, F.monotonically_increasing_id().alias("_at")))
    rows = rows.withColumn("_part", F.shiftright("_at", PLACE_BITS))
    totals = sorted(tuple(r) for r in rows.groupBy("_part").agg(F.sum("_size"), F.count("*")).collect())
    whole = max(1, sum(b for _, b, _ in totals))

    parts, begins, cut, bytes_before, rows_before = [], {}, [], 0, 0
    for p, b, n in totals:
        parts.append((p, rows_before))
        first, last = (min(x * shards // whole, shards - 1) for x in (bytes_before, max(bytes_before, bytes_before + b - 1)))
        if first == last:
            begins.setdefault(first, p << PLACE_BITS)
        else:
            cut.append((p, bytes_before))
        bytes_before, rows_before = bytes_before + b, rows_before + n
    for s, at in _first_rows(rows, cut, shards, whole):
        begins[s] = min(at, begins.get(s, at))
    return _placed(rows, parts, begins)


def _first_rows(rows: DataFrame, cut: list[tuple[int, int]], shards: int, whole: int) -> list[tuple[int, int]]:
    """(shard, place of its first row) over the partitions that hold a cut."""
    if not cut:
        return []
    spark = rows.sparkSession
    # At most one row for each shard.
    some = F.broadcast(spark.createDataFrame(cut, "_part long, bytes_before long"))
    running = F.sum("_size").over(Window.partitionBy("_part").orderBy("_at"))
    big = "decimal(38,0)"
    twice_middle = ((F.col("bytes_before") + running).cast(big) * 2 - F.col("_size")).cast(big)
    of = F.least(F.floor(twice_middle * F.lit(shards) / F.lit(2 * whole).cast(big)), F.lit(shards - 1)).cast("int")
    found = rows.select("_part", "_at", "_size").join(some, "_part").select("_at", of.alias("s"))
    return [tuple(r) for r in found.groupBy("s").agg(F.min("_at")).collect()]


def _placed(rows: DataFrame, parts: list[tuple[int, int]], begins: dict[int, int]) -> DataFrame:
    before = dict(parts)
    mask = (1 << PLACE_BITS) - 1
    starts = sorted((at, s, before[at >> PLACE_BITS] + (at & mask)) for s, at in begins.items())
    table, i = [], 0
    for p, n in parts:
        while i + 1 < len(starts) and starts[i + 1][0] <= p << PLACE_BITS:
            i += 1
        k = i
        while k + 1 < len(starts) and starts[k + 1][0] >> PLACE_BITS == p:
            k += 1
        table.append((p, n, starts[i:k + 1]))
        i = k
    places = rows.sparkSession.createDataFrame(table, TABLE.replace("part", "_part", 1))
    here = F.element_at(F.filter("begins", lambda x: x["at"] <= F.col("_at")), -1)
    slot = F.col("rows_before") + F.col("_at").bitwiseAND(mask) - F.col("_here.row")
    return rows.join(places, "_part").withColumn("_here", here).select("row.*", F.col("_here.shard").alias("shard"), slot.alias("slot"))
