"""Sorted arrays of hashes in the shared folder, mapped into memory by the workers that look things up; filters of hashes.

Keys are 64-bit hashes, evenly spread, so their leading bits tell the shard.  A shard is one file for the keys
and one for each value, in key order.  Files are written under another name and put in place at once: a task
that is run again, or twice at a time, leaves the same bytes.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echoframe.llm.text import process_wide
from echoframe.session import fresh_folder

#: Keys of a shard, on average.
SHARD_KEYS = 1 << 21

#: Shards that a worker keeps mapped.
MAPPED = 256


def mounted_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, as a path that workers can open: it must be mounted on every machine."""
    folder = urlparse(fresh_folder(spark, name))
    if folder.scheme not in ("", "file"):
        raise ValueError(f"files are mapped into memory: spark.checkpoint.dir must be mounted on all machines, not {folder.scheme}://")
    return unquote(folder.path)


@dataclass(frozen=True)
class Arrays:
    """Where sorted arrays lie: the number of shards, the names and types of their values."""

    folder: str
    shards: int
    columns: tuple[tuple[str, str], ...]

    def __call__(self, keys: np.ndarray, shard: np.ndarray | None = None, before: np.ndarray | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which of ``keys`` (unsigned, any order) there are, and their values, 0 for the others.

        ``shard`` is that of each key if it isn't ``shard_of`` them.  With ``before``, the numbers of keys before
        each shard, ``rank`` is a key's place among all.
        """
        shard = shard_of(keys, self.shards) if shard is None else shard
        order = np.lexsort((keys, shard))
        asked, shard = keys[order], shard[order]
        edges = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(asked)])) if len(asked) else np.zeros(1, np.int64)
        found = np.zeros(len(keys), bool)
        values = {name: np.zeros(len(keys), kind) for name, kind in (*self.columns, *((("rank", "i8"),) if before is not None else ()))}
        for lo, hi in zip(edges[:-1], edges[1:]):
            have = self._mapped(int(shard[lo]))
            if have is None:
                continue
            at = np.minimum(np.searchsorted(have["key"], asked[lo:hi]), len(have["key"]) - 1)
            hit = have["key"][at] == asked[lo:hi]
            place = order[lo:hi][hit]
            found[place] = True
            for name, _ in self.columns:
                values[name][place] = have[name][at[hit]]
            if before is not None:
                values["rank"][place] = at[hit] + before[shard[lo]]
        return found, values

    def _mapped(self, shard: int):
        kept = process_wide("mapped arrays", OrderedDict)
        name = (self.folder, shard)
        if name not in kept:
            path = f"{self.folder}/{shard}"
            # An empty shard has no file.
            kept[name] = {c: np.memmap(f"{path}.{c}", kind, "r") for c, kind in (*self.columns, ("key", "<u8"))} if os.path.exists(f"{path}.key") else None
            if len(kept) > MAPPED:
                kept.popitem(last=False)
        kept.move_to_end(name)
        return kept[name]


def shards_for(rows: int) -> int:
    """Shards for about so many keys."""
    return max(1, -(-rows // SHARD_KEYS))


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of evenly spread keys, by their leading bits: later shards have larger keys."""
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _put(path: str, data: np.ndarray):
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        f.write(data)
    os.replace(own, path)


def _combined(rows: tuple, combine: int | None) -> tuple:
    """Rows of sorted keys with the value at ``combine`` summed over equal keys."""
    if combine is None or not len(rows[0]):
        return rows
    first = np.flatnonzero(np.concatenate(([True], rows[0][1:] != rows[0][:-1])))
    return tuple(np.add.reduceat(v, first) if i == combine else v[first] for i, v in enumerate(rows))


def store(df: DataFrame, columns: Sequence[tuple[str, str]], folder: str, shards: int, combine: str | None = None,
          also: Callable | None = None, also_schema: str = "shard int, n long") -> tuple[Arrays, DataFrame]:
    """Sorted arrays of ``df`` (shard, a key as a long, and value columns), and rows that tell of their shards.

    Nothing is written before those rows are computed, and it is written again whenever they are.  With
    ``combine``, that column is summed over equal keys.  ``also`` makes rows of ``also_schema`` from a shard's
    number, keys and values; without it they are (shard, n).  A task holds one shard; rows are read as a stream.
    """
    names = [n for n, _ in columns]
    summed = None if combine is None else 1 + names.index(combine)

    def finish(shard, parts):
        keys, *values = _combined(tuple(np.concatenate(p) for p in zip(*parts)), summed)
        os.makedirs(folder, exist_ok=True)
        for (name, kind), v in zip(columns, values):
            _put(f"{folder}/{shard}.{name}", v.astype(kind))
        # The keys come last: a shard with keys is whole.
        _put(f"{folder}/{shard}.key", keys.astype("<u8"))
        if also is not None:
            return also(shard, keys, dict(zip(names, values)))
        return [pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([len(keys)], pa.int64())], names=["shard", "n"])]

    def write(batches):
        now, parts = None, []
        for b in batches:
            shard = b.column(0).to_numpy()
            rows = (b.column(1).to_numpy().view(np.uint64), *(b.column(2 + i).to_numpy() for i in range(len(names))))
            edges = np.concatenate(([0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)])) if len(shard) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if now != shard[lo] and parts:
                    yield from finish(now, parts)
                    parts = []
                now = int(shard[lo])
                parts.append(_combined(tuple(r[lo:hi] for r in rows), summed))
        if parts:
            yield from finish(now, parts)

    # Longs are signed: turning the first bit sorts them as unsigned.
    rows = df.select("shard", "key", *names).repartitionById(shards, F.col("shard")).sortWithinPartitions(
        "shard", F.col("key").bitwiseXOR(F.lit(-(1 << 63))))
    return Arrays(folder, shards, tuple(columns)), rows.mapInArrow(write, also_schema)


#: Bits of the filters below: 1 MB is sent to every task.
FILTER_BITS = 23


def place_of(*columns: str) -> Column:
    """Place in a filter, by the hash of some columns."""
    return F.xxhash64(*columns).bitwiseAND((1 << FILTER_BITS) - 1)


def marked(places: DataFrame) -> Callable[[np.ndarray], np.ndarray]:
    """Function that tells which of some places may be among ``places`` (column p).  A full filter lets all pass."""
    marks = (places.groupBy(F.shiftright("p", 5).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(p & 31 AS int)))").alias("bits")).collect())
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    for word, mark in marks:
        bits[word] = mark
    return lambda p: (bits[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1


def suspects(rows: DataFrame, columns: Sequence[str], of: DataFrame) -> Column:
    """Whether a row's ``columns`` may be among those of ``of`` (same names): all that are, and a few others."""
    found = marked(of.select(place_of(*columns).alias("p")))

    @F.arrow_udf("boolean")
    def suspected(p: pa.Array) -> pa.Array:
        return pa.array(found(p.to_numpy()))

    return suspected(place_of(*columns))
