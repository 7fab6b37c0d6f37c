"""Hard negatives by exact inner products in a residue number system."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.session import checkpointed

#: Anchors and rows of one block; a task multiplies one block of each.
ANCHORS, ROWS = 8192, 8192

#: Anchors whose scores with a block of rows are held at a time.
STRIP = 128

#: Components multiplied at a time, and the largest modulus: half of it, squared, times the components must
#: stay below 2^24, up to which float32 counts exactly.
DEPTH, LARGEST = 64, 1021

#: Squared length from which scores no longer fit a long with the factor 100 of the score window.
LONGEST = 2**56


def moduli(bound: int) -> list[int]:
    """Primes, from the largest down, whose product exceeds twice ``bound``: they tell all scores up to it apart."""
    found, product, n = [], 1, LARGEST
    while not found or product <= 2 * bound:
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            found.append(n)
            product *= n
        n -= 1
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Whole numbers modulo ``p``, centred around 0, as float32."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r).astype(np.float32)


class Products:
    """Exact inner products of one block of rows with others, for scores of at most ``bound``."""

    def __init__(self, rows: np.ndarray, bound: int):
        self.primes = moduli(bound)
        self.parts = [residues(rows, p).T for p in self.primes]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        digits = []
        for p, part in zip(self.primes, self.parts):
            own, total = residues(x, p), None
            for lo in range(0, part.shape[0], DEPTH):
                got = np.mod(np.rint(own[:, lo:lo + DEPTH] @ part[lo:lo + DEPTH]).astype(np.int32), p)
                total = got if total is None else np.mod(total + got, p)
            digits.append(np.zeros((len(x), part.shape[1]), np.int32) if total is None else total)
        return remainders(digits, self.primes)


def remainders(digits: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """The signed numbers with these digits, by mixed radix: no step exceeds the result's own size."""
    mixed: list[np.ndarray] = []
    for i, p in enumerate(primes):
        v = digits[i].astype(np.int64)
        for j, q in enumerate(primes[:i]):
            v = (v - mixed[j]) * pow(q, -1, p) % p
        mixed.append(v)
    # A number in the upper half is negative: beginning at the leading digit less its modulus keeps it in range.
    lead, half = mixed[-1], np.zeros(mixed[-1].shape, bool)
    for v, p in zip(mixed, primes):
        # Digits of (product - 1) / 2 are (p - 1) / 2 throughout.
        half = np.where(v == p // 2, half, v > p // 2)
    out = lead - np.where(half, primes[-1], 0)
    for v, p in zip(mixed[-2::-1], primes[-2::-1]):
        out = out * p + v
    return out


def quantised(df: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """at (place of the row), id, label and v (whole components as 64-bit integers) of the rows that take part."""
    x = F.col(f"`{vector}`").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < math.inf))
    rows = df.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{key}`").cast("long").alias("id"),
                     label.cast("long").alias("label"), x.alias("x")).where("label is not null and x is not null").where(finite)

    def whole(batches):
        for b in batches:
            column = b.column(3)
            data = np.floor(column.flatten().to_numpy(zero_copy_only=False) * scale)
            if len(data) and np.abs(data).max() >= 2**31:
                raise ValueError("a component times the scale exceeds 32 bits")
            edges = np.concatenate(([0], np.cumsum(np.diff(column.offsets.to_numpy()))))
            parts = [data[lo:hi] for lo, hi in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(3)), pa.array([v.astype("<i8").tobytes() for v in parts], pa.binary()),
                 pa.array([float(v @ v) for v in parts], pa.float64())],
                names=["at", "id", "label", "v", "length"])

    return rows.mapInArrow(whole, "at long, id long, label long, v binary, length double")


def _matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column.to_pylist()):
        part = np.frombuffer(v, "<i8")
        out[i, :len(part)] = part
    return out


def _in_order(table: pa.Table) -> pa.Table:
    """Rows by id (null last), then by their place: the order among equal scores."""
    return table.sort_by([("id", "ascending"), ("at", "ascending")])


def _first(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of each row; columns are in the order that breaks ties."""
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    n = masked.shape[1]
    if n > k:
        cut = np.partition(masked, n - k, axis=1)[:, n - k]
        allowed = allowed & (masked >= cut[:, None])
    i, j = np.nonzero(allowed)
    order = np.lexsort((j, -masked[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k]


def _blocks(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int):
    """Rows and anchors dealt to all pairs of a block of rows and a block of anchors, ready to be cogrouped."""
    slices, groups = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    part = lambda n: F.pmod(F.xxhash64("at"), F.lit(n)).cast("int")
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    right = rows.select("*", part(slices).alias("slice"), every(groups, "group"))
    # New names for the anchors' columns, which may be the rows' own.
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])
    left = anchors.select("*", part(groups).alias("group"), every(slices, "slice"))
    return left.groupBy("group", "slice").cogroup(right.groupBy("group", "slice"))


def mine(df: DataFrame, key: str, vector: str, label: Column, anchor: Column, scale: int = 256, positives: int = 5, negatives: int = 3,
         low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor.

    Components are floor(scale * x); the score of two rows is the whole-number inner product of their vectors,
    the shorter one filled with zeros.  Higher scores come first, equal ones by id (null last), then by the
    row's place.  An anchor's positives are its first ``positives`` other rows of the same label; for each,
    the first ``negatives`` rows of other labels whose score is between ``low`` and ``high`` percent of the
    positive's come out, ranked from 1.

    1. Components are made whole once; the greatest squared length bounds all scores.
    2. Blocks of anchors meet blocks of rows.  A task multiplies residues modulo a few primes in float32, where
       all sums are exact, puts the signed scores together by remaindering, and keeps the best of its block only.
    3. A window over the blocks' best picks the positives; a second round the negatives within their bounds.

    Rows with a null label, a null vector or a component that is null or not finite take no part.  Rows with a
    null id take part, but are no anchors.  Repeated rows are rows of their own: a copy of an anchor is one of its
    other rows.  An empty table, or one without anchors, gives no rows.  Scores must fit a long: components
    below 2^31, squared lengths below 2^56; larger ones raise an error.  Work is anchors x rows, spread over
    blocks of a fixed size; nothing is broadcast or collected but four numbers.
    """
    rows = checkpointed(quantised(df, key, vector, label, scale))
    anchors = rows.where(anchor)
    n_rows, longest, width = rows.agg(F.count("*"), F.max("length"), F.max(F.octet_length("v"))).head()
    # No score exceeds the greatest squared length; a little more makes up for its rounding.
    n_anchors, bound, width = anchors.count(), math.ceil((longest or 0) * (1 + 1e-9)), (width or 0) // 8
    if bound >= LONGEST:
        raise ValueError(f"scores up to {bound} do not fit a long")
    rows = rows.drop("length")

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _in_order(left), _in_order(right)
        products = Products(_matrix(right["v"], width), bound)
        out = [PLACED.empty_table()]
        for lo in range(0, len(left), STRIP):
            a = left.slice(lo, STRIP)
            score = products(_matrix(a["v"], width))
            other = a["at"].to_numpy()[:, None] != right["at"].to_numpy()[None, :]
            i, j = _first(score, other & (a["label"].to_numpy()[:, None] == right["label"].to_numpy()[None, :]), positives)
            out.append(pa.table({"anchor": a["at"].take(i), "at": right["at"].take(j), "id": right["id"].take(j), "score": score[i, j]}, PLACED))
        return pa.concat_tables(out)

    ranked = lambda of: F.row_number().over(Window.partitionBy(*of).orderBy(
        F.desc("score"), F.asc_nulls_last("id"), "at"))
    found = _blocks(rows, anchors.select("at", "id", "label", "v"), n_rows, n_anchors).applyInArrow(
        best_positives, "anchor long, at long, id long, score long")
    best = found.withColumn("place", ranked(["anchor"])).where(F.col("place") <= positives)
    wanted = best.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("wanted"))
    asked = anchors.select("at", "id", "label", "v").join(wanted.withColumnRenamed("anchor", "at"), "at")

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _in_order(left), _in_order(right)
        products = Products(_matrix(right["v"], width), bound)
        out = [SELECTED.empty_table()]
        for lo in range(0, len(left), STRIP):
            a = left.slice(lo, STRIP)
            score = products(_matrix(a["v"], width))
            differs = a["label"].to_numpy()[:, None] != right["label"].to_numpy()[None, :]
            lists = a["wanted"].to_pylist()
            for k in range(max(map(len, lists))):
                goal = np.array([w[k]["score"] if k < len(w) else 0 for w in lists])[:, None]
                some = np.array([k < len(w) for w in lists])[:, None]
                i, j = _first(score, differs & some & (low * goal <= 100 * score) & (100 * score <= high * goal), negatives)
                out.append(pa.table({
                    "anchor": a["at"].take(i), "anchor_id": a["id"].take(i), "place": np.full(len(i), k + 1, np.int32),
                    "positive_id": pa.array([lists[x][k]["id"] for x in i], pa.int64()), "positive_score": goal[i, 0].astype(np.int64),
                    "at": right["at"].take(j), "id": right["id"].take(j), "score": score[i, j]}, SELECTED))
        return pa.concat_tables(out)

    chosen = _blocks(rows, asked, n_rows, n_anchors).applyInArrow(
        best_negatives, "anchor long, anchor_id long, place int, positive_id long, positive_score long, at long, id long, score long")
    return chosen.withColumn("rank", ranked(["anchor", "place"])).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


PLACED = pa.schema([(n, pa.int64()) for n in ("anchor", "at", "id", "score")])
SELECTED = pa.schema([("anchor", pa.int64()), ("anchor_id", pa.int64()), ("place", pa.int32()), ("positive_id", pa.int64()),
                      ("positive_score", pa.int64()), ("at", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
