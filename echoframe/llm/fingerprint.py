"""Document fingerprints by order MinHash."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.text import BASE, BASE_INVERSE, SEED, _powers, expand, mix

#: Characters of a k-mer, slots of a fingerprint, and k-mers whose order makes one slot.
LETTERS, SLOTS, TUPLE = 10, 64, 2

#: K-mers looked at for each one selected, as long as every slot gets its share.
SPARE = 6

#: Characters worked on at once.
CHUNK = 1 << 20

#: Bytes of text that one range of keys holds.
RANGE_BYTES = 24 << 20


def _kmers(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text and place of every k-mer; a shorter text is one k-mer, an empty one has none."""
    n = np.diff(at)
    counts = np.where(n >= LETTERS, n - LETTERS + 1, np.minimum(n, 1))
    text, place = expand(at[:-1], counts)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * _powers(BASE, len(codes)), dtype=np.uint64)))
    h = sums[np.minimum(place + LETTERS, at[1:][text])] - sums[place]
    h *= _powers(BASE_INVERSE, len(codes))[place]
    return mix(h), text, place


def _number_occurrences(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hash of each k-mer with the number of equal ones before it in its text."""
    own = h ^ (text.astype(np.uint64) * np.uint64(SEED))
    ordered = np.sort(own)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    out = h.copy()
    if len(twice):
        marked = np.zeros(1 << 16, bool)
        marked[twice >> np.uint64(48)] = True
        some = np.flatnonzero(marked[own >> np.uint64(48)])
        order = some[np.argsort(own[some], kind="stable")]
        first = np.concatenate(([True], own[order][1:] != own[order][:-1]))
        begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        out[order] += (np.arange(len(order)) - begin).astype(np.uint64) * np.uint64(BASE)
    return mix(out ^ np.uint64(SEED))


def _slots(g: np.ndarray, h: np.ndarray, text: np.ndarray, place: np.ndarray, texts: int):
    """Fingerprints (texts x SLOTS) from k-mers, and how many of each slot's tuple were there."""
    # The slot is in the hash's first bits: sorting by text and hash sorts by slot, too.
    order = np.argsort((text.astype(np.uint64) << np.uint64(40)) | (g >> np.uint64(24)), kind="stable")
    slot = (text * SLOTS + (g >> np.uint64(58)).astype(np.int64))[order]
    begin = np.searchsorted(slot, np.arange(texts * SLOTS))
    rank = np.arange(len(slot)) - begin[slot]
    chosen, slot = order[rank < TUPLE], slot[rank < TUPLE]
    # The selected k-mers of a slot in the order of the text.
    order = np.lexsort((place[chosen], slot))
    chosen, slot = chosen[order], slot[order]
    begin = np.searchsorted(slot, np.arange(texts * SLOTS))
    rank = np.arange(len(slot)) - begin[slot]
    out = np.zeros(texts * SLOTS, np.uint64)
    for r in range(TUPLE):
        now = rank == r
        out[slot[now]] = (out[slot[now]] + h[chosen[now]]) * np.uint64(BASE) + np.uint64(r + 1)
    there = np.bincount(slot, minlength=texts * SLOTS)
    # 16 bits a slot; 0 is left for empty ones.
    out = np.where(there > 0, mix(out) % np.uint64(65535) + np.uint64(1), 0).astype(np.uint16)
    return out.reshape(texts, SLOTS), there.reshape(texts, SLOTS)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Order MinHash of each text: SLOTS numbers of 16 bits, 0 where a slot has no k-mer.

    K-mers are numbered by occurrence and hashed once; the hash's first bits deal them to slots.  In
    each slot the TUPLE least are selected, put in text order, and hashed together.
    """
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    h, text, place = _kmers(codes.astype(np.uint64), at)
    g = _number_occurrences(h, text)
    # Few of a long text's k-mers can be among the least of their slot.
    counts = np.bincount(text, minlength=len(texts))
    bound = np.where(counts > SPARE * TUPLE * SLOTS, SPARE * TUPLE * SLOTS / np.maximum(counts, 1), 1.0)
    level = np.minimum(bound * 2.0**58, 2.0**58).astype(np.uint64)
    low = (g & np.uint64((1 << 58) - 1)) <= level[text]
    out, there = _slots(g[low], h[low], text[low], place[low], len(texts))
    short = np.flatnonzero((bound < 1) & (there < TUPLE).any(axis=1))
    if len(short):
        again = np.zeros(len(texts), bool)
        again[short] = True
        again = np.flatnonzero(again[text])
        number = np.searchsorted(short, text[again])
        out[short] = _slots(g[again], h[again], number, place[again], len(short))[0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots among those that either has; 1 if neither has any."""
    used = ((a > 0) | (b > 0)).sum(axis=1)
    return np.where(used > 0, ((a == b) & (a > 0)).sum(axis=1) / np.maximum(used, 1), 1.0)


def _hex(f: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in f]


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by the first as many characters of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def fingerprint_texts(df: DataFrame, text: str) -> Column:
    """Fingerprint of a text column, as a column; null is like the empty text."""
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(_hex(fingerprints([t or "" for t in texts]))) if len(texts) else pd.Series([], dtype=str)

    return of(F.col(f"`{text}`").cast("string"))


def with_successors(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row by ``key``.

    ``key`` is a whole number; null keys come first, rows of one key are ordered by a hash of the text.
    The row after the last is the first.  Null texts are empty; an empty text has an empty fingerprint,
    which is like another empty one only.  An empty table gives no rows.

    Keys are cut into ranges of about 24 MB of text at keys that occur, so that the first row of each
    range is known beforehand and can be sent to the range before, too.  Rows of a range are sorted by Spark
    and read as a stream, with one row held back.
    """
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    size, least, nulls, many = rows.agg(F.sum(F.octet_length("text")), F.min("key"), F.count_if(F.col("key").isNull()), F.count("key")).head()
    ranges = max(1, -(-(size or 0) // RANGE_BYTES))
    cuts: list[int] = []
    if ranges > 1 and many:
        parts = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(rows.agg(F.percentile_approx("key", parts, 10 * ranges)).head()[0]))
    if not nulls:
        cuts = [c for c in cuts if c > least]
    edges = np.array(cuts, np.int64)

    @F.pandas_udf("long")
    def twice_range(keys: pd.Series) -> pd.Series:
        """Twice the range of a key, and one more if the range begins with it."""
        known = keys.notna().to_numpy()
        keys = keys.fillna(0).astype("int64").to_numpy()
        place = np.searchsorted(edges, keys, "right")
        begins = np.append(edges, 0)[place - 1] == keys
        return pd.Series(np.where(known, 2 * place + (begins & (place > 0)), 0))

    rows = rows.withColumn("spot", twice_range("key")).withColumn("range", F.shiftright("spot", 1))
    begins = F.col("spot") % 2 == 1
    first = F.col("key").isNull() if nulls else F.col("key") == F.lit(least)
    spot = lambda r, ahead: F.struct(r.alias("range"), F.lit(ahead).alias("ahead"))
    spots = F.array_compact(F.array(spot(F.col("range"), 0), F.when(begins, spot(F.col("range") - 1, 1)),
                                    F.when(first, spot(F.lit(len(cuts)).cast("long"), 1))))
    dealt = rows.select("key", "text", F.explode(spots).alias("spot")).select(
        "spot.range", "spot.ahead", "key", "text", F.xxhash64("text").alias("h"))
    ordered = (dealt.repartitionById(len(cuts) + 1, F.col("range").cast("int"))
               .sortWithinPartitions("range", "ahead", "key", "h").drop("h"))

    def read(batches):
        held = None
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ahead, keys, texts = part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()
                if held:
                    ahead, keys, texts = [held[0], *ahead], [held[1], *keys], [held[2], *texts]
                held = ahead[-1], keys[-1], texts[-1]
                lo2 = 0
                while lo2 < len(texts) - 1:
                    hi, chars = lo2, 0
                    while hi < len(texts) - 1 and (hi == lo2 or chars + 2 * len(texts[hi]) <= CHUNK):
                        chars += 2 * len(texts[hi])
                        hi += 1
                    yield block(ahead[lo2:hi], keys[lo2:hi], texts[lo2:hi + 1])
                    lo2 = hi

    def block(ahead, keys, texts):
        # A row sent ahead is the next row of the one before it, and no more.
        own = [i for i, a in enumerate(ahead) if not a]
        changed = [edited(texts[i], texts[i + 1]) for i in own]
        f = fingerprints(texts + changed)
        one, two, new = f[own], f[[i + 1 for i in own]], f[len(texts):]
        return pa.RecordBatch.from_arrays([
            pa.array([keys[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array(_hex(one), pa.string()), pa.array(_hex(new), pa.string()), pa.array(likeness(one, new), pa.float64()),
            pa.array(likeness(one, two), pa.float64())],
            names=["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(read, "key long, " + RESULT)
