"""Language-model scores by an interpolated modified Kneser-Ney model of word pairs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.arrays import SHARD_KEYS, Arrays, mounted_folder, shard_of, shards_for, store
from echoframe.llm.text import chunks, mix, utf8, words

#: Stands for the end of a text, which is a word of the model.
END = np.uint64(0x6A09E667F3BCC908)

#: Different words or pairs that a task counts before it passes them on.
COUNTED = 1 << 21

#: Text bytes that one different word stands for, roughly; only the size of shards depends on it.
BYTES_A_WORD = 64

#: Discounts where a corpus is too small to estimate them, and the smoothing of the plain unigram score.
DISCOUNTS, SMOOTHING = (0.5, 1.0, 1.5), 0.1


def _between() -> np.ndarray:
    """What each byte counts as in a word: A-Z as a-z, white space as nothing, all others as themselves."""
    table = np.arange(256).astype(np.uint8)
    table[0] = 9  # not nothing, and no other byte's: 9 itself is white space
    table[[0x20, *range(0x09, 0x0E)]] = 0
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


TOKEN = _between()


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words, each text's end behind them, and the place of each text's first."""
    h, _, _, before = words(data, at, TOKEN)
    n = np.diff(before)
    first = before[:-1] + np.arange(len(n))
    out = np.full(len(h) + len(n), END)
    out[np.arange(len(h)) + np.repeat(np.arange(len(n)), n)] = h
    return out, first


def _stretches(batches, column: int):
    for b in batches:
        data, at = utf8(b.column(column))
        for lo, hi in chunks(at):
            yield b.slice(lo, hi - lo), *tokens(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])


def _summed(parts):
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _counting(keys_of, rows_of):
    """Task function: equal keys of stretches are counted together until they are many, then passed on."""
    def count(batches):
        held, fresh, size = [], 0, 0
        for stretch in _stretches(batches, 0):
            held.append(np.unique(keys_of(*stretch), return_counts=True))
            fresh += len(held[-1][0])
            if fresh > COUNTED // 2:
                held, fresh = [_summed(held)], 0
                if len(held[0][0]) > COUNTED // 2:
                    yield rows_of(*held[0])
                    held = []
        if held:
            yield rows_of(*_summed(held))

    return count


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many have each count."""
    if not (n1 and n2 and n3):
        return DISCOUNTS
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(k - (k + 1) * y * more / n, 0.0), float(k)) for k, n, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def discounted(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(c - np.array([0.0, *d])[np.minimum(c, 3)], 0.0)


@dataclass
class Model:
    """Counts of words and pairs as sorted arrays, and the few numbers that make probabilities of them.

    A word's id is its place among the sorted hashes of all words; a text begins with the id after the last.
    """

    words: Arrays
    before: np.ndarray  # words before each shard
    pairs: Arrays
    levels: Arrays
    tokens: int
    distinct: int
    texts: int
    kinds: int  # different pairs
    first: tuple[float, float, float]
    second: tuple[float, float, float]
    rest: float  # weight of words never seen

    def ids(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Id and count of each token (-1 and 0 if unknown), and of the token before it."""
        asked, back = np.unique(h, return_inverse=True)
        known, got = self.words(asked, before=self.before)
        word = np.where(known, got["rank"], -1)[back]
        c = got["c"][back]
        previous, before = np.concatenate(([-1], word[:-1])), np.concatenate(([0], c[:-1]))
        previous[first], before[first] = self.distinct, self.texts
        return word, c, previous, before

    def keys(self, previous: np.ndarray, before: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and shard of pairs of known words: a frequent first word has its pairs in many shards."""
        spread = (before // (SHARD_KEYS // 4) + 1).astype(np.uint64)
        own = shard_of(mix(previous.astype(np.uint64)), self.pairs.shards).astype(np.uint64)
        shard = (own + mix(word.astype(np.uint64)) % spread) % np.uint64(self.pairs.shards)
        return previous.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64), shard.astype(np.int32)

    def log10(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: whether it is known, its logarithm by plain counts and by the model."""
        if not len(h):
            return np.zeros(0, bool), np.zeros(0), np.zeros(0)
        word, c, previous, before = self.ids(h, first)
        base = np.log10((c + SMOOTHING) / (self.tokens + SMOOTHING * (self.distinct + 1)))
        spots, back = np.unique(np.concatenate((word, previous)), return_inverse=True)
        _, level = self.levels(spots.astype(np.uint64), level_shard(spots, self.levels.shards))
        back_w, back_p = back[:len(h)], back[len(h):]
        p = np.where(word >= 0, (discounted(level["a"], self.first) / max(self.kinds, 1))[back_w], 0.0) + self.rest / (self.distinct + 1)
        follow = (level["n1"] * self.second[0] + level["n2"] * self.second[1] + level["n3"] * self.second[2])[back_p]
        both = (word >= 0) & (previous >= 0)
        keys, shard = self.keys(previous[both], before[both], word[both])
        asked, where, back = np.unique(keys, return_index=True, return_inverse=True)
        _, got = self.pairs(asked, shard[where])
        seen = np.zeros(len(h))
        seen[both] = discounted(got["c"].astype(np.int64), self.second)[back]
        total = np.maximum(before, 1)
        return word >= 0, base, np.log10(np.where((previous >= 0) & (before > 0), seen / total + follow / total * p, p))


def level_shard(ids: np.ndarray, shards: int) -> np.ndarray:
    return shard_of(mix(ids.astype(np.int64).astype(np.uint64)), shards)


def fit(df: DataFrame, text: str, usable: Column) -> Model:
    """Count the words and word pairs of the ``usable`` rows, texts whole; null texts are empty.

    Words are runs of bytes other than white space, A-Z as a-z; every text begins with a start, which is
    no word, and ends with an end, which is.  Three rounds, each counted in tasks, added up by key and written
    as sorted arrays: words; pairs; and for each word how many words precede it and follow it once, twice and
    more often.  The driver holds the number of keys of each shard.
    """
    rows = df.where(usable).select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    folder = mounted_folder(df.sparkSession, "words")
    texts, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).head()
    shards = max(1, -(-(size or 0) // (BYTES_A_WORD * SHARD_KEYS)))

    def word_rows(h, n):
        return pa.RecordBatch.from_arrays([pa.array(shard_of(h, shards)), pa.array(h.view(np.int64)), pa.array(n)], names=["shard", "key", "c"])

    counted = rows.mapInArrow(_counting(lambda b, h, first: h, word_rows), "shard int, key long, c long")

    def told(shard, keys, values):
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, len(keys), values["c"].sum())], names=["shard", "n", "c"])

    found, written = store(counted, [("c", "<i8")], f"{folder}/words", shards, "c", told, "shard long, n long, c long")
    sizes, total = np.zeros(shards + 1, np.int64), 0
    for r in written.collect():
        sizes[r["shard"] + 1] = r["n"]
        total += r["c"]
    before = np.cumsum(sizes)
    distinct = int(before[-1])
    if distinct >= 2**32 - 1:
        raise ValueError("more than 4,294,967,294 different words: pairs of their ids do not fit one key")
    model = Model(found, before[:-1], Arrays(f"{folder}/pairs", shards_for(total), (("c", "<u4" if total < 2**32 else "<i8"),)),
                  Arrays(f"{folder}/levels", shards_for(distinct + 1), tuple((c, "<i8") for c in ("a", "n1", "n2", "n3"))),
                  total, distinct, texts, 0, DISCOUNTS, DISCOUNTS, 1.0)

    def pair_keys(b, h, first):
        word, _, previous, before = model.ids(h, first)
        key, shard = model.keys(previous, before, word)
        # Sorted by shard, then by key, the two as one: a shard's pairs pass through the shuffle in order.
        order = np.lexsort((key, shard))
        key, shard = key[order], shard[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]))) if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        return key[at], shard[at], np.diff(np.append(at, len(key)))

    def pair_rows(batches):
        def out():
            key, shard, n = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((key, shard))
            key, shard, n = key[order], shard[order], n[order]
            at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            return key[at], shard[at], np.add.reduceat(n, at)

        def batch(key, shard, n):
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(key.view(np.int64)), pa.array(n)], names=["shard", "key", "c"])

        held, fresh = [], 0
        for stretch in _stretches(batches, 0):
            held.append(pair_keys(*stretch))
            fresh += len(held[-1][0])
            if fresh > COUNTED:
                held = [out()]
                fresh = 0
                if len(held[0][0]) > COUNTED:
                    yield batch(*held[0])
                    held = []
        if held and any(len(x[0]) for x in held):
            yield batch(*out())

    def neighbours(shard, keys, values):
        """Of a shard's pairs: how many words each second word follows, and how often each first word's followers do."""
        first, second, c = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64), values["c"]
        at = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1]))) if len(first) else np.zeros(0, np.int64)
        follows = [np.add.reduceat((c == k if k < 3 else c >= 3).astype(np.int64), at) for k in (1, 2, 3)]
        yield level_rows(first[at], np.zeros(len(at), np.int64), *follows)
        ids, a = np.unique(second, return_counts=True)
        none = np.zeros(len(ids), np.int64)
        yield level_rows(ids, a, none, none, none)
        # Counts of counts come under an id that no word has.
        n4 = int((c == 4).sum())
        yield level_rows(np.array([-1]), *(np.array([int(x)]) for x in (n4, *(f.sum() for f in follows[:2]), (c == 3).sum())))

    def level_rows(ids, *counts):
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(x.astype(np.int64)) for x in counts)], names=["key", "a", "n1", "n2", "n3"])

    pairs = rows.mapInArrow(pair_rows, "shard int, key long, c long")
    _, written = store(pairs, model.pairs.columns, model.pairs.folder, model.pairs.shards, "c", neighbours, "key long, a long, n1 long, n2 long, n3 long")
    levels = written.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("a", "n1", "n2", "n3")])
    spots = model.levels.shards

    def with_shard(batches):
        for b in batches:
            shard = level_shard(b.column(0).to_numpy(), spots)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *b.columns], names=["shard", *b.schema.names])

    def level_counts(shard, keys, values):
        """A shard's numbers of words by how many precede them; the counts of counts of pairs as they came."""
        word = keys < np.uint64(distinct)
        a = values["a"][word]
        own = [int((a == k).sum()) for k in (1, 2, 3, 4)]
        some = np.flatnonzero(keys == np.uint64(2**64 - 1))
        of_pairs = [int(values[c][some].sum()) for c in ("n1", "n2", "n3", "a")]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*own, int((a >= 3).sum()), int(a.sum()), *of_pairs)], names=list("abcdefghij"))

    dealt = levels.mapInArrow(with_shard, "shard int, key long, a long, n1 long, n2 long, n3 long")
    _, written = store(dealt, model.levels.columns, model.levels.folder, spots, None, level_counts, ", ".join(f"{c} long" for c in "abcdefghij"))
    row = written.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in "abcdefghij"]).head()
    model.first, model.second, model.kinds = discounts(*row[:4]), discounts(*row[6:]), row["f"]
    used = sum(d * n for d, n in zip(model.first, (row["a"], row["b"], row["e"])))
    model.rest = used / model.kinds if model.kinds else 1.0
    return model


def score(df: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """key, n_tokens, n_known, base_score and score of every row, over its whole text.

    ``base_score`` adds up log10 of the smoothed shares of the tokens, ``score`` is the log10 probability by the
    model; perplexity is 10 ** (-score / n_tokens).  Null texts are empty: only their end is a token.  Of words
    never seen each has the weight of one.  Repeated rows get a row each; a model of no texts gives 0.
    """
    def rows(batches):
        for b, h, first in _stretches(batches, 1):
            known, base, own = model.log10(h, first)
            n = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                 pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(own, first))],
                names=["key", "n_tokens", "n_known", "base_score", "score"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_tokens", T.LongType()),
                           T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(rows, schema)
