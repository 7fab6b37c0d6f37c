"""Benchmark decontamination by a positional inverted index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.arrays import suspects
from echoframe.llm.text import chunks, expand, lean, utf8, words
from echoframe.session import checkpointed

#: Words of test items searched for at once: what every task is sent grows with it, and nothing else.
BLOCK_WORDS = 200_000

#: Candidate places weighed at once in a task.
BATCH = 1 << 21


def word_list(text) -> list[int]:
    h, _, _, _ = words(*utf8(pa.array([text], pa.string())))
    return h.tolist()


class Phrases:
    """The distinct windows of a block of test items, as numbers of terms in ``vocabulary``, and the items of each."""

    def __init__(self, items: list[tuple], window: int, vocabulary: np.ndarray):
        found: dict[tuple, set] = {}
        for item, text in items:
            w = word_list(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i:i + window]), set()).add(item)
        self.items = sorted({i for of in found.values() for i in of})
        number = {item: n for n, item in enumerate(self.items)}
        self.vocabulary = vocabulary
        self.length = np.array([len(w) for w in found], np.int64)
        self.terms = np.full((len(found), window), -1, np.int64)
        for row, w in zip(self.terms, found):
            row[:len(w)] = np.searchsorted(self.vocabulary, np.array(w, np.uint64))
        self.item_first = np.concatenate(([0], np.cumsum([len(of) for of in found.values()]))).astype(np.int64)
        self.item_of = np.array([number[i] for of in found.values() for i in sorted(of)], np.int64)
        self.order = np.tile(np.arange(window), (len(found), 1))

    def rarest_first(self, counts: np.ndarray) -> None:
        weight = np.where(self.terms < 0, np.iinfo(np.int64).max, counts[np.maximum(self.terms, 0)])
        self.order = np.argsort(weight, axis=1, kind="stable")


def vocabulary_of(tests: DataFrame, text: str) -> np.ndarray:
    """Sorted hashes of the words of all tests; the driver and each task hold 8 bytes for each different word."""
    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(words(*utf8(b.column(0)))[0]).view(np.int64))], names=["word"])

    found = tests.select(F.col(f"`{text}`").cast("string")).mapInArrow(lean(rows), "word long").distinct().toArrow()
    return np.sort(found["word"].to_numpy().view(np.uint64)) if len(found) else np.zeros(1, np.uint64)


def build_index(docs: DataFrame, key: str, text: str, vocabulary: np.ndarray) -> DataFrame:
    """Postings of the words in ``vocabulary``: one row for each stretch of about 1 MB of texts.

    Each row holds its documents (keys, words before each), the terms that occur there, and for each
    term the sorted places of all its occurrences.  A document is never divided.  Columns are binary so
    that they pass between Spark and Python in one piece.
    """
    kind = docs.schema[key].dataType

    def rows(batches):
        for b in batches:
            data, at = utf8(b.column(1))
            out = []
            for lo, hi in chunks(at):
                h, _, _, before = words(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
                term = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                place = np.flatnonzero(vocabulary[term] == h)
                term = term[place]
                order = np.argsort(term, kind="stable")
                term, place = term[order], place[order]
                own, first = np.unique(term, return_index=True)
                out.append((b.column(0).slice(lo, hi - lo), before, own, np.append(first, len(term)), place))
            keys = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum([len(o[0]) for o in out]))), pa.int32()),
                pa.concat_arrays([o[0] for o in out]) if out else b.column(0))
            numbers = [pa.array([o[i].astype(np.int32).tobytes() for o in out], pa.binary()) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays([keys, *numbers], names=names)

    names = ["keys", "before", "terms", "first", "places"]
    schema = T.StructType([T.StructField("keys", T.ArrayType(kind))]
                          + [T.StructField(n, T.BinaryType()) for n in names[1:]])
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(lean(rows), schema)


def term_counts(index: DataFrame, size: int) -> np.ndarray:
    """Occurrences of each term in the whole corpus; at most ``size`` numbers reach the driver."""
    def rows(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            for terms, first in zip(b.column(0), b.column(1)):
                terms, first = (np.frombuffer(x.as_py(), np.int32) for x in (terms, first))
                counts[terms] += np.diff(first)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], names=["term", "n"])

    out = np.zeros(size, np.int64)
    got = index.select("terms", "first").mapInArrow(lean(rows), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    for t, n in got.collect():
        out[t] = n
    return out


def match(phrases: Phrases, before, terms, first, places, slop: int = 0):
    """(window, first word) of every occurrence of a window in one row of the index.

    The list of a window's rarest term gives the candidates; lists of the other terms, rarest first and
    shifted by the term's offset, take away those they don't confirm.  ``slop`` lets every other word
    stand up to so many places off.
    """
    where = np.full(len(phrases.vocabulary), -1, np.int64)
    where[terms] = np.arange(len(terms))
    keys = (np.repeat(terms.astype(np.int64), np.diff(first)) << 32) | places
    rarest = phrases.order[:, 0] if len(phrases.order) else np.zeros(0, np.int64)
    row = where[phrases.terms[np.arange(len(rarest)), rarest]] if len(rarest) else rarest
    lists = np.where(row >= 0, first[row + 1] - first[row], 0)
    ends = np.cumsum(lists)
    lo, found = 0, []
    while lo < len(lists):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH, "right")))
        which, at = expand(first[np.maximum(row[lo:hi], 0)].astype(np.int64), lists[lo:hi])
        which += lo
        start = places[at] - rarest[which]
        for j in range(1, phrases.terms.shape[1]):
            if not len(which):
                break
            offset = phrases.order[which, j]
            term = phrases.terms[which, offset]
            want = (term << 32) + np.maximum(start + offset, 0)
            near = np.minimum(np.searchsorted(keys, np.maximum(want - slop, term << 32)), len(keys) - 1)
            keep = (term < 0) | (np.abs(keys[near] - want) <= slop) & (start + offset >= -slop)
            which, start = which[keep], start[keep]
        # A window lies in one document; with slop its ends may fall short of it.
        ok = start >= -slop
        which, start = which[ok], np.maximum(start[ok], 0)
        if len(start):
            anchor = np.minimum(start + np.minimum(rarest[which], phrases.length[which] - 1), before[-1] - 1)
            doc = np.searchsorted(before, anchor, "right") - 1
            if slop:
                start = np.maximum(start, before[doc])
                ok = start < before[doc + 1]
            else:
                ok = (start >= before[doc]) & (start + phrases.length[which] <= before[doc + 1])
            found.append((which[ok], start[ok], doc[ok]))
        lo = hi
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


def search(index: DataFrame, phrases: Phrases, item_type, slop: int = 0) -> DataFrame:
    """One row for each document: key, n_words, runs of hit words (from, to) and items found."""
    names = ["key", "n_words", "starts", "ends", "items"]
    kind = index.schema["keys"].dataType.elementType
    schema = T.StructType([T.StructField("key", kind), T.StructField("n_words", T.LongType()),
                           T.StructField("starts", T.ArrayType(T.LongType())),
                           T.StructField("ends", T.ArrayType(T.LongType())),
                           T.StructField("items", T.ArrayType(item_type))])
    item_values = np.empty(len(phrases.items), object)
    item_values[:] = phrases.items

    def rows(batches):
        for b in batches:
            for i in range(b.num_rows):
                before, terms, first, places = (np.frombuffer(b.column(c)[i].as_py(), np.int32) for c in range(1, 5))
                before = before.astype(np.int64)
                which, start, doc = match(phrases, before, terms, first, places.astype(np.int64), slop)
                stop = np.minimum(start + phrases.length[which], before[doc + 1])
                edge = np.zeros(int(before[-1]) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, stop, -1)
                hit = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
                # Runs end at document borders, where two documents' hits may touch.
                turn = np.diff(hit)
                on, off = turn == 1, turn == -1
                inner = before[1:-1]
                both = inner[(hit[inner] == 1) & (hit[inner + 1] == 1)] if len(inner) else inner
                on[both] = off[both] = True
                on, off = np.flatnonzero(on), np.flatnonzero(off)
                runs = np.searchsorted(on, before)
                of, at = expand(phrases.item_first[which], np.diff(phrases.item_first)[which])
                pair = np.unique(doc[of] * max(1, len(phrases.items)) + phrases.item_of[at])
                doc_of, item = np.divmod(pair, max(1, len(phrases.items)))
                own = np.searchsorted(doc_of, np.arange(len(before)))
                base = np.repeat(before[:-1], np.diff(runs))
                lists = lambda edges, v: pa.ListArray.from_arrays(pa.array(edges, pa.int32()), v)
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[i].values, pa.array(np.diff(before)),
                    lists(runs, pa.array(on - base)), lists(runs, pa.array(off - base)),
                    lists(own, pa.array(item_values[item].tolist(), arrow_kind))], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    arrow_kind = to_arrow_type(item_type)
    return index.mapInArrow(lean(rows), schema)


def decontaminate(docs: DataFrame, key: str, text: str, tests: DataFrame, item: str, test_text: str,
                  window: int = 10, slop: int = 0) -> DataFrame:
    """Which words of each document lie in a passage of a test item.

    Returns a row for each row of ``docs``: key, n_words, n_hit (words inside an occurrence of
    ``window`` consecutive test words; shorter items are one window each), items (sorted ids of the items
    found).  ``slop`` over 0 adds proximity matches: the rarest word in place and every other one at most
    so many places off.

    Texts are read and split once, whatever the number of test items: postings of all test words are
    checkpointed, then read for the words' counts and for the search.  Windows are searched for in blocks of about
    200,000 words of items, each sent to every task; hits of several blocks are merged by document.

    Null texts have no words.  Items with a null id or without words are never found.  Repeated rows of
    documents get a row each, repeated items count once.  Empty tables give no hits or no rows.
    """
    spark = docs.sparkSession
    tests = tests.select(F.col(f"`{item}`").alias("item"), F.col(f"`{test_text}`").cast("string").alias("text"))
    tests = tests.where("item is not null and text is not null")
    # A word and what separates it take two characters at least.
    chars = tests.agg(F.sum(F.length("text"))).head()[0] or 0
    blocks = max(1, -(-chars // (4 * BLOCK_WORDS)))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    item_type = tests.schema["item"].dataType
    if blocks > 1:
        docs = docs.select(F.struct(F.monotonically_increasing_id().alias("at"), F.col(f"`{key}`").alias("key")).alias("key"),
                           F.col(f"`{text}`").alias("text"))
        key, text = "key", "text"
    vocabulary = vocabulary_of(tests, "text")
    index = checkpointed(build_index(docs, key, text, vocabulary))
    counts, found = term_counts(index, len(vocabulary)), []
    for b in range(blocks):
        phrases = Phrases([tuple(r) for r in tests.where(F.col("block") == b).select("item", "text").collect()], window, vocabulary)
        phrases.rarest_first(counts)
        found.append(search(index, phrases, item_type, slop))
    out = found[0]
    if blocks > 1:
        for more in found[1:]:
            out = out.unionByName(more)
        out = _merged(out).withColumn("key", F.col("key.key"))
    covered = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select(F.col("key"), "n_words", covered.alias("n_hit"), F.array_sort("items").alias("items"))


def _merged(found: DataFrame) -> DataFrame:
    """Runs and items of several blocks of test items, put together by document."""
    g = found.groupBy("key").agg(
        F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_sort(F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))).alias("runs"))
    # Sorted runs: a run counts from where the furthest of those before it ends.
    zero = F.struct(F.lit(0).cast("long").alias("reach"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate("runs", zero, lambda a, r: F.struct(
        F.greatest(a["reach"], r["ends"]).alias("reach"),
        (a["n"] + F.greatest(r["ends"] - F.greatest(a["reach"], r["starts"]), F.lit(0))).alias("n")))
    return g.select("key", "n_words", F.array(F.lit(0).cast("long")).alias("starts"),
                    F.array(total["n"]).alias("ends"), "items")


def drop_contaminated(docs: DataFrame, key: str, text: str, tests: DataFrame, item: str, test_text: str, most: float = 0.0,
                      window: int = 10) -> DataFrame:
    """Rows of ``docs`` of whose words a share of at most ``most`` lies in passages of test items.

    Each row is judged by its own text, whatever its key; null texts stay.  Texts are told by two hashes, and
    only those rows cross the network whose text may be one of the contaminated.
    """
    own = F.col(f"`{text}`").cast("string")
    told = F.struct(F.xxhash64(own).alias("h"), F.xxhash64(F.lit(1), own).alias("g"))
    found = decontaminate(docs.select(told.alias("told"), own.alias("text")), "told", "text", tests, item, test_text, window)
    hit = checkpointed(found.where(F.col("n_hit") > most * F.col("n_words")).select("key.h", "key.g").distinct())
    rows = docs.select(F.struct("*").alias("row"), told.alias("told")).select("row", "told.h", "told.g")
    rows = rows.withColumn("some", suspects(rows, ("h", "g"), hit))
    return rows.where(~F.col("some")).select("row.*").unionByName(
        rows.where("some").join(hit, ["h", "g"], "left_anti").select("row.*"))
