"""Packing into fixed windows of tokens by lexical retrieval."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.text import expand, give_back, lean, process_wide
from echoframe.session import checkpointed

#: Tokens of a shard of the index; each is packed by itself and leaves at most one window unfilled.
SHARD_TOKENS = 1_000_000

#: Fixed values of the usual ranking formula.
K1, B = 1.2, 0.75

#: Terms in more than this share of a shard's documents are summed as a matrix, others by their postings.
COMMON = 0.25

#: What the pattern of the public ranks calls white space (unlike Python, not the separators 1C to 1F).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: White space of several characters with something behind it, for Arrow; and what comes before its last character.
RUN = f"[{SPACE}][{SPACE}][^{SPACE}]"
BEFORE_LAST = re.compile(f"[{SPACE}](?=[{SPACE}][^{SPACE}])")

#: The pattern of the public ranks.  Its look-ahead keeps the last white space of a run for what follows.
LOOKING = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = LOOKING.replace(r"\s+(?!\S)|", "")


class Tokenizer:
    """Ids of whole texts by a byte-level BPE.

    Patterns with a look-ahead take a slower engine.  The usual one needs its look-ahead only where white
    space of several characters has something behind it, so texts are cut there, and the pattern
    without it gives the same words.  Texts with the name of a special token in them are encoded as
    defined, as are all without ranks.
    """

    def __init__(self, definition: str, ranks: bytes | None, pattern: str | None):
        self.definition, parsed = definition, json.loads(definition)
        self.special = [t["content"] for t in parsed.get("added_tokens", ())]
        ids = [*parsed["model"]["vocab"].values(), *(t["id"] for t in parsed.get("added_tokens", ()))]
        self.kind = np.dtype("<u2" if max(ids) < 1 << 16 else "<u4")
        del parsed, ids
        self.fast = None
        self.cut = pattern == LOOKING
        if ranks:
            import base64

            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PLAIN if self.cut else pattern, mergeable_ranks=table,
                                          special_tokens={})

    @cached_property
    def whole(self):
        """The tokenizer as defined; only texts that the ranks cannot encode need it, and its 40 MB."""
        from tokenizers import Tokenizer as Definition

        return Definition.from_str(self.definition)

    def __call__(self, text: str, run: bool = True) -> bytes:
        """Ids of a text; ``run`` is False where it is known to have no match of RUN."""
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
        ends = [m.end() for m in BEFORE_LAST.finditer(text)] if self.cut and run else []
        if not ends:
            return array(self.kind.char, self.fast.encode_ordinary(text)).tobytes()
        ids = array(self.kind.char)
        for lo, hi in zip([0, *ends], [*ends, len(text)]):
            ids.extend(self.fast.encode_ordinary(text[lo:hi]))
        return ids.tobytes()


def tokenize(df: DataFrame, key: str, text: str, definition: str, ranks: str | None = None, pattern: str | None = None,
             end: int = 1) -> DataFrame:
    """at (place of the row), key, n and the ids of every text, ``end`` last, as little-endian binary.

    ``definition`` is the path of a ``tokenizers`` file on the driver, ``ranks`` (with ``pattern``) the same
    vocabulary as ranks, which encodes faster.  Null texts have the end only.
    """
    with open(definition) as f:
        body = f.read()
    fast = None
    if ranks:
        with open(ranks, "rb") as f:
            fast = f.read()
    name = f"tokenizer {zlib.crc32(body.encode())} {zlib.crc32(fast or b'')}"

    def rows(batches):
        tokenizer = process_wide(name, lambda: Tokenizer(body, fast, pattern))
        last = np.array([end], tokenizer.kind).tobytes()
        for b in batches:
            texts = b.column(2)
            # A thousand texts at a time, so that ids of a batch are not all held twice.
            for lo in range(0, b.num_rows, 1000):
                some = texts.slice(lo, 1000)
                runs = pc.match_substring_regex(some, RUN).to_pylist()
                ids = [(tokenizer(t, run) if t else b"") + last for t, run in zip(some.to_pylist(), runs)]
                n = pa.array([len(x) // tokenizer.kind.itemsize for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, 1000), b.column(1).slice(lo, 1000), n, pa.array(ids, pa.binary())],
                                                 names=["at", "key", "n", "ids"])

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("key", df.schema[key].dataType),
                           T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return df.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{key}`"),
                     F.col(f"`{text}`").cast("string")).mapInArrow(lean(rows), schema)


def _flat(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column, and the number of ids before each row."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    ids = np.frombuffer(data, f"<u{width}", (at[-1] - at[0]) // width, at[0])
    return ids, (at - at[0]) // width


def document_counts(tokens: DataFrame, width: int, size: int) -> np.ndarray:
    """Documents of each token id, over all documents; as many numbers as the vocabulary has."""
    def rows(batches):
        counts = np.zeros(size, np.int64)
        for b in batches:
            ids, before = _flat(b.column(0), width)
            for lo in range(0, b.num_rows, 200):
                hi = min(lo + 200, b.num_rows)
                doc = np.repeat(np.arange(hi - lo), np.diff(before[lo:hi + 1]))
                own = np.unique(doc * size + ids[before[lo]:before[hi]])
                counts += np.bincount(own % size, minlength=size)
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], names=["term", "docs"])

    out = np.zeros(size, np.int64)
    for t, n in tokens.select("ids").mapInArrow(lean(rows), "term long, docs long").groupBy("term").agg(F.sum("docs")).collect():
        out[t] = n
    return out


def _rarest(ids: np.ndarray, before: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The rarest term of each document that another has too."""
    return np.minimum.reduceat(rank[ids], before[:-1]) & 0xFFFFFFFF if len(before) > 1 else np.zeros(0, np.int64)


class Shard:
    """BM25 postings of one shard's documents."""

    def __init__(self, ids: np.ndarray, before: np.ndarray, idf: np.ndarray, average: float):
        length = np.diff(before)
        size = len(idf)
        doc = np.repeat(np.arange(len(length)), length)
        own, tf = np.unique(doc * size + ids, return_counts=True)
        doc, term = np.divmod(own, size)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[doc] / average))
        self.first = np.searchsorted(doc, np.arange(len(length) + 1))
        self.term, self.n = term, len(length)
        order = np.argsort(term, kind="stable")
        self.docs, self.weight = doc[order], weight[order]
        counts = np.bincount(term, minlength=size)
        self.counts, self.start = counts, np.cumsum(counts) - counts
        # Common terms have so many postings that the matrix takes at most four times their memory.
        common = np.flatnonzero(counts > max(COMMON * self.n, 1))
        self.column = np.full(size, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n))
        row, at = expand(self.start[common], counts[common])
        self.matrix[row, self.docs[at]] = self.weight[at]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with ``seed``, best first by all of its terms."""
        own = self.term[self.first[seed]:self.first[seed + 1]]
        own = own[self.counts[own] > 1]
        column = self.column[own]
        rare = own[column < 0]
        _, at = expand(self.start[rare], self.counts[rare])
        asked = np.zeros(len(self.matrix))
        asked[column[column >= 0]] = 1
        score = np.bincount(self.docs[at], self.weight[at], minlength=self.n) + asked @ self.matrix
        score[used] = 0
        some = np.flatnonzero(score)
        return some[np.argsort(-score[some], kind="stable")]


def fill(length: np.ndarray, neighbours, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, greedily.

    A window begins with a document, or with the rest of one that the last window cut; its best unused
    neighbours follow until the window is full, and the last of them is cut there.
    """
    used, pieces = np.zeros(len(length), bool), []
    sequence, room, seed, upcoming = 0, window, -1, 0

    def place(doc: int) -> None:
        nonlocal sequence, room, seed
        used[doc] = True
        start = 0
        while start < length[doc]:
            if room == window:
                seed = doc
            take = min(room, int(length[doc]) - start)
            pieces.append((doc, start, take, sequence, window - room))
            start, room = start + take, room - take
            if not room:
                sequence, room = sequence + 1, window

    while True:
        while upcoming < len(length) and used[upcoming]:
            upcoming += 1
        if upcoming == len(length):
            return pieces
        now = sequence
        if room < window:
            for doc in neighbours(seed, used):
                place(int(doc))
                if sequence != now:
                    break
        if sequence == now and not used[upcoming]:
            place(upcoming)


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(df: DataFrame, key: str, text: str, definition: str, ranks: str | None = None, pattern: str | None = None,
         window: int = 2048, end: int = 1, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Columns: key, start and length of the piece in its document's ids, ids_crc32 (of little-endian unsigned
    32-bit ids), doc_tokens, sequence_id, offset in the sequence, and ids (binary) if asked for.

    Documents are tokenised once and checkpointed.  Document counts of all terms (token ids) and the
    tokens of the documents with each rarest term reach the driver: as many numbers as the vocabulary has.
    Documents are dealt to shards of about a million tokens in the order of their rarest shared terms, so
    documents that share a rare word meet, and a term with more documents than a shard takes is spread
    over several.  Every shard builds its own BM25 postings with the corpus-wide counts and is filled
    greedily; only its last window is not full.

    Null texts are empty.  Every row has a piece, as every document has an end id.  Repeated rows are
    packed like others.  An empty table gives no rows.
    """
    from tokenizers import Tokenizer as Definition

    size = Definition.from_file(definition).get_vocab_size()
    size = max(size, end + 1)
    width = 2 if size <= 1 << 16 else 4
    tokens = checkpointed(tokenize(df, key, text, definition, ranks, pattern, end))
    total, documents = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    docs_of = document_counts(tokens, width, size)
    idf = np.log(1 + (documents - docs_of + 0.5) / (docs_of + 0.5))
    average = total / max(documents, 1)
    # Terms of one document only come last: nothing is shared by them.
    rank = (np.where(docs_of > 1, docs_of, np.iinfo(np.int32).max) << 32) | np.arange(size)

    def masses(batches):
        mass = np.zeros(size, np.int64)
        for b in batches:
            ids, before = _flat(b.column(0), width)
            np.add.at(mass, _rarest(ids, before, rank), np.diff(before))
        own = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(mass[own])], names=["term", "mass"])

    mass = np.zeros(size, np.int64)
    for t, m in tokens.select("ids").mapInArrow(masses, "term long, mass long").groupBy("term").agg(F.sum("mass")).collect():
        mass[t] = m
    line = np.cumsum(mass) - mass
    shards = max(1, round(total / SHARD_TOKENS))

    def deal(batches):
        for b in batches:
            ids, before = _flat(b.column(3), width)
            term = _rarest(ids, before, rank)
            place = line[term] + b.column(4).to_numpy() / 2.0**31 * mass[term]
            shard = np.minimum((place * shards / max(total, 1)).astype(np.int64), shards - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(shard)], names=["at", "key", "n", "ids", "shard"])

    dealt = tokens.withColumn("u", F.xxhash64("at").bitwiseAND((1 << 31) - 1)).mapInArrow(
        deal, T.StructType([*tokens.schema.fields, T.StructField("shard", T.LongType())]))

    def packed(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        order = np.argsort(group["at"].to_numpy(), kind="stable")
        group = group.take(pa.array(order)).combine_chunks()
        ids, before = _flat(group["ids"].chunk(0), width)
        shard = group["shard"][0].as_py()
        index = Shard(ids, before, idf, average)
        pieces = fill(np.diff(before), index.neighbours, window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        cut = [ids[a:a + n] for a, n in zip(before[doc] + start, length)]
        return pa.table([
            group["key"].take(pa.array(doc)), pa.array(start), pa.array(length),
            pa.array([zlib.crc32(c.astype("<u4").tobytes()) for c in cut], pa.int64()), pa.array(np.diff(before)[doc]),
            pa.array(sequence + (shard << 32)), pa.array(offset),
            pa.array([c.tobytes() if with_ids else None for c in cut], pa.binary())],
            names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *T._parse_datatype_string(PIECES).fields])
    def lean_packed(group):
        try:
            return packed(group)
        finally:
            give_back()

    out = dealt.groupBy("shard").applyInArrow(lean_packed, schema)
    return out if with_ids else out.drop("ids")
