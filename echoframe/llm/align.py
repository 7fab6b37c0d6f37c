"""Alignment of two tokenizers' tokens over a corpus."""

from __future__ import annotations

import hashlib
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm import packing
from echoframe.llm.arrays import Arrays, mounted_folder, shards_for, store
from echoframe.llm.text import expand, mix, process_wide
from echoframe.session import checkpointed

#: Tokens of A after which a long document goes on in another lane, at the next place where both tokenizers cut.
LANE = 512

#: Bytes of text encoded and merged at a time.
STRETCH = 2 << 20

#: Pairs of a group up to which they are listed; larger groups are counted by their distinct ids.
LISTED = 64

#: Id pairs that a task counts before it passes them on.
COUNTED = 4_000_000

#: Ways of writing that a worker remembers the pieces of.
REMEMBERED = 300_000

SPACE = "▁"


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level token stands for.

    Printable bytes stand for themselves; the others are, in order, the characters from U+0100 on.
    """
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoders:
    """Ids of a text by a byte-level BPE (A, of a space and the text) and by a sentence-piece model (B).

    B has no token that goes on behind a space (a piece with a space inside turns this off), so it encodes
    texts with single spaces between words word by word, most of them from memory.
    """

    def __init__(self, definition: str, ranks: bytes | None, pattern: str | None, model: bytes):
        import sentencepiece

        self.a = packing.Tokenizer(definition, ranks, pattern)
        # Names of special tokens in a text are ordinary text.
        self.a.special, self.a.whole.encode_special_tokens = [], True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.known: dict[str, bytes] = {}
        character = byte_level()
        vocabulary = {i: t for t, i in self.a.whole.get_vocab().items()}
        self.bytes_a = [bytes(character.get(c, 0x3F) for c in vocabulary.get(i, "")) for i in range(max(vocabulary) + 1)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.length_a, self.length_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))
        # The decimal ids, each with what may follow it: a comma, or the end of its side of a group.
        self.text = [f"{i}{end}" for x, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for end in ends for i in range(len(x))]

    def _pieces(self, text: str) -> bytes:
        return np.array(self.b.encode(text, num_threads=1), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        got = self.known.get(word)
        if got is None:
            got = self._pieces(word)
            if len(self.known) < REMEMBERED:
                self.known[word] = got
        return got

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A and B, or None where the tokens' bytes are not those of a space and the text."""
        if not text or SPACE in text:  # B's own sign for a space would come back as one
            return None
        words = text.split(" ")
        single = self.by_word and "" not in words
        a = np.frombuffer(self.a(" " + text), self.a.kind).astype(np.int64)
        b = np.frombuffer(b"".join(map(self._word, words)) if single else self._pieces(text), "<u4").astype(np.int64)
        whole = b" " + text.encode()
        for ids, have in ((a, self.bytes_a), (b, self.bytes_b)):
            if b"".join(map(have.__getitem__, ids.tolist())) != whole:
                return None
        return a, b


def lanes(first: np.ndarray, last: np.ndarray, end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last token of A in each lane: documents, the long ones divided where both tokenizers cut.

    About every LANE tokens the next few ends of A are looked up among those of B; where none is found the
    lane goes on.
    """
    counts = np.maximum((last - first) // LANE - 1, 0)
    which, k = expand(np.ones(len(first), np.int64), counts)
    near = (first[which] + k * LANE)[:, None] + np.arange(32)
    ends = end_a[near]
    place = np.minimum(np.searchsorted(end_b, ends), len(end_b) - 1)
    hit = end_b[place] == ends
    cut = near[np.arange(len(near)), hit.argmax(axis=1)][hit.any(axis=1)]
    starts = np.sort(np.concatenate((first, cut + 1)))
    return starts, np.append(starts[1:], last[-1] if len(last) else 0)


def merge(end_a: np.ndarray, end_b: np.ndarray, first_a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last token of A and of B in every group, in order.

    ``end_a`` and ``end_b`` are the tokens' ends in one running count of bytes over all documents, ``first_a``
    the first token of each document.  The pointers of all lanes advance together: that whose token ends
    first, or both where the ends are one, which is a cut.  Lanes that are through leave the state.
    """
    if not len(end_a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, stop = lanes(first_a, np.append(first_a[1:], len(end_a)), end_a, end_b)
    before = np.where(i > 0, end_a[i - 1], 0)
    j = np.searchsorted(end_b, before, "right")
    cuts_a, cuts_b = [], []
    while len(i):
        a, b = end_a[i], end_b[j]
        same = a == b
        cuts_a.append(i[same])
        cuts_b.append(j[same])
        i = i + (a <= b)
        j = j + (b <= a)
        live = i < stop
        if not live.all():
            i, j, stop = i[live], j[live], stop[live]
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


def links(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, document: np.ndarray, width: int, size: int
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, pair (id of A x ``width`` + id of B) and number of occurrences of all linked pairs, sorted.

    ``document`` is that of each group, below ``size``.  A group links all its tokens of A with all of B.
    """
    lo_a, lo_b = (np.concatenate(([0], c[:-1] + 1)) if len(c) else c for c in (cut_a, cut_b))
    n_a, n_b = cut_a + 1 - lo_a, cut_b + 1 - lo_b
    few = np.flatnonzero(n_a * n_b <= LISTED)
    which, k = expand(np.zeros(len(few), np.int64), (n_a * n_b)[few])
    g = few[which]
    pair = a[lo_a[g] + k // n_b[g]] * width + b[lo_b[g] + k % n_b[g]]
    owner, times = document[g], np.ones(len(g), np.int64)
    more = [(owner, pair, times)]
    for g in np.flatnonzero(n_a * n_b > LISTED):
        x, nx = np.unique(a[lo_a[g]:cut_a[g] + 1], return_counts=True)
        y, ny = np.unique(b[lo_b[g]:cut_b[g] + 1], return_counts=True)
        p = (x[:, None] * width + y).ravel()
        more.append((np.full(len(p), document[g]), p, (nx[:, None] * ny).ravel()))
    owner, pair, times = (np.concatenate(x) for x in zip(*more))
    order = np.lexsort((pair, owner))
    owner, pair, times = owner[order], pair[order], times[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(pair), 1), bool), (owner[1:] != owner[:-1]) | (pair[1:] != pair[:-1]))))
    return owner[first], pair[first], np.add.reduceat(times, first) if len(first) else times


def packed(pair: np.ndarray, times: np.ndarray) -> bytes:
    """Sorted pairs and their numbers in few bytes: differences, byte by byte of their place, compressed."""
    both = np.stack((np.diff(pair, prepend=0), times)).astype("<i8")
    return pa.Codec("zstd", 1).compress(both.view(np.uint8).reshape(-1, 8).T.tobytes(), asbytes=True)


def unpacked(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.Codec("zstd", 1).decompress(blob, 16 * n, asbytes=True)
    both = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").reshape(2, -1)
    return np.cumsum(both[0]), both[1]


MADE = ("key", "n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256", "n_pairs", "pairs")


def aligned(df: DataFrame, key: str, text: str, definition: str, ranks: str | None, pattern: str | None, model: str,
            with_groups: bool = True) -> DataFrame:
    """Every document's numbers of tokens, groups and links, its groups as text (or their hash only) and its linked pairs."""
    with open(definition) as f:
        body = f.read()
    fast = open(ranks, "rb").read() if ranks else None
    with open(model, "rb") as f:
        proto = f.read()
    name = f"encoders {zlib.crc32(body.encode())} {zlib.crc32(fast or b'')} {zlib.crc32(proto)}"

    def stretch(keys, texts, e):
        n, ids = len(texts), [(e(t) if t else None) for t in texts]
        some = np.array([i for i, x in enumerate(ids) if x is not None], np.int64)
        none = np.zeros(0, np.int64)
        a, b = (np.concatenate([ids[i][s] for i in some]) if len(some) else none for s in (0, 1))
        count_a, count_b = (np.array([len(ids[i][s]) for i in some], np.int64) for s in (0, 1))
        end_a, end_b = np.cumsum(e.length_a[a]), np.cumsum(e.length_b[b])
        # A token without bytes would end where the one before it does; no vocabulary has one in a text.
        cut_a, cut_b = merge(end_a, end_b, np.cumsum(count_a) - count_a)
        last_a = np.cumsum(count_a) - 1
        group_of = np.searchsorted(last_a, cut_a)
        owner, pair, times = links(a, b, cut_a, cut_b, group_of, len(e.bytes_b), len(some))
        out = {c: np.zeros(n, np.int64) for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
        out["n_a"][some], out["n_b"][some] = count_a, count_b
        out["n_groups"][some] = np.bincount(group_of, minlength=len(some))
        edges = np.searchsorted(owner, np.arange(len(some) + 1))
        out["n_pairs"][some] = np.diff(edges)
        sums = np.concatenate(([0], np.cumsum(times)))
        out["n_links"][some] = sums[edges[1:]] - sums[edges[:-1]]
        # Tokens of both in order of groups, each with its sign: A's tokens of a group, then B's.
        in_a, in_b = np.searchsorted(cut_a, np.arange(len(a))), np.searchsorted(cut_b, np.arange(len(b)))
        sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        sign_a[cut_a] = sign_b[cut_b] = 1
        order = np.empty(len(a) + len(b), np.int64)
        before_b, upto_a = np.concatenate(([0], cut_b + 1)), cut_a + 1
        order[np.arange(len(a)) + before_b[in_a]] = a + sign_a * len(e.bytes_a)
        order[np.arange(len(b)) + upto_a[in_b]] = b + sign_b * len(e.bytes_b) + 2 * len(e.bytes_a)
        at = np.concatenate(([0], np.cumsum(count_a + count_b)))
        groups, digest, blobs = [""] * n, [""] * n, [b""] * n
        for d, i in enumerate(some):
            told = "".join(map(e.text.__getitem__, order[at[d]:at[d + 1]].tolist()))[:-1]
            groups[i], digest[i] = told if with_groups else None, hashlib.sha256(told.encode()).hexdigest()
            blobs[i] = packed(pair[edges[d]:edges[d + 1]], times[edges[d]:edges[d + 1]])
        return pa.RecordBatch.from_arrays(
            [keys, *(pa.array(out[c]) for c in ("n_a", "n_b", "n_groups", "n_links")), pa.array(groups, pa.string()),
             pa.array(digest, pa.string()), pa.array(out["n_pairs"]), pa.array(blobs, pa.binary())], names=list(MADE))

    def rows(batches):
        e = process_wide(name, lambda: Encoders(body, fast, pattern, proto))
        for batch in batches:
            texts, lo = batch.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= STRETCH):
                    size += len(texts[hi] or "")
                    hi += 1
                yield stretch(batch.column(0).slice(lo, hi - lo), texts[lo:hi], e)
                lo = hi

    long = T.LongType()
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *[T.StructField(c, long) for c in MADE[1:5]],
                           T.StructField("groups", T.StringType()), T.StructField("groups_sha256", T.StringType()),
                           T.StructField("n_pairs", long), T.StructField("pairs", T.BinaryType())])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(rows, schema)


def stretches(batches, column: int):
    """Batches cut into pieces of about a million pairs; ``column`` has each row's number of pairs."""
    for batch in batches:
        lo, upto = 0, np.cumsum(batch.column(column).to_numpy())
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + COUNTED // 4, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def document_counts(found: DataFrame, width: int) -> DataFrame:
    """key (a hash), id (of A) and n of every pair that some document links: the number of documents that do."""
    def count(batches):
        def out():
            pair, n = combined(held)
            first = pair // width
            return pa.RecordBatch.from_arrays([pa.array(mix(pair.astype(np.uint64)).view(np.int64)), pa.array(first), pa.array(n)],
                                              names=["key", "id", "n"])

        held, size = [], 0
        for b in stretches(batches, 0):
            parts = [unpacked(blob, n)[0] for n, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if n]
            if parts:
                pair, n = np.unique(np.concatenate(parts), return_counts=True)
                held.append((pair, n))
                size += len(pair)
            if size > COUNTED:
                held = [combined(held)]
                size = len(held[0][0])
                if size > COUNTED // 2:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return found.select("n_pairs", "pairs").mapInArrow(count, "key long, id long, n long").groupBy("key", "id").agg(F.sum("n").alias("n"))


def combined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys of several counts put together."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def align(df: DataFrame, key: str, text: str, definition: str, ranks: str | None, pattern: str | None, model: str,
          with_groups: bool = True) -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups and groups_sha256 of every row.

    A encodes a space and the text, B the text (and adds the space itself).  Byte offsets where tokens of both end
    cut them into groups; a token of A is linked with every token of B in its group.  ``groups`` lists them
    as ``a1,a2|b1;a3|b2,b3``.  The count of an id pair is the number of rows that link it; ``n_best`` counts the
    links whose count is the highest of their A id (ties included), ``count_sum`` adds up the counts of all links.

    1. Documents are encoded and merged stretch by stretch, all lanes in lockstep; pairs are kept, compressed.
    2. Counts of pairs are added up in tasks, then by key, and stored as sorted arrays.
    3. Each document's pairs are looked up there.

    Null and empty texts, and texts that one of the tokenizers does not give back byte by byte (B knows no
    U+2581), have zeros and empty groups.  Repeated rows are documents of their own; keys only pass through.
    An empty table gives no rows.  A text is encoded whole, whatever its length.
    """
    with open(model, "rb") as f:
        proto = f.read()
    with open(definition) as f:
        vocabulary = json.load(f)["model"]["vocab"]
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_proto=proto).get_piece_size()
    if len(vocabulary) * width >= 1 << 62:
        raise ValueError("vocabularies too large for one number a pair")
    found = checkpointed(aligned(df, key, text, definition, ranks, pattern, model, with_groups))
    counts = document_counts(found, width)
    top = F.max("n").over(Window.partitionBy("id"))
    counts = checkpointed(counts.select("key", "n", (F.col("n") == top).cast("byte").alias("best")))
    shards = shards_for(counts.count())
    # The leading half of a key times the number of shards, as in ``shard_of``.
    shard = F.shiftright(F.shiftrightunsigned("key", 32) * shards, 32).cast("int")
    made, written = store(counts.withColumn("shard", shard), [("n", "<i8"), ("best", "u1")], mounted_folder(df.sparkSession, "pairs"), shards)
    written.count()
    return found.mapInArrow(_looked_up(made, with_groups), T.StructType(
        [found.schema["key"], *[T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")],
         *[found.schema[c] for c in (["groups"] if with_groups else []) + ["groups_sha256"]]]))


def _looked_up(made: Arrays, with_groups: bool):
    def rows(batches):
        for b in stretches(batches, 7):
            n = b.column(7).to_numpy()
            parts = [unpacked(blob, k) for blob, k in zip(b.column(8).to_pylist(), n) if k]
            pair, times = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            asked, back = np.unique(pair, return_inverse=True)
            _, got = made(mix(asked.astype(np.uint64)))
            edges = np.concatenate(([0], np.cumsum(n)))
            best, total = (np.concatenate(([0], np.cumsum(v))) for v in (got["best"][back] * times, got["n"][back] * times))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(5)), pa.array(best[edges[1:]] - best[edges[:-1]]), pa.array(total[edges[1:]] - total[edges[:-1]]),
                 *([b.column(5)] if with_groups else []), b.column(6)],
                names=["key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", *(["groups"] if with_groups else []), "groups_sha256"])

    return rows
