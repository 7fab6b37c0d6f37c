"""Jaccard join on word shingles by a MinHash LSH forest."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.arrays import marked, place_of, suspects
from echoframe.llm.text import chunks, expand, lean, mix, shingles, utf8, words
from echoframe.session import checkpointed

WORDS, SIMILARITY = 5, 0.8

#: Least number of tries of the forest, and the probability with which two sets just as similar as the
#: threshold must meet in one of them.  It holds for each pair, whatever the other documents are.
TREES, RECALL = 20, 0.9995

#: Values of the longest prefix, from which each trie is descended.
LONGEST = 9

#: Similarities are estimated from the low bytes of all values of two signatures.  A pair estimated this much below
#: the threshold is no candidate: four standard errors at least.
MARGIN = 0.15

#: Entries with one prefix that a task compares; a larger group is dealt out by the hash of its nodes.
HOT = 2000

#: Sets compared with each other in one task; larger cells are compared block by block.
BLOCK = 400


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sets(column):
    """Shingle hashes of each text, with the number before each text, by stretches: (lo, hi, hashes, before)."""
    data, at = utf8(column)
    for lo, hi in chunks(at):
        h, _, _, before = words(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo])
        yield lo, hi, *shingles(h, before, WORDS)


def forest(threshold: float) -> tuple[int, int]:
    """Tries, and the length down to which prefixes are shortened in them.

    At that length a pair of similarity ``threshold`` has a prefix in common in some trie with probability
    RECALL: 20 tries and 5 values for 0.8 (0.9996).  A threshold too low for 20 tries gets more of them.
    """
    if not 0 < threshold <= 1:
        raise ValueError(f"threshold {threshold}: must be above 0 and at most 1")
    if threshold == 1:
        return TREES, LONGEST
    trees = max(TREES, math.ceil(math.log1p(-RECALL) / math.log1p(-threshold)))
    return trees, max(1, min(LONGEST, int(math.log(1 - (1 - RECALL) ** (1 / trees)) / math.log(threshold))))


def _digests(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each text's shingles: equal for equal texts, whatever the order."""
    out = []
    for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)), dtype=np.uint64)))
        out.append((sums[before[1:]] - sums[before[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(df: DataFrame, key: str, text: str, trees: int, depth: int) -> DataFrame:
    """at (place of the row), key, h (hash of the text), digest a and b and number n of the shingles, and the MinHash
    signature: ``prefixes``, of each trie a hash of the first ``depth`` values, and ``sketch``, all values' low bytes."""
    factors = _multipliers(trees * LONGEST)

    def rows(batches):
        for b in batches:
            for lo, hi, h, before in _sets(b.column(3)):
                n, some = np.diff(before), np.flatnonzero(np.diff(before))
                least = np.zeros((hi - lo, len(factors)), np.uint32)
                for i, f in enumerate(factors if len(some) else ()):
                    least[some, i] = np.minimum.reduceat(h * f, before[some]) >> np.uint64(32)
                a, c = _digests(h, before)
                tries = least.reshape(hi - lo, trees, LONGEST)
                prefix = np.broadcast_to(_multipliers(trees), (hi - lo, trees)).copy()
                for d in range(depth):
                    prefix = mix(prefix ^ tries[:, :, d])
                prefixes = pa.ListArray.from_arrays(np.arange(hi - lo + 1, dtype=np.int32) * trees, pa.array(prefix.ravel().view(np.int64)))
                sketch = pa.array([r.tobytes() for r in least.astype(np.uint8)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i).slice(lo, hi - lo) for i in range(3)), pa.array(a), pa.array(c), pa.array(n), prefixes, sketch],
                    names=["at", "key", "h", "a", "b", "n", "prefixes", "sketch"])

    schema = T.StructType([T.StructField("at", T.LongType()), T.StructField("key", df.schema[key].dataType),
                           T.StructField("h", T.LongType()), *[T.StructField(x, T.LongType()) for x in "abn"],
                           T.StructField("prefixes", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType())])
    return df.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`")),
                     F.col(f"`{text}`").cast("string")).mapInArrow(lean(rows), schema)


def bounds(threshold: float) -> tuple[float, float]:
    """Estimates from which two sets are candidates, and from which one of them stands for both.

    Where x, represented by z, is as similar to y as the threshold, y is at least threshold + (x, z) - 1 similar to z:
    the second bound keeps that above the first.
    """
    least = max(threshold - MARGIN, 0.0)
    return least, max(threshold + (1 - threshold) / 4, 1 - threshold + least + 0.05)


def descend(node: np.ndarray, sketch: np.ndarray, tail: np.ndarray, depth: int, threshold: float) -> tuple[list[tuple], np.ndarray]:
    """Candidates among the entries of one prefix of a trie, (node, leader, prefix length), and the entries left over.

    ``tail`` has the values behind the prefix.  Entries that share the longest prefixes are compared first;
    those that are represented by a leader take no part when prefixes are shortened.  What is connected comes out
    as a star around its least node, with the prefix length at which each entry was met first.
    """
    least, alike = bounds(threshold)
    live, root, met = np.argsort(node, kind="stable"), np.arange(len(node)), np.zeros(len(node), int)
    if least <= 0:
        return [(node[i], node[live[0]], depth) for i in live[1:]], live[:1]
    for length in range(LONGEST, depth - 1, -1):
        if length > depth:
            lead = np.ascontiguousarray(tail[live, :length - depth]).view(f"V{length - depth}").ravel()
            _, own = np.unique(lead, return_inverse=True)
        else:
            own = np.zeros(len(live), int)
        order = np.argsort(own, kind="stable")
        counts = np.bincount(own, minlength=1)
        starts, gone = np.cumsum(counts) - counts, np.zeros(len(node), bool)
        for g in np.flatnonzero(counts > 1):
            rest = live[order[starts[g]:starts[g] + counts[g]]]
            while len(rest) > 1:
                first, rest = rest[0], rest[1:]
                near = (sketch[rest] == sketch[first]).mean(axis=1)
                linked = rest[near >= least]
                met[linked[met[linked] == 0]] = length
                met[first] = met[first] or (length if len(linked) else 0)
                for r in np.unique(root[linked]):
                    root[root == r] = root[first]
                gone[rest[near >= alike]] = True
                rest = rest[near < alike]
        live = live[~gone[live]]
    lowest = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(lowest, root, node)
    leader = lowest[root]
    return [(node[i], leader[i], met[i]) for i in np.flatnonzero(leader != node)], live


FOUND = pa.schema([("node", pa.int64()), ("leader", pa.int64()), ("length", pa.int32()), ("prefix", pa.int64()), ("part", pa.int32()),
                   ("parts", pa.int32()), ("sketch", pa.binary())])
FOUND_SQL = "node long, leader long, length int, prefix long, part int, parts int, sketch binary"


def _groups(batches, columns: int):
    """Tables of the rows that agree in their first ``columns``, from sorted rows read as a stream."""
    held: list[pa.Table] = []

    def whole():
        return pa.concat_tables(held).combine_chunks()

    now = None
    for b in batches:
        if not b.num_rows:
            continue
        marks = [b.column(i).to_numpy() for i in range(columns)]
        change = np.zeros(b.num_rows, bool)
        for m in marks:
            change[1:] |= m[1:] != m[:-1]
        edges = np.concatenate(([0], np.flatnonzero(change), [b.num_rows]))
        for lo, hi in zip(edges[:-1], edges[1:]):
            mark = tuple(m[lo] for m in marks)
            if held and mark != now:
                yield whole()
                held.clear()
            now = mark
            held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
    if held:
        yield whole()


def _sketches(column) -> np.ndarray:
    return np.array([np.frombuffer(x, np.uint8) for x in column.to_pylist()])


def candidates(classes: DataFrame, trees: int, depth: int, threshold: float) -> DataFrame:
    """node, leader, length: nodes that may be similar, found at a common prefix of so many values.

    The tries' entries are sorted by their prefixes of ``depth`` values, and each group is descended into from its
    longest prefixes.  A group of more than HOT entries is compared in parts; then the few entries of each part
    that no other represents are compared part against part.
    """
    entries = classes.select("node", F.posexplode("prefixes").alias("trie", "prefix"))
    groups = entries.groupBy("prefix").agg(F.count("*").alias("members")).where("members > 1")
    # A power of two, so that a node is in one part with the same nodes in all tries.
    parts = F.pow(F.lit(2), F.greatest(F.ceil(F.log2(F.col("members") / HOT)), F.lit(0))).cast("int")
    live = entries.join(groups, "prefix").withColumn("parts", parts).select(
        "node", F.struct("prefix", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "parts", "trie").alias("entry"))
    mine = live.groupBy("node").agg(F.collect_list("entry").alias("entries"))  # as many as there are tries at most
    rows = mine.join(classes.select("node", "sketch"), "node").select("node", "sketch", F.explode("entries").alias("entry"))
    rows = rows.select("entry.prefix", "entry.part", "entry.parts", "entry.trie", "node", "sketch")

    def inside(batches):
        edges: list[tuple] = []
        for t in _groups(batches, 2):
            node, sketch, trie = t["node"].to_numpy(), _sketches(t["sketch"]), t["trie"][0].as_py()
            found, left = descend(node, sketch, sketch[:, trie * LONGEST + depth:(trie + 1) * LONGEST], depth, threshold)
            edges += found
            parts = t["parts"][0].as_py()
            if parts > 1:
                t = t.take(left)
                yield from pa.table([t["node"], pa.nulls(len(t), pa.int64()), pa.nulls(len(t), pa.int32()), t["prefix"], t["part"],
                                     t["parts"], t["sketch"]], schema=FOUND).to_batches()
            if len(edges) > 10_000:
                yield as_rows(edges)
                edges = []
        if edges:
            yield as_rows(edges)

    def as_rows(edges):
        n = len(edges)
        node, leader, length = zip(*edges)
        none = [pa.nulls(n, f.type) for f in FOUND][3:]
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(leader, pa.int64()), pa.array(length, pa.int32()), *none], schema=FOUND)

    def across(batches):
        least, _ = bounds(threshold)
        for t in _groups(batches, 3):
            part, node, sketch = t["part"].to_numpy(), t["node"].to_numpy(), _sketches(t["sketch"])
            low, high = (np.flatnonzero(part == t[c][0].as_py()) for c in ("low", "high"))
            edges = []
            for i in low:
                j = high[(sketch[high] == sketch[i]).mean(axis=1) >= least]
                edges += [(max(node[x], node[i]), min(node[x], node[i]), depth) for x in j]
            if edges:
                yield as_rows(edges)

    found = checkpointed(rows.repartition("prefix", "part").sortWithinPartitions("prefix", "part").mapInArrow(lean(inside), FOUND_SQL))
    edges = found.where("leader is not null")
    left = found.where("leader is null")
    if not left.isEmpty():
        other = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: x != F.col("part"))).alias("other")
        both = left.select("prefix", "part", "node", "sketch", other).select(
            "prefix", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "node", "sketch")
        edges = edges.unionByName(both.repartition("prefix", "low", "high").sortWithinPartitions("prefix", "low", "high")
                                  .mapInArrow(lean(across), FOUND_SQL))
    return edges.groupBy("node", "leader").agg(F.max("length").alias("length"))


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (node, leader) that connect the same nodes, of which each has one, but for leaders.

    A node leads to the least of its leaders (of which it has one a trie at most), and so do its other leaders.
    Leaders are few where a group is large, so their edges fall together.
    """
    stars = edges.groupBy("node").agg(F.array_sort(F.collect_set("leader")).alias("all"))
    least = F.element_at("all", 1)
    follow = F.array_append(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), F.col("node"))
    return stars.select(least.alias("leader"), F.explode(follow).alias("node")).select("node", "leader").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of ``edges`` (node, leader) is connected with.

    Every round takes the least label among the neighbours, then that label's own label; rounds grow with
    the logarithm of the longest chain.
    """
    pairs = edges.select(F.explode(F.array(F.struct(F.col("node").alias("x"), F.col("leader").alias("y")),
                                           F.struct(F.col("leader").alias("x"), F.col("node").alias("y")),
                                           F.struct(F.col("node").alias("x"), F.col("node").alias("y")),
                                           F.struct(F.col("leader").alias("x"), F.col("leader").alias("y")))).alias("e"))
    pairs = checkpointed(pairs.select("e.*").distinct())
    labels, last = checkpointed(pairs.groupBy("x").agg(F.min("y").alias("root")).withColumnRenamed("x", "node")), None
    while True:
        # Labels only ever fall, so a round that leaves their sum as it was has changed none.
        total = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).head()[0]
        if total == last:
            return labels
        low = pairs.join(labels, pairs.y == labels.node).groupBy("x").agg(F.min("root").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("root").alias("far"))
        labels = checkpointed(low.join(jump, "low").select(F.col("x").alias("node"), F.least("low", "far").alias("root")))
        last = total


def _wanted_sets(df: DataFrame, key: str, text: str, cells: DataFrame) -> DataFrame:
    """key, a, b, n and shingles of the documents whose key may be in ``cells``."""
    found = marked(cells.select(place_of("key").alias("p")))
    kind = df.schema[key].dataType

    def rows(batches):
        for b in batches:
            b = b.filter(pa.array(found(b.column(2).to_numpy())))
            for lo, hi, h, before in _sets(b.column(1)):
                a, c = _digests(h, before)
                own = pa.array([np.unique(h[x:y]).tobytes() for x, y in zip(before[:-1], before[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(a), pa.array(c), pa.array(np.diff(before)), own],
                    names=["key", "a", "b", "n", "set"])

    schema = T.StructType([T.StructField("key", kind), *[T.StructField(x, T.LongType()) for x in "abn"],
                           T.StructField("set", T.BinaryType())])
    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).select(
        "key", "text", place_of("key").alias("p")).mapInArrow(lean(rows), schema)


LINKED = "node long, links long, root long, partners array<struct<node: long, similarity: double>>"


def _compare(threshold: float, list_pairs: bool):
    """Function that compares the sets of one block, or of two blocks with each other."""
    def links(group: pa.Table) -> pa.Table:
        # A row that is repeated in the documents comes repeatedly.
        node, first = np.unique(group["node"].to_numpy(), return_index=True)
        block, size = group["block"].to_numpy()[first], group["size"].to_numpy()[first]
        sets = [np.frombuffer(group["set"][int(i)].as_py(), np.uint64) for i in first]
        n = np.array([len(s) for s in sets])
        _, number = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(n)), n)[np.argsort(number, kind="stable")]
        count = np.bincount(number)
        start, edges = np.cumsum(count) - count, np.concatenate(([0], np.cumsum(n)))
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        total, root, partners = np.zeros(len(n), np.int64), np.arange(len(n)), [[] for _ in n]

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in np.flatnonzero(block == low):
            own = number[edges[i]:edges[i + 1]]
            own = own[count[own] > 1]
            shared = np.zeros(len(n), np.int64)
            for at in range(0, len(own), 4096):
                part = own[at:at + 4096]
                shared += np.bincount(owner[expand(start[part], count[part])[1]], minlength=len(n))
            other = (block == high) if low != high else np.arange(len(n)) > i
            with np.errstate(invalid="ignore"):
                s = shared / (n + n[i] - shared)
            j = np.flatnonzero(other & (s >= threshold))
            total[i] += size[j].sum()
            total[j] += size[i]
            for x in j:
                a, b = top(i), top(x)
                root[max(a, b)] = min(a, b)
            if list_pairs:
                partners[i] = [{"node": int(node[x]), "similarity": float(s[x])} for x in j]
        kind = pa.list_(pa.struct([("node", pa.int64()), ("similarity", pa.float64())]))
        return pa.table({"node": node, "links": total, "root": node[[top(i) for i in range(len(n))]],
                         "partners": pa.array(partners, kind)})

    return links


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = SIMILARITY, list_pairs: bool = False) -> DataFrame:
    """One row for each row of ``df``: key, copy_of, class_id, n_links.

    Documents are linked if the Jaccard similarity of their sets of five-word shingles (a shorter text is
    one shingle) is at least ``threshold``.  ``copy_of`` is the least key among documents with the same
    shingles, ``class_id`` the least key among those connected by links, ``n_links`` the number of other
    documents linked with this one, copies included.  With ``list_pairs``, a row for each linked pair of
    different shingle sets instead: copy_of (the two classes' keys, ``one`` and ``two``) and similarity.

    1. One scan makes signatures; equal sets become one node.
    2. Nodes are put into tries by their signatures.  Each trie is descended from its longest prefixes, which are
       shortened until a pair of similarity ``threshold`` has one in common with probability RECALL, however many
       other pairs there are.  Estimates from the signatures drop pairs far below the threshold.
    3. Candidates are connected to cells by stars, so that a large group costs no pairs.
    4. A second scan makes the sets of nodes in cells only; a cell is compared in one task, or, if it
       is larger than BLOCK, block against block.  Every similarity that counts is exact.

    Null texts and texts without words have no links and are classes of their own.  Null keys are ordinary
    keys without a name: they take part, and come out as null.  Repeated rows are copies of each other.
    An empty table gives no rows.
    """
    found = _classes(df, key, text, threshold, list_pairs)
    return found if list_pairs else found.drop("at", "h", "n", "root")


def _classes(df: DataFrame, key: str, text: str, threshold: float, list_pairs: bool) -> DataFrame:
    trees, depth = forest(threshold)
    rows = checkpointed(signatures(df, key, text, trees, depth))
    # Copies have one signature; the row of a class' least place gives it.
    classes = rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("at").alias("node"), F.min("key").alias("key"), F.count("*").alias("size"))
    classes = checkpointed(classes.join(rows.select(F.col("at").alias("node"), "prefixes", "sketch"), "node"))
    cells = components(contracted(contracted(candidates(classes, trees, depth, threshold))))
    sizes = cells.groupBy("root").agg(F.count("*").alias("members"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    cells = checkpointed(cells.join(sizes, "root").select("node", F.col("root").alias("cell"), blocks.alias("blocks"))
                         .join(classes.drop("prefixes", "sketch"), "node"))
    sets = _wanted_sets(df, key, text, cells)
    same = F.col("c.key").eqNullSafe(F.col("s.key")) & (F.col("c.a") == F.col("s.a")) & (F.col("c.b") == F.col("s.b")) & (F.col("c.n") == F.col("s.n"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # Copies under one key, null among them, come once.
    pairs = (cells.alias("c").join(sets.alias("s"), same).groupBy("c.node", "c.cell", "c.blocks", "c.size").agg(F.first("s.set").alias("set"))
             .withColumn("block", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("node", "cell", "size", "set", "block", "blocks", F.least("block", "other").alias("low"),
                     F.greatest("block", "other").alias("high")))
    found = checkpointed(pairs.groupBy("cell", "low", "high").applyInArrow(_compare(threshold, list_pairs), LINKED))
    if list_pairs:
        name = classes.select("node", "key")
        return (found.select("node", F.explode("partners").alias("p")).select("node", F.col("p.node").alias("other"), "p.similarity")
                .join(name.withColumnRenamed("key", "one"), "node")
                .join(name.select(F.col("node").alias("other"), F.col("key").alias("two")), "other")
                .select("one", "two", "similarity"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    # Where a cell was compared in blocks, its parts' components still have to be put together.
    split = found.join(cells.where("blocks > 1").select("node"), "node", "left_semi").where("node <> root")
    split = checkpointed(split.select("node", F.col("root").alias("leader")).distinct())
    if not split.isEmpty():
        whole = components(split).withColumnRenamed("root", "whole")
        links = links.join(whole, "node", "left").select("node", "links", F.coalesce("whole", "root").alias("root"))
    linked = links.join(classes.select("node", "key"), "node")
    names = linked.groupBy("root").agg(F.min("key").alias("class_id"))
    named = classes.select("node", "a", "b", "n", F.col("key").alias("copy_of"), "size").join(
        links.join(names, "root").select("node", "links", "class_id", "root"), "node", "left").withColumn(
        "root", F.coalesce("root", "node")).drop("node")
    return rows.select("at", "key", "h", "a", "b", "n").join(named, ["a", "b", "n"], "left").select(
        "at", "key", "h", "n", "root", F.when(F.col("n") > 0, F.col("copy_of")).otherwise(F.col("key")).alias("copy_of"),
        F.coalesce("class_id", "copy_of", "key").alias("class_id"),
        F.coalesce(F.col("size") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"))


def deduplicate(df: DataFrame, key: str, text: str, threshold: float = SIMILARITY) -> DataFrame:
    """Rows of ``df``, one of each class of near duplicates: of those with the least key the first.

    Rows without words are all kept.  Of repeated rows one stays.  Keys may be null or repeated: a null key
    is chosen only where a class has no other.
    """
    found = _classes(df, key, text, threshold, False).where("n_links > 0")
    kept = found.where(F.col("key").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("at", "key", "h")).alias("first")).select(
        F.col("first.key").alias("key"), F.col("first.h").alias("h"))
    # The text's hash tells rows of one key apart; rows of one key and text are copies of each other.
    in_classes = checkpointed(found.select(F.col("key").alias("id"), "h").distinct())
    dropped = in_classes.exceptAll(kept.distinct()).select(F.col("id").alias("gone"), F.col("h").alias("gone_h"))
    has_words = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]")
    rows = df.select(F.struct("*").alias("row"), F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), has_words.alias("some"))
    rows = rows.withColumn("some", F.col("some") & suspects(rows, ("id", "h"), in_classes))
    # Rows of no class of several stay where they lie; only the others cross the network.
    out = rows.where("some").join(dropped, F.col("id").eqNullSafe(F.col("gone")) & (F.col("h") == F.col("gone_h")), "left_anti")
    first = F.row_number().over(Window.partitionBy("id", "h").orderBy(F.xxhash64("row")))
    return rows.where(~F.col("some")).select("row.*").unionByName(out.withColumn("first", first).where("first = 1").select("row.*"))
