"""Words, shingles and hashes of whole batches of texts, as numpy arrays.

Functions take a flat UTF-8 buffer with the offset of each text (``utf8`` makes both from an Arrow
column without copying) and never touch single characters in Python.  Words are maximal runs of 0-9,
A-Z (as a-z), a-z and non-ASCII characters.
"""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once: temporaries take about fifty times as much memory.
CHUNK = 1 << 20

SEED = 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _word_bytes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for lo, hi in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        table[lo:hi] = np.arange(lo, hi)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


WORD = _word_bytes()


def process_wide(name: str, make: Callable):
    """A value made once in each Python worker and kept from task to task."""
    kept = vars(sys).setdefault("_echoframe_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def give_back() -> None:
    """Return memory that is free to the system: a worker lives on, and what it kept would add up from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = process_wide("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim is not None:
        trim(0)


def lean(rows: Callable) -> Callable:
    """A task function that gives free memory back when it is through."""
    @functools.wraps(rows)
    def run(batches):
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def _powers(base: int, n: int) -> np.ndarray:
    kept = process_wide(f"powers {base}", dict)
    if len(kept.get("p", ())) < n:
        p = np.full(max(n, CHUNK), base, np.uint64)
        p[0] = 1
        kept["p"] = np.cumprod(p, dtype=np.uint64)
    return kept["p"][:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0]:at[-1]], at - at[0]


def chunks(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes each; a longer text is a range of its own."""
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values in place (the splitmix64 finaliser, whose constants are fixed values)."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _piece(data: np.ndarray, firsts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = table[data]
    inside = low > 0
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    starts[firsts] = inside[firsts]
    before = firsts[firsts > 0] - 1
    ends[before] = inside[before]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    n = len(data)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(low * _powers(BASE, n), out=sums[1:])
    h = sums[ends]
    h -= sums[starts]
    h *= _powers(BASE_INVERSE, n)[starts]
    return mix(h), starts, ends


def words(data: np.ndarray, at: np.ndarray, table: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and the number of words before each text.

    ``table`` has what each byte counts as in a word, 0 for those between words.
    """
    hashes, starts, ends = [], [], []
    lo, n = 0, len(data)
    firsts = at[:-1][at[:-1] < n]
    while lo < n:
        hi = min(lo + CHUNK, n)
        while hi < n and table[data[hi]] and table[data[hi - 1]]:  # never cut in a word
            stop = np.flatnonzero(table[data[hi:hi + 4096]] == 0)
            hi = hi + int(stop[0]) if len(stop) else min(hi + 4096, n)
        here = firsts[np.searchsorted(firsts, lo):np.searchsorted(firsts, hi)] - lo
        h, s, e = _piece(data[lo:hi], here, table)
        hashes.append(h)
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    join = (lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind))
    starts = join(starts, np.int64)
    return join(hashes, np.uint64), starts, join(ends, np.int64), np.searchsorted(starts, at)


def shingles(h: np.ndarray, before: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``k`` words of each text, and the number of runs before each text.

    A text of fewer words, but not none, has one run: all of them.
    """
    counts = np.diff(before)
    owner = np.repeat(np.arange(len(counts)), counts)
    runs = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    place = np.arange(len(h)) - before[:-1][owner]
    first = np.flatnonzero(place < runs[owner])
    length = np.minimum(counts[owner[first]], k)
    out = np.full(len(first), SEED, np.uint64)
    for j in range(k):
        use = j < length
        at = np.minimum(first + j, max(len(h) - 1, 0))
        out = np.where(use, (out ^ h[at]) * np.uint64(BASE), out)
        out ^= out >> np.uint64(29)
    return mix(out), np.concatenate(([0], np.cumsum(runs)))


def expand(lo: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``counts`` elements from ``lo``: the range and the element of each."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts) - counts)[which] + lo[which]
