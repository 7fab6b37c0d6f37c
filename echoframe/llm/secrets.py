"""Secret scans: regex rules behind a trigram inverted index."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _parser as regex_tree

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.text import chunks, lean, utf8

#: Alternatives of a part of a regex that are still written out letter by letter.
EXACT = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping, whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: A private key from its header to its END line, or, where that is missing, to the end of its base64 lines.
#: Line breaks may be written out as in JSON.
PEM = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
       r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
       r"|(?:(?:\s|\\[rn])+(?:Proc-Type|DEK-Info):[^\r\n\\]*)*"
       r"(?:(?:(?:\s|\\[rn])+[A-Za-z0-9+/]{20,}={0,2})+(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/]+={0,2}(?=\s|\\|\Z))?)?)")

# The three rules that the contract states, then common published token formats.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    # Runs of at least 32: the same spans as runs of any length, kept if they have 32 characters.
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("pem", PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


# ---- Boolean queries: True (all texts), a trigram, ("and", parts) or ("or", parts)

def _join(word: str, parts: list):
    """Conjunction or disjunction without what changes nothing."""
    if word == "or" and any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else (word, tuple(parts))


def _letters(strings: set[str]):
    """Trigrams of whichever of the strings occurs; none can be asked for if one is too short."""
    each = []
    for s in sorted(strings):
        b = s.encode()
        each.append(_join("and", [b[i:i + 3] for i in range(len(b) - 2)]))
    return _join("or", each)


def _written_out(op, arg) -> set[str] | None:
    """All strings that a part of a regex matches, in lower case, if they are few."""
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()} if arg < 128 else {chr(arg)}
    if name == "IN" and all(str(o) == "LITERAL" for o, _ in arg):
        return {chr(a).lower() if a < 128 else chr(a) for _, a in arg}
    if name == "SUBPATTERN":
        return _all_strings(arg[-1])
    if name == "BRANCH":
        sides = [_all_strings(side) for side in arg[1]]
        return None if None in sides else set().union(*sides)
    if name in ("MAX_REPEAT", "MIN_REPEAT") and arg[1] in (0, 1, 2):
        one = _all_strings(arg[2])
        times = [{""}]
        for _ in range(arg[1]):
            times.append(None if one is None or len(times[-1]) * len(one) > EXACT else {a + b for a in times[-1] for b in one})
            if times[-1] is None:
                return None
        return set().union(*times[arg[0]:])
    if name == "AT":
        return {""}
    return None


def _all_strings(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        some = _written_out(op, arg)
        if some is None or len(out) * len(some) > EXACT:
            return None
        out = {a + b for a in out for b in some}
    return out


def _needed(nodes):
    """Boolean query that holds for every text in which a sequence of regex parts matches."""
    out, run = [], {""}
    for op, arg in nodes:
        some = _written_out(op, arg)
        if some is not None and len(run) * len(some) <= EXACT:
            run = {a + b for a in run for b in some}
            continue
        out.append(_letters(run))
        run = some if some is not None and len(some) <= EXACT else {""}
        name = str(op)
        if some is None and name == "SUBPATTERN":
            out.append(_needed(arg[-1]))
        elif some is None and name == "BRANCH":
            out.append(_join("or", [_needed(side) for side in arg[1]]))
        elif some is None and name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0]:
            out.append(_needed(arg[2]))
    return _join("and", [*out, _letters(run)])


def trigram_query(pattern: str):
    """What trigrams (of the text with A-Z as a-z) any match of a regex needs."""
    return _needed(regex_tree.parse(pattern))


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(trigrams(p) for p in query[1]))


# ---- the index of a stretch of texts

def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


LOWER = _lower()


class Postings:
    """Sorted texts of each wanted trigram, over about 1 MB of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray, wanted: list[bytes]):
        self.n = len(at) - 1
        codes = np.array(sorted(int.from_bytes(w, "big") for w in wanted), np.int64)
        low = LOWER[data]
        self.lists: dict[bytes, np.ndarray] = {}
        if len(low) < 3 or not len(codes):
            return
        pairs = np.zeros(1 << 16, bool)
        pairs[codes >> 8] = True
        two = (low[:-2].astype(np.uint16) << 8) | low[1:-1]
        place = np.flatnonzero(pairs[two])
        code = (two[place].astype(np.int64) << 8) | low[place + 2]
        number = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        ok = codes[number] == code
        place, number = place[ok], number[ok]
        text = np.searchsorted(at, place, "right") - 1
        ok = place + 3 <= at[text + 1]
        pair = np.unique(number[ok] * self.n + text[ok])
        number, text = np.divmod(pair, self.n)
        edges = np.searchsorted(number, np.arange(len(codes) + 1))
        for i, c in enumerate(codes):
            self.lists[int(c).to_bytes(3, "big")] = text[edges[i]:edges[i + 1]]

    def texts(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.lists.get(query, np.zeros(0, np.int64))
        parts = sorted((self.texts(p) for p in query[1]), key=len)
        return reduce(np.intersect1d if query[0] == "and" else np.union1d, parts)


def _finder(rules):
    """Function from a string column to (row, start, end, rule number) of every span, in order."""
    compiled = [(re.compile(r.pattern), r, trigram_query(r.pattern)) for r in rules]
    wanted = sorted(set().union(set(), *(trigrams(q) for _, _, q in compiled)))

    def spans(column):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        data, at = utf8(column)
        out = []
        for lo, hi in chunks(at):
            index = Postings(data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], wanted)
            for number, (pattern, rule, query) in enumerate(compiled):
                for i in index.texts(query):
                    row = lo + int(i)
                    for m in pattern.finditer(column[row].as_py() or ""):
                        if m.end(rule.group) - m.start(rule.group) >= rule.least:
                            out.append((row, m.start(), m.end(), number))
        out.sort(key=lambda s: (s[0], s[1], s[3]))
        return out

    return spans


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()),
                                  T.StructField("end", T.LongType())]))


def find_secrets(df: DataFrame, key: str, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key`` and ``spans`` (kind, start, end in code points; by start, then rule order) of every row.

    Each rule's regex yields a Boolean trigram query.  Every stretch of texts is indexed by the trigrams
    that any rule asks for; posting lists are intersected and united into each rule's candidate texts, and
    only these are searched with the regex.  Rules without mandatory trigrams search all texts.  One scan,
    no shuffle.

    Null and empty texts have no spans.  Repeated rows get a row each.  Spans of different rules may
    overlap; those of one rule do not.
    """
    find, kinds = _finder(rules), [r.kind for r in rules]
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(batches):
        for b in batches:
            found = find(b.column(1))
            edges = np.searchsorted(np.array([s[0] for s in found], np.int64), np.arange(b.num_rows + 1))
            values = pa.StructArray.from_arrays(
                [pa.array([kinds[s[3]] for s in found], pa.string()), pa.array([s[1] for s in found], pa.int64()),
                 pa.array([s[2] for s in found], pa.int64())], fields=list(item))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)], names=["key", "spans"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("spans", SPANS)])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(lean(rows), schema)


def redact(df: DataFrame, text: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every secret in ``text`` replaced by its kind in angle brackets.

    Overlapping spans become one mark, named after the first.  Other columns and null texts stay.
    """
    find, kinds = _finder(rules), [r.kind for r in rules]
    place = df.columns.index(text)

    def rows(batches):
        for b in batches:
            column = b.column(place)
            marks: dict[int, list] = {}
            for row, start, end, number in find(column):
                own = marks.setdefault(row, [])
                if own and start < own[-1][1]:
                    own[-1][1] = max(own[-1][1], end)
                else:
                    own.append([start, end, kinds[number]])
            if marks:
                texts = column.to_pylist()
                for row, own in marks.items():
                    parts, last = [], 0
                    for start, end, kind in own:
                        parts += [texts[row][last:start], f"<{kind}>"]
                        last = end
                    texts[row] = "".join(parts) + texts[row][last:]
                b = b.set_column(place, b.schema.field(place), pa.array(texts, column.type))
            yield b

    return df.mapInArrow(lean(rows), df.schema)


def joined(spans: str, kinds: tuple[str, ...] = ()) -> Column:
    """``kind:start:end``, comma-joined; of certain kinds only, if given."""
    use = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(use, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
