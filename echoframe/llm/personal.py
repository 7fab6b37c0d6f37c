"""Personal data by a semi-Markov conditional random field over candidate spans."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.secrets import SPANS

# The four patterns that the contract states, in its order.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = tuple(PATTERNS)

#: Tokens of the longest entity that is not itself a match of a pattern.
LONGEST = 6

#: Documents from which training regions are taken, and regions used: what the driver holds.
SAMPLE_DOCUMENTS, SAMPLE_REGIONS = 20_000, 1_500

TOKEN = re.compile(r"\S+")
DIGITS = re.compile(r"[0-9]+")
MARK = re.compile(r"[0-9@]|[(\[](?:at|dot)[)\]]")
EDGE = ".,;:!?\"'"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind: str, match: str) -> bool:
    digits = "".join(DIGITS.findall(match))
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def stated(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches that hold."""
    some = {"email": "@" in text, "phone": "+" in text}
    if not some["email"] and not DIGITS.search(text):
        return []
    return [(m.start(), m.end(), k) for k, (kind, p) in enumerate(PATTERNS.items()) if some.get(kind, True)
            for m in p.finditer(text) if holds(kind, m.group())]


def regions(text: str) -> list[list[tuple[int, int, bool]]]:
    """Runs of tokens (start, end, marked) in which an entity can lie.

    Entities begin and end with a token that has a digit, an at sign or a bracketed word for one; outside
    regions every token is outside of entities whatever the weights, so leaving it out changes nothing.
    """
    if not MARK.search(text):
        return []
    out, last = [], 0
    for m in MARK.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start and not text[start - 1].isspace():
            start -= 1
        end = TOKEN.match(text, m.start()).end()
        last = end
        if out and text.count(" ", out[-1][-1][1], start) + text.count("\n", out[-1][-1][1], start) < LONGEST:
            between = [(t.start(), t.end(), False) for t in TOKEN.finditer(text, out[-1][-1][1], start)]
            if len(between) <= LONGEST - 2:
                out[-1] += [*between, (start, end, True)]
                continue
        out.append([(start, end, True)])
    return out


def candidates(text: str, region, known) -> list[tuple[int, int]]:
    """Spans of up to LONGEST tokens between marked ones, without punctuation at their ends, and known spans.

    A bracketed sign takes the words beside it along.
    """
    spans = set()
    for i, (s, _, marked) in enumerate(region):
        if not marked:
            continue
        if text[s] in "([" and s and text[s - 1].isspace():  # "name (at) host"
            before = text[:s].rstrip()
            s = len(before) - len(before.split()[-1]) if before else s
        for _, e, last in region[i:i + LONGEST]:
            if last:
                after = TOKEN.match(text, e + 1) if text[e - 1] in ")]" and e < len(text) else None
                for end in {e, after.end() if after else e}:
                    a, b = s, end
                    while a < b and text[a] in EDGE:
                        a += 1
                    while b > a and text[b - 1] in EDGE:
                        b -= 1
                    if a < b:
                        spans.add((a, b))
    lo, hi = region[0][0], region[-1][1]
    spans.update((s, e) for s, e, _ in known if s < hi and e > lo)
    return sorted(spans)


def features(text: str, start: int, end: int) -> list[str]:
    """What a whole span looks like."""
    s = text[start:end]
    groups = DIGITS.findall(s)
    n, letters = sum(map(len, groups)), sum(map(str.isalpha, s))
    before = text[max(0, start - 24):start].split()
    shape = re.sub(r"a+", "a", re.sub(r"9+", "9", "".join("9" if c.isdecimal() else "a" if c.isalpha() else " " if c.isspace() else c for c in s)))
    out = ["any", f"digits {'0' if not n else np.searchsorted((4, 7, 10, 14, 16, 17, 20), n, 'right')}", f"groups {min(len(groups), 6)}",
           f"letters {'none' if not letters else 'few' if letters < n else 'most'}", f"tokens {min(len(s.split()), LONGEST)}",
           f"signs {min(s.count('@'), 2)}", f"shape {shape[:24]}", f"first {'9' if s[0].isdecimal() else 'a' if s[0].isalpha() else s[0]}",
           f"last {'9' if s[-1].isdecimal() else 'a' if s[-1].isalpha() else s[-1]}", f"after {before[-1].lower().strip(EDGE) if before else ''}"]
    if re.search(r"[(\[](?:at|dot)[)\]]", s):
        out.append("bracket")
    if re.search(r"(?:\.|[(\[]dot[)\]]\s*)[A-Za-z]{2,}$", s):
        out.append("domain")
    for kind, p in PATTERNS.items():
        if p.fullmatch(s):
            out.append(f"form {kind} {holds(kind, s)}")
    return out


@dataclass
class Field:
    """Weights of (feature, kind); being outside weighs nothing."""

    number: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(KINDS))))

    def lattice(self, text: str, spans):
        """Spans as (from, to) positions of a line that runs through all their ends, and their features."""
        line = sorted({x for s in spans for x in s})
        place = {x: i for i, x in enumerate(line)}
        have = [[self.number[f] for f in features(text, s, e) if f in self.number] for s, e in spans]
        return len(line), [(place[s], place[e]) for s, e in spans], have

    def scores(self, have) -> np.ndarray:
        return np.array([self.weights[f].sum(axis=0) if f else np.full(len(KINDS), -9.0) for f in have])

    def best(self, text: str, spans) -> list[tuple[int, int, int]]:
        """The spans and kinds of the highest total score; spans don't overlap."""
        if not spans or not len(self.weights):
            return []
        n, ends, have = self.lattice(text, spans)
        score = self.scores(have)
        kind, top = score.argmax(axis=1), score.max(axis=1)
        closing: list[list[int]] = [[] for _ in range(n)]
        for i, (_, e) in enumerate(ends):
            closing[e].append(i)
        total, came = [0.0] * n, [-1] * n
        for p in range(1, n):
            total[p] = total[p - 1]
            for i in closing[p]:
                if total[ends[i][0]] + top[i] > total[p]:
                    total[p], came[p] = total[ends[i][0]] + top[i], i
        out, p = [], n - 1
        while p > 0:
            if came[p] < 0:
                p -= 1
            else:
                out.append((*spans[came[p]], int(kind[came[p]])))
                p = ends[came[p]][0]
        return out[::-1]

    def marginals(self, n: int, ends, score: np.ndarray) -> np.ndarray:
        """Probability of each span with each kind (forward and backward sums over all segmentations)."""
        both = np.logaddexp.reduce(score, axis=1)
        ahead, back = np.full(n, -np.inf), np.full(n, -np.inf)
        ahead[0] = back[n - 1] = 0.0
        by_end = sorted(range(len(ends)), key=lambda i: ends[i][1])
        at = 0
        for p in range(1, n):
            ahead[p] = ahead[p - 1]
            while at < len(by_end) and ends[by_end[at]][1] == p:
                i = by_end[at]
                ahead[p] = np.logaddexp(ahead[p], ahead[ends[i][0]] + both[i])
                at += 1
        by_start = sorted(range(len(ends)), key=lambda i: -ends[i][0])
        at = 0
        for p in range(n - 2, -1, -1):
            back[p] = back[p + 1]
            while at < len(by_start) and ends[by_start[at]][0] == p:
                i = by_start[at]
                back[p] = np.logaddexp(back[p], both[i] + back[ends[i][1]])
                at += 1
        s, e = np.array([x[0] for x in ends]), np.array([x[1] for x in ends])
        return np.exp(ahead[s][:, None] + score + back[e][:, None] - ahead[n - 1])


def disguised(text: str, span: tuple[int, int, int], turn: int) -> tuple[str, tuple[int, int, int]] | None:
    """The same text with an e-mail address or a phone number in another common way of writing."""
    start, end, kind = span
    s = text[start:end]
    if KINDS[kind] == "email":
        name, _, host = s.partition("@")
        left, right = "()" if turn % 2 else "[]"
        new = f"{name} {left}at{right} {host}"
    elif KINDS[kind] == "phone":
        d = "".join(DIGITS.findall(s))[-10:]
        new = (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"00{d[:2]} {d[2:5]} {d[5:]}")[turn % 3]
    else:
        return None
    return text[:start] + new + text[end:], (start, start + len(new), kind)


def broken(text: str, span: tuple[int, int, int]) -> str | None:
    """The same text with a card number or an address that is none: a false check digit, a part over 255."""
    start, end, kind = span
    s = text[start:end]
    if KINDS[kind] == "card":
        return text[:start] + s[:-1] + str((int(s[-1]) + 3) % 10) + text[end:]
    if KINDS[kind] == "ip":
        return text[:start] + "999" + s[s.index("."):] + text[end:]
    return None


def train(texts: list[str], passes: int = 12) -> Field:
    """Fit on short texts by gradient steps on the likelihood of the stated spans.

    Each text with one entity is seen once more: in another way of writing where its kind has one, or
    else broken, with nothing to be found.
    """
    cases = []
    for turn, text in enumerate(texts):
        gold = stated(text)
        cases.append((text, gold))
        if len(gold) == 1 and (new := disguised(text, gold[0], turn)):
            cases.append((new[0], [new[1]]))
        if len(gold) == 1 and (none := broken(text, gold[0])):
            cases.append((none, []))
    model, ready, counts = Field(), [], {}
    for text, gold in cases:
        known = stated(text)
        for region in regions(text):
            spans = candidates(text, region, known)
            want = {(s, e): k for s, e, k in gold}
            if spans:
                ready.append((text, spans, want))
                for s, e in spans:
                    for f in features(text, s, e):
                        counts[f] = counts.get(f, 0) + 1
    model.number = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n > 2))}
    model.weights = np.zeros((len(model.number), len(KINDS)))
    squares = np.full_like(model.weights, 1e-6)
    ready = [(*model.lattice(text, spans), spans, want) for text, spans, want in ready]
    for _ in range(passes):
        for n, ends, have, spans, want in ready:
            grad = -model.marginals(n, ends, model.scores(have))
            for i, span in enumerate(spans):
                if span in want:
                    grad[i, want[span]] += 1
            for i, f in enumerate(have):
                squares[f] += grad[i] ** 2
                model.weights[f] += 0.2 * grad[i] / np.sqrt(squares[f])
        model.weights *= 0.995
    return model


def fit(df: DataFrame, key: str, text: str) -> Field:
    """Train on the regions of at most about 20,000 documents, drawn by a hash of their key."""
    n = df.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    drawn = df.where(F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(1 << 20)) < share * (1 << 20))

    def rows(batches):
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                for r in regions(t or ""):
                    out.append(t[max(0, r[0][0] - 40):min(r[-1][1], r[0][0] + 400) + 40])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["region"])

    got = drawn.select(F.col(f"`{text}`").cast("string")).mapInArrow(rows, "region string").distinct()
    got = got.orderBy(F.xxhash64("region"), "region").limit(SAMPLE_REGIONS).collect()
    return train([r[0] for r in got])


def spans_of(text: str, model: Field) -> list[tuple[int, int, int]]:
    """Stated spans and those that the field adds, by start and kind.

    The field chooses among all candidates, stated ones included; a stated span that it leaves out stays
    all the same, and what it adds may not overlap a stated one.
    """
    known = stated(text)
    out = set(known)
    for region in regions(text):
        for s, e, k in model.best(text, candidates(text, region, known)):
            if not any(s < b and a < e for a, b, _ in known):
                out.add((s, e, k))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


def find_personal(df: DataFrame, key: str, text: str, model: Field) -> DataFrame:
    """``key``, ``spans`` (kind, start, end in code points; by start, then kind) and ``stated`` spans of every row.

    Null and empty texts have none.  Repeated rows get a row each.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def rows(batches):
        for b in batches:
            all_spans, known = [], []
            for t in b.column(1).to_pylist():
                t = t or ""
                asked = MARK.search(t) is not None
                all_spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in (spans_of(t, model) if asked else [])])
                known.append([{"kind": KINDS[k], "start": s, "end": e} for s, e, k in (sorted(stated(t), key=lambda x: (x[0], x[2])) if asked else [])])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(all_spans, pa.list_(item)), pa.array(known, pa.list_(item))],
                                             names=["key", "spans", "stated"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("spans", SPANS), T.StructField("stated", SPANS)])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(rows, schema)
