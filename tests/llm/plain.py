"""Plain versions of the operators, to compare with."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(texts, threshold=0.8):
    """{key: (class, links)} and the linked pairs of different sets."""
    sets = {k: shingle_set(t) for k, t in texts.items()}
    lists, up, links, pairs = defaultdict(list), {k: k for k in sets}, Counter(), set()
    for k, s in sets.items():
        for x in s:
            lists[x].append(k)

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, s in sets.items():
        for o, n in Counter(o for x in s for o in lists[x] if o > k).items():
            if n / (len(s) + len(sets[o]) - n) >= threshold:
                links[k] += 1
                links[o] += 1
                if s != sets[o]:
                    pairs.add((k, o))
                a, b = top(k), top(o)
                up[max(a, b)] = min(a, b)
    return {k: (top(k), links[k]) for k in sets}, pairs


def passages(texts, items, window=10, slop=0):
    """{key: (words, hit words, items)} by comparing every window with every place."""
    found = []
    for item, text in items:
        w = words(text)
        found += [(item, w[i:i + window]) for i in range(max(1, len(w) - window + 1) if w else 0)]
    out = {}
    for k, t in texts.items():
        d, hit, own = words(t), set(), set()
        for item, w in found:
            for i in range(len(d) - len(w) + 1):
                if d[i:i + len(w)] == w:
                    hit.update(range(i, i + len(w)))
                    own.add(item)
        out[k] = (len(d), len(hit), sorted(own))
    return out
