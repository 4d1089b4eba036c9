"""Plain versions of the operators, for the tests."""

import re
from collections import defaultdict


def covered(rows, parts, length):
    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        units = parts(text)
        for s in range(len(units) - length + 1):
            first.setdefault(tuple(units[s : s + length]), i)
    for i, text in rows:
        units = parts(text)
        gone = [False] * len(units)
        for s in range(len(units) - length + 1):
            least = first[tuple(units[s : s + length])]
            if least is not None and (i is None or least < i):
                gone[s : s + length] = [True] * length
        yield i, units, gone


def shingles(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) if len(words) > 4 else frozenset([tuple(words)] if words else [])


def grouped(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, own in enumerate(sets):
        common = defaultdict(int)
        for token in own:
            for j in having[token]:
                common[j] += 1
            having[token].append(k)
        for j, c in common.items():
            if 100 * c >= 80 * (len(own) + len(sets[j]) - c):
                parent[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i, find(k) if sets[k] else ("alone", k)) for k, (i, _) in enumerate(rows)]


def bench_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
