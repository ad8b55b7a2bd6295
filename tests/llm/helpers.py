"""Brute-force restatements that the operators are held against."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    w = WORD.findall(low)
    if len(w) < 5:
        return frozenset({tuple(w)} if w else ())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def near_groups(rows, percent=80):
    """(id, text) rows -> set of (id, shingles, component)."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g] if j < i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(s) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)
