"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text, k=5):
    w = words(lower(text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(rows, percent=75):
    """rows: (doc_id, text) -> sorted (doc_id, set size, smallest id reachable)."""
    sets = [(d, shingles(t)) for d, t in rows]
    up = {d: d for d, _ in sets if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                up[b_] = a_
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def dedup(rows, k=35):
    """rows: (doc_id, text) -> sorted (doc_id, words, removed, kept text)."""
    docs = [(d, words(t)) for d, t in rows]
    seen = Counter(tuple(w[i : i + k]) for _, w in docs for i in range(len(w) - k + 1))
    out = []
    for d, w in docs:
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        out.append((d, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=str)


def base_counts(text):
    w = words(text)
    tri, where = defaultdict(list), set()
    for i in range(len(w) - 2):
        tri[tuple(w[i : i + 3])].append(i)
    for at in tri.values():
        if len(at) > 1:
            where |= {j for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(where)
