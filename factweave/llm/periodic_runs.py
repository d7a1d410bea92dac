"""Periodic runs of words: maximal stretches that repeat one period, found in an enhanced suffix array of each document.

The method. Suffixes of the words are sorted by doubling; the ranks of each doubling tell how far two suffixes agree. A
run of period q ends in one branching square: suffixes i and i + q that agree for exactly q words, so they lie in different
children of the LCP interval of depth q. Each interval looks at the suffixes of all its children but the largest: i is
half of such a square if suffix i + q or i - q, found by the inverse suffix array, is in the interval and in another child.
A place changes to a child at most half as large each time, so the tests are n log n. Squares are rotated to the left as
far as words agree; squares of one stretch merge into a run of the smallest period. Intervals are pairs of array borders.

Only documents in which a window of words repeats that any run asked for must repeat are sorted at all; that is
no limit, as a run of length L >= max(min_length, periods * q) holds a window of L - q words twice.

Defined results: words are the runs of bytes outside space, tab, line feed, vertical tab, form feed and carriage return,
compared as 64-bit hashes; null and empty texts have no word and no run; rows are independent, so repeated rows and ids
give repeated results and a null doc_id stays null; other columns are not read; an empty table gives an empty table. A text
is handled whole by one task; beside it the task holds four bytes a word for each doubling, about two for the longest
repeated stretch of a natural text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factweave.llm import words as W
from factweave.llm.storage import small_batches

MIN_LENGTH, MIN_PERIODS = 24, 3
#: Suffixes that are tested at once.
TESTED_AT_ONCE = 1 << 18


def _ranks(row: np.ndarray, h: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks of the windows of 1, 2, 4 ... words from each place to the end of its row, until no two are alike."""
    n = len(h)
    order = np.lexsort((h, row))
    new = np.append(True, (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1]))
    first = np.empty(n, np.int32)
    first[order] = np.cumsum(new) - 1
    levels, width, place = [first], 1, np.arange(n)
    while n and levels[-1].max() + 1 < n:
        r, then = levels[-1].astype(np.int64), np.minimum(place + width, n - 1)
        key = r * (n + 1) + np.where(place + width < end, r[then] + 1, 0)
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return levels


def _agree(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """For how many words the suffixes at i < stop and j < stop agree; stop is where their row ends."""
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i + got, j + got
        ok = (a < stop) & (b < stop)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        got += ok.astype(np.int64) << k
    return got


def _agree_before(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For how many words before i < j the row agrees with the words before j; begin is where it starts."""
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i - got - (1 << k), j - got - (1 << k)
        ok = a >= begin
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        got += ok.astype(np.int64) << k
    return got


def _borders(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each border between neighbours of the suffix array the nearest borders with a smaller LCP, before and after."""
    depth = lcp.tolist()
    left, right, open_ = [0] * len(depth), [len(depth)] * len(depth), []
    for t, v in enumerate(depth):
        while open_ and depth[open_[-1]] > v:
            right[open_.pop()] = t
        if open_:
            left[t] = left[open_[-1]] if depth[open_[-1]] == v else open_[-1]
        open_.append(t)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, q) where the words at i and i + q agree for exactly q words. lcp[t] is that of sa[t - 1] and sa[t]."""
    left, right = _borders(lcp)
    t = np.flatnonzero(lcp > 0)
    t = t[np.lexsort((t, right[t], left[t]))]
    if not len(t):
        return t, t
    new = np.append(True, (left[t][1:] != left[t][:-1]) | (right[t][1:] != right[t][:-1]))
    group, head = np.cumsum(new) - 1, np.flatnonzero(new)
    # children of an interval: from its left end or a border to the next border or its right end
    begin, owner = np.insert(t, head, left[t[head]]), np.insert(group, head, np.arange(len(head)))
    last = np.append(owner[1:] != owner[:-1], True)
    end = np.where(last, right[t[head]][owner], np.append(begin[1:], 0))
    low, high, depth = left[t[head]], right[t[head]], lcp[t[head]]
    by_size = np.lexsort((end - begin, owner))
    small = np.sort(by_size[np.append(owner[by_size][1:] == owner[by_size][:-1], False)])  # the last of each owner is its largest
    size = end[small] - begin[small]
    total = np.cumsum(size)
    found: list[np.ndarray] = []
    for a in range(0, int(total[-1]), TESTED_AT_ONCE):
        flat = np.arange(a, min(a + TESTED_AT_ONCE, int(total[-1])))
        k = np.searchsorted(total, flat, side="right")
        child = small[k]
        i, g = sa[begin[child] + flat - (total[k] - size[k])], owner[child]
        for step, start in ((depth[g], i), (-depth[g], i - depth[g])):
            j = i + step
            ok = (j >= 0) & (j < len(sa))
            p = isa[np.where(ok, j, 0)]
            ok &= (p >= low[g]) & (p < high[g]) & ((p < begin[child]) | (p >= end[child]))
            found.append(np.stack([start[ok], depth[g][ok]], 1))
    both = np.unique(np.concatenate(found), axis=0)
    return both[:, 0], both[:, 1]


def runs_of(row: np.ndarray, h: np.ndarray, min_length: int, periods: int) -> np.ndarray:
    """(row, start, stop, period) of the runs in the words h; row is not falling and words count through all rows."""
    if not len(h):
        return np.empty((0, 4), np.int64)
    begin = np.searchsorted(row, row)
    end = np.searchsorted(row, row, side="right")
    levels = _ranks(row, h, end)
    isa = levels[-1].astype(np.int64)
    sa = np.empty(len(h), np.int64)
    sa[isa] = np.arange(len(h))
    lcp = np.zeros(len(h), np.int64)
    lcp[1:] = _agree(levels, sa[:-1], sa[1:], end[sa[1:]])  # 0 between rows, as no rank stands in two of them
    i, q = branching_squares(sa, isa, lcp)
    if not len(i):
        return np.empty((0, 4), np.int64)
    start, stop = i - _agree_before(levels, i, i + q, begin[i]), i + 2 * q
    long = stop - start >= np.maximum(min_length, periods * q)
    start, stop, q = start[long], stop[long], q[long]
    order = np.lexsort((q, stop, start))
    start, stop, q = start[order], stop[order], q[order]
    one = np.append(True, (start[1:] != start[:-1]) | (stop[1:] != stop[:-1]))[: len(start)]  # multiples of a period have its stretch
    return np.stack([row[start[one]], start[one], stop[one], q[one]], 1)


def _spread(c: W.Words, min_length: int, periods: int) -> dict[int, list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each row of a chunk that has any, by start, then period."""
    s, at = c.windows(min_length - min_length // periods)
    row = W.rows_of(c, at)
    order = np.lexsort((s, row))
    again = (s[order][1:] == s[order][:-1]) & (row[order][1:] == row[order][:-1])
    wanted = np.unique(row[order][1:][again])
    counts = np.diff(c.first)
    words = np.repeat(np.isin(np.arange(len(counts)), wanted), counts)
    place = np.flatnonzero(words)
    found: dict[int, list[tuple[int, int, int]]] = {}
    rows = np.repeat(np.arange(len(counts)), counts)[words]
    for r, a, b, q in runs_of(rows, c.hashes[words], min_length, periods).tolist():
        found.setdefault(r, []).append((int(place[a] - c.first[r]), b - a, q))
    return {r: sorted(x, key=lambda y: (y[0], y[2])) for r, x in found.items()}


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period."""
    best = runs[0]
    for x in runs[1:]:
        if x[1] * best[2] > best[1] * x[2]:
            best = x
    return best


def _finder(min_length: int, periods: int):
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("greatest", run), ("collapsed_text", pa.large_string())])
    named = lambda x: dict(zip(("start", "length", "period"), x, strict=True))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch):
                found, runs, greatest, texts = _spread(c, min_length, periods), [], [], []
                for r in range(len(c.first) - 1):
                    own = found.get(r, [])
                    a, b = c.first[r], c.first[r + 1]
                    kept = c.data[c.starts[a] : c.ends[b - 1]].tobytes().split() if b > a else []
                    gone = 0  # drop from behind, so that earlier numbers hold; the union of all runs without their first periods
                    for s, e in _merged([(x[0] + x[2], x[0] + x[1]) for x in own])[::-1]:
                        del kept[s:e]
                        gone += e - s
                    texts.append(b" ".join(kept).decode("utf-8", "replace"))
                    runs.append([named(x) for x in own])
                    greatest.append(named(_greatest(own)) if own else None)
                ids = batch.column(0).slice(c.rows.start, len(runs)).cast(pa.int64())
                yield pa.record_batch([ids, pa.array(np.diff(c.first), pa.int64()), pa.array(runs, pa.list_(run)), pa.array(greatest, run), pa.array(texts, pa.large_string())], schema=schema)
    return find


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, periods: int = MIN_PERIODS) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period), greatest (of the runs, by
    length / period, or null), collapsed_text (the words outside runs and in the first period of each, joined by one space).

    A run is a maximal stretch of smallest period q with max(min_length, periods * q) words or more; periods is 2 at least.
    """
    if periods < 2 or min_length < 2:
        raise ValueError("a run has two words and two periods at least")
    small_batches(docs.sparkSession)
    run = "struct<start: long, length: long, period: long>"
    return docs.select("doc_id", "text").mapInArrow(_finder(min_length, periods), f"doc_id long, n_words long, runs array<{run}>, greatest {run}, collapsed_text string")
