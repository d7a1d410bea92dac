"""Words and word hashes of whole texts, computed on the bytes of an Arrow string column.

Words are the maximal runs of bytes outside space, tab, line feed, vertical tab, form feed and carriage return. All
hashes are 64-bit, depend on the words alone and are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# freed batches go back to the system: a worker stays small between tasks
pa.set_memory_pool(pa.system_memory_pool())

U = np.uint64
#: Bytes of text that are hashed together; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 19
#: Bytes whose running sum is held at once; only a single word can exceed it.
SEGMENT_BYTES = 1 << 19

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, 256, dtype=np.int64).view(U) * U(2) + U(1)
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_ARR = np.arange(256)
#: Bytes that are neither ASCII letters or digits nor part of a character beyond ASCII.
EDGE = ~(((_ARR | 32) >= 97) & ((_ARR | 32) <= 122) | (_ARR >= 128) | (_ARR >= 48) & (_ARR <= 57))
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values; one to one."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def coefficients(k: int, seed: int = 0) -> np.ndarray:
    """Odd multipliers of the places of a k-word window."""
    return mix((np.arange(k, dtype=U) + U(1 + 1000 * seed)) * U(_BASE)) | U(1)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, SEGMENT_BYTES + 1)
        up, down = np.full(n, _BASE, U), np.full(n, pow(_BASE, -1, 2**64), U)
        up[0] = down[0] = U(1)
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out, i = np.empty(len(starts), U), 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + SEGMENT_BYTES, side="right")))
        part = data[base : ends[j - 1]]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, U)
        np.cumsum(_BYTES[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
        i = j
    return out


@dataclass
class Words:
    """Words of consecutive documents: ``hashes[first[r]:first[r + 1]]`` belong to row r of the chunk."""

    rows: slice
    hashes: np.ndarray
    first: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def windows(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Rolling hashes of all windows of k words inside one document, and where each starts."""
        n = len(self.hashes) - k + 1
        if n <= 0:
            return np.empty(0, U), np.empty(0, np.int64)
        c, h = coefficients(k, seed), np.zeros(n, U)
        for j in range(k):
            h += self.hashes[j : n + j] * c[j]
        inside = self._inside(k)
        return mix(h)[inside], np.flatnonzero(inside)

    def rolling(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rabin-Karp hashes of all windows of k words inside one document, and where each starts."""
        n = len(self.hashes)
        if n < k:
            return np.empty(0, U), np.empty(0, np.int64)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(self.hashes * up[:n], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * down[: n - k + 1]
        inside = self._inside(k)
        return mix(h)[inside], np.flatnonzero(inside)

    def _inside(self, k: int) -> np.ndarray:
        n = len(self.hashes) - k + 1
        counts = np.diff(self.first)
        left = np.repeat(self.first[1:], counts)[:n] - np.arange(n)
        return left >= k


def texts_of(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, as they lie in the batch; a null is an empty text."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if not wide and not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(batch: pa.RecordBatch, name: str = "text", lower: bool = False, limit: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of a batch in chunks of whole documents; every row is in exactly one chunk."""
    data, off = texts_of(batch, name)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield split(data[off[a] : off[b]], off[a : b + 1] - off[a], slice(a, b), lower)
        a = b


def split(data: np.ndarray, off: np.ndarray, rows: slice, lower: bool = False) -> Words:
    if lower:
        data = _LOWER[data]
    if not len(data):
        none = np.empty(0, np.int64)
        return Words(rows, np.empty(0, U), np.zeros(len(off), np.int64), data, none, none)
    gap = _SPACE[data]
    before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
    before[1:], after[:-1] = gap_and(gap, off), gap_and(gap, off, True)
    starts = np.flatnonzero(~gap & before[:-1])
    ends = np.flatnonzero(~gap & after[1:]) + 1
    return Words(rows, hashes(data, starts, ends), np.searchsorted(starts, off), data, starts, ends)


def gap_and(gap: np.ndarray, off: np.ndarray, following: bool = False) -> np.ndarray:
    """Which bytes end (or begin, if following) a run: gaps and the edges of documents."""
    edge = gap.copy()
    inner = off[(off > 0) & (off < len(gap))]
    edge[inner if following else inner - 1] = True
    return edge


def stripped(c: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the words without leading and trailing bytes that are neither letters nor digits; may be empty."""
    s, e = c.starts.copy(), c.ends.copy()
    for edge, place, step in ((s, 0, 1), (e, -1, -1)):
        todo = np.arange(len(s))
        while len(todo := todo[s[todo] < e[todo]]) and len(todo := todo[EDGE[c.data[edge[todo] + place]]]):
            edge[todo] += step
    return s, e


def rows_of(words: Words, starts: np.ndarray) -> np.ndarray:
    """Row within the chunk of each word number."""
    return np.searchsorted(words.first, starts, side="right") - 1
