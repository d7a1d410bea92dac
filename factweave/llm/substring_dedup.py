"""Removal of word passages that occur more than once (Rabin-Karp hashes of every window, counted in Spark).

Every window of ``window`` consecutive words gets a rolling hash. Consecutive windows that share their anchor (the
smallest hash among the window's short word groups) travel as one row, so equal windows meet in one place although only
eight bytes a window are shuffled: a window is identified by the 64 bits of its anchor and the 64 bits of its own hash.
An anchor inside a frequent short passage has many different windows; such anchors are dealt out by ``PARTS`` values
of the window's hash, on which equal windows agree. Windows that repeat inside one chunk of documents are found before the shuffle and sent on once a chunk, so a passage
that stands in a third of all documents costs one row a chunk.

Defined results: a null text has no words; a text with fewer words than a window loses nothing; equal rows count as
separate documents; rows with a null doc_id take part like any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import words as W
from factweave.llm.storage import small_batches

#: Words in the groups whose smallest hash is the anchor of a window.
ANCHOR = 8
WINDOW = 35
#: Anchors that are dealt out, those with most windows: a bound on what is broadcast (512 KB), not on what is compared.
HOT = 1 << 16
#: Runs in a chunk of documents from which an anchor may be hot, and runs in all from which it is.
HOT_IN_CHUNK, HOT_IN_ALL = 4, 2000
#: A power of two.
PARTS = 256

_RUN = pa.schema([("anchor", pa.int64()), ("d", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("prints", pa.binary())])
_SPAN = pa.schema([("d", pa.int64()), ("h", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


def _identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row's key (d, h): equal rows share it, and lose the same words."""
    nowhere = F.lit(-(2**63))
    return docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), nowhere).alias("d"), F.xxhash64("text").alias("h"))


def _smallest(g: np.ndarray, span: int) -> np.ndarray:
    """Minimum of each ``span`` consecutive values."""
    width, low = 1, g
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def _breaks(*columns: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where a run begins: some column changes, or ``step`` doesn't go on by one."""
    new = np.ones(len(step), bool)
    new[1:] = np.diff(step) != 1
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _anchors(c: W.Words, at: np.ndarray, window: int) -> np.ndarray:
    """Anchors of the windows that start at the words ``at``."""
    groups = np.zeros(len(c.hashes) - ANCHOR + 1, np.uint64)
    for j, x in enumerate(W.coefficients(ANCHOR)):
        groups += c.hashes[j : len(groups) + j] * x
    return _smallest(W.mix(groups), window - ANCHOR + 1)[at]


def hot_anchors(docs: DataFrame, window: int = WINDOW) -> np.ndarray:
    """Sorted anchors of most runs of different windows: those found ``HOT_IN_CHUNK`` times in some chunk of documents."""
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch):
                hashes, at = c.rolling(window)
                if len(at):
                    lead = np.sort(np.unique(hashes, return_index=True)[1])
                    at = at[lead]
                    anchors = _anchors(c, at, window)
                    a, n = np.unique(anchors[_breaks(anchors, W.rows_of(c, at), step=at)], return_counts=True)
                    often = n >= HOT_IN_CHUNK
                    yield pa.record_batch([a[often].view(np.int64), n[often]], schema=schema)

    found = docs.select("text").mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    most = found.where(F.col("n") >= HOT_IN_ALL).orderBy(F.desc("n"), "anchor").limit(HOT).toArrow()  # HOT rows at most
    return np.sort(most["anchor"].to_numpy().view(np.uint64))


def _dealt(anchors: np.ndarray, prints: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The anchors, and of hot ones another value for each part of their windows."""
    if not len(hot):
        return anchors
    among = hot[np.minimum(np.searchsorted(hot, anchors), len(hot) - 1)] == anchors
    return np.where(among, W.mix(anchors + prints % np.uint64(PARTS) + np.uint64(1)), anchors)


def _runs(window: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, h = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("d", "h"))
            for c in W.chunks(batch):
                hashes, at = c.rolling(window)
                if not len(at):
                    continue
                rows = W.rows_of(c, at)
                place = at - c.first[rows]
                _, first, which, count = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
                again = count[which] > 1
                yield from _local(again, at, rows, place, d[c.rows], h[c.rows], window)
                lead = np.zeros(len(at), bool)
                lead[first] = True
                at, rows, place, prints = at[lead], rows[lead], place[lead], hashes[lead]
                anchors = _dealt(_anchors(c, at, window), prints, hot)
                new = np.flatnonzero(_breaks(anchors, rows, step=at))
                ends = np.append(new[1:], len(at))
                offsets = np.append(new, len(at)).astype(np.int32) * 8
                blob = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(prints)])
                r = rows[new]
                yield pa.record_batch([anchors[new].view(np.int64), d[c.rows][r], h[c.rows][r], place[new].astype(np.int32), (place[ends - 1] + 1).astype(np.int32), blob], schema=_RUN)
    return run


def _local(again, at, rows, place, d, h, window: int) -> Iterator[pa.RecordBatch]:
    """Spans of windows that repeat inside the chunk: settled already, they pass the shuffle without prints."""
    if not again.any():
        return
    at, rows, place = at[again], rows[again], place[again]
    new = np.flatnonzero(_breaks(rows, step=at))
    last, r = np.append(new[1:], len(at)) - 1, rows[new]
    yield pa.record_batch([W.mix(h[r].view(np.uint64) + place[new].astype(np.uint64)).view(np.int64), d[r], h[r], place[new].astype(np.int32), (place[last] + window).astype(np.int32), pa.nulls(len(new), pa.binary())], schema=_RUN)


def _alike(under: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each (under, print) stands first, and which of all stand twice or more."""
    order = np.lexsort((prints, under))
    new = np.append(True, (np.diff(under[order]) != 0) | (prints[order][1:] != prints[order][:-1]))
    twice = np.empty(len(order), bool)
    twice[order] = ~(new & np.append(new[1:], True))
    return order[new], twice


class _Seen:
    """One window of each print under the anchor that the last batch ended with, for the rows still to come."""

    def __init__(self) -> None:
        self.anchor, self.prints, self.told = None, np.empty(0, np.uint64), np.empty(0, bool)
        self.d, self.h, self.place = (np.empty(0, np.int64) for _ in range(3))


def _repeated(window: int):
    """Rows sorted by anchor -> spans of windows whose print occurs twice or more under its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Seen()
        for batch in batches:
            if not batch.num_rows:
                continue
            blob = batch.column(5)
            settled = np.asarray(blob.is_null())
            if settled.any():
                yield pa.record_batch([c.filter(pa.array(settled)) for c in batch.columns[1:5]], schema=_SPAN)
            if settled.all():
                continue
            anchor, d, h, start, stop = (c.to_numpy(zero_copy_only=False)[~settled] for c in batch.columns[:5])
            prints = np.frombuffer(b"".join(blob.drop_null().to_pylist()), np.uint64)
            size = stop - start
            row = np.repeat(np.arange(len(start)), size)
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + start[row]
            carry = len(kept.prints) if kept.anchor == anchor[0] else 0
            if not carry:
                kept = _Seen()
            rank = np.cumsum(np.append(False, anchor[1:] != anchor[:-1]))
            prints = np.append(kept.prints, prints)
            under = np.append(np.zeros(carry, np.int64), rank[row])
            dd, hh, at = np.append(kept.d, d[row]), np.append(kept.h, h[row]), np.append(kept.place, place)
            told = np.append(kept.told, np.zeros(len(row), bool))
            first, twice = _alike(under, prints)
            tell = np.flatnonzero(twice & ~told)
            if len(tell):
                new = np.flatnonzero(_breaks(dd[tell], hh[tell], step=at[tell]))
                last = np.append(new[1:], len(tell)) - 1
                yield pa.record_batch([dd[tell[new]], hh[tell[new]], at[tell[new]].astype(np.int32), (at[tell[last]] + window).astype(np.int32)], schema=_SPAN)
            told |= twice
            hold = first[under[first] == rank[-1]]
            kept.anchor, kept.prints, kept.told, kept.d, kept.h, kept.place = anchor[-1], prints[hold], told[hold], dd[hold], hh[hold], at[hold]
    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, h, start, stop): word spans covered by windows that occur more than once; spans may overlap."""
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    small_batches(docs.sparkSession)
    runs = _identified(docs).select("d", "h", "text").mapInArrow(_runs(window, hot_anchors(docs, window)), "anchor long, d long, h long, start int, stop int, prints binary")
    return runs.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeated(window), "d long, h long, start int, stop int")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.list_(pa.int32()))), ("kept_text", pa.large_string())])
    for batch in batches:
        at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        spans, total, gone, cuts, kept = at["spans"].to_pylist(), [], [], [], []
        for i, text in enumerate(at["text"]):
            found = (text.as_py() or "").encode().split()
            total.append(len(found))
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans[i] or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            for a, b in reversed(merged):
                del found[a:b]
            gone.append(total[-1] - len(found))
            cuts.append(merged)
            kept.append(b" ".join(found).decode())
        yield pa.record_batch([at["doc_id"].cast(pa.int64()), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, schema.field("removed").type), pa.array(kept, pa.large_string())], schema=schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (maximal spans of word numbers), kept_text."""
    spans = repeated_spans(docs, window).groupBy("d", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    whole = _identified(docs).join(spans, ["d", "h"], "left").select("doc_id", "text", "spans")
    return whole.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, removed array<array<int>>, kept_text string")
