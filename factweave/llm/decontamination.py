"""Benchmark decontamination by templates: numbers, names and units become typed slots, windows of the rest are joined.

Each word loses its outer punctuation and is lower-cased (A-Z, À-Þ); numbers (digits or number words), names (capitalised
inside a sentence) and units become one token a type. Windows of eight such tokens with at least four plain words
are hashed; those of documents meet those of the benchmark in an equi-join, after a bitmap of fixed size has dropped the
windows that no item has. Matches of one document, one item and one shift are a copy of (a part of) the item. In it each
filler of the item has a usual filler of the document. Where at most one slot, or a third of the slots, have another one,
all windows count; else those whose slots all have the usual or the item's own filler, and those without slots. Different
fillers may become equal ones. Names are told a second time by the item's names in either case (a bitmap of fixed size), so a
copy in other case is found too. Beside the templates all windows are hashed word by word, whatever they
hold: such exact windows always count, also where numbers and names leave no four plain words. So a question with other numbers or names is found, and a text in which repeated
fillers of the item became many different ones is not.

A document is contaminated by an item if such windows hold at least ``WINDOWS`` different windows of it (that is
thirteen words), or half of the windows of a shorter item (of all, or of those with four plain words).

Defined results: a null or empty text, and one without a window, is clean; an item with four to seven words is one
window of all its words, one with fewer words than four is never found; equal rows get equal results; an empty benchmark leaves all clean; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import words as W
from factweave.llm.storage import bitmap, in_bitmap, save, small_batches

WINDOW = 8
#: Plain words that a window needs.
PLAIN = 4
#: Different windows of an item that make a document contaminated.
WINDOWS = 6

NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion", "half", "dozen"]
UNIT_WORDS = ["mm", "cm", "m", "km", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degrees", "mph", "kmh"]

_ARR = np.arange(256)
_DIGIT = (_ARR >= 48) & (_ARR <= 57)
_NUMERIC = _DIGIT | np.isin(_ARR, list(b".,-+$%/:"))
_STOP = np.isin(_ARR, list(b".!?:"))
_UPPER = (_ARR >= 65) & (_ARR <= 90)
_LOWER = np.where(_UPPER, _ARR + 32, _ARR).astype(np.uint8)
#: À to Þ without the sign of multiplication: the second of two bytes, after C3.
_WIDE_UPPER = (_ARR >= 0x80) & (_ARR <= 0x9E) & (_ARR != 0x97)


def _hash_of(terms: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(terms).encode(), np.uint8)
    return np.sort(W.split(data, np.array([0, len(data)]), slice(0, 1)).hashes)


_NUMBERS, _UNITS = _hash_of(NUMBER_WORDS), _hash_of(UNIT_WORDS)
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (1, 2, 3))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


def _lowered(data: np.ndarray) -> np.ndarray:
    low = _LOWER[data]
    wide = np.flatnonzero((data[:-1] == 0xC3) & _WIDE_UPPER[data[1:]]) + 1
    low[wide] += 32
    return low


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(42)).astype(np.int64)


def _templates(c: W.Words, names: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per kept word: token (a slot type or a word hash), the same with names told by a bitmap, own hash, and row in the chunk."""
    data = c.data
    stop = _STOP[data[c.ends - 1]]
    s, e = W.stripped(c)
    row = W.rows_of(c, np.arange(len(s)))
    begins = np.ones(len(s), bool)  # a sentence begins after a stop, at a line's start and at a document's
    if len(s):
        lines = np.append(0, np.cumsum(data == 10))
        begins[1:] = stop[:-1] | (row[1:] != row[:-1]) | (lines[c.starts[1:]] != lines[c.ends[:-1]])
    keep = s < e
    s, e, row, begins = s[keep], e[keep], row[keep], begins[keep]
    if not len(s):
        none = np.empty(0, np.uint64)
        return none, none, none, row
    own = W.hashes(_lowered(data), s, e)
    digits, other = np.append(0, np.cumsum(_DIGIT[data])), np.append(0, np.cumsum(~_NUMERIC[data]))
    number = (digits[e] > digits[s]) & (other[e] == other[s]) | _among(own, _NUMBERS)
    head = data[s]
    capital = _UPPER[head] | (head == 0xC3) & (data[np.minimum(s + 1, len(data) - 1)] <= 0x9E)
    told = lambda name: np.where(number, _NUM, np.where(_among(own, _UNITS), _UNIT, np.where(name, _NAME, own)))
    token = told(capital & ~begins)
    return token, token if names is None else told(in_bitmap(names, _slot(own))), own, row


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slots in a bitmap of the words that are names by their case."""
    for batch in batches:
        for c in W.chunks(batch):
            token, _, own, _ = _templates(c, None)
            yield pa.record_batch([_slot(np.unique(own[token == _NAME]))], names=["s"])


def _windows(c: W.Words, lengths: list[int], whole: bool, names: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """By length: window hashes with row, place in the row, and the fillers of the slots (0 where a word is plain); no fillers for exact windows.

    whole: lengths under ``WINDOW`` are for rows with just so many words.
    """
    token, by_name, own, row = _templates(c, names)
    first = np.searchsorted(row, np.arange(len(c.first)))
    words = np.diff(first)
    differ = np.append(0, np.cumsum(token != by_name))
    for k in lengths:
        n = len(token) - k + 1
        if n <= 0:
            continue
        inside = row[:n] == row[k - 1 :]
        if whole and k < WINDOW:
            inside &= words[row[:n]] == k
        for t, ok in ((token, inside), (by_name, inside & (differ[k:] > differ[:-k]))):
            h, plain = np.full(n, k, np.uint64), np.zeros(n, np.int8)
            for j, x in enumerate(W.coefficients(k, 7)):
                h += t[j : n + j] * x
                plain += t[j : n + j] > _UNIT
            at = np.flatnonzero(ok & (plain >= PLAIN))
            slots = np.where(t <= _UNIT, own, np.uint64(0)).view(np.int64)
            yield k, W.mix(h[at]), row[at], at - first[row[at]], slots[at[:, None] + np.arange(k)]
        h = np.full(n, k, np.uint64)
        for j, x in enumerate(W.coefficients(k, 8)):
            h += own[j : n + j] * x
        at = np.flatnonzero(inside)
        yield k, W.mix(h[at]), row[at], at - first[row[at]], None


_SCHEMA = pa.schema([("w", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("place", pa.int32()), ("k", pa.int32()), ("fill", pa.list_(pa.int64()))])
_TYPES = "w long, x long, y long, place int, k int, fill array<long>"


def _found(bits: np.ndarray | None, lengths: list[int], names: np.ndarray):
    """Batches of (x, y, text) -> windows; bits: those whose hash falls into no set slot are dropped, equal exact ones of a row become one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in W.chunks(batch):
                for k, h, row, place, fill in _windows(c, lengths, bits is None, names):
                    if bits is not None:
                        ok = np.flatnonzero(in_bitmap(bits, _slot(h)))
                        if fill is None:
                            order = ok[np.lexsort((h[ok], row[ok]))]
                            ok = order[_firsts(h[order], row[order])]
                        h, row, place, fill = h[ok], row[ok], place[ok], None if fill is None else fill[ok]
                    if len(h):
                        lists = pa.nulls(len(h), pa.list_(pa.int64())) if fill is None else pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * k), pa.array(np.ascontiguousarray(fill).reshape(-1)))
                        yield pa.record_batch([h.view(np.int64), x[c.rows][row], y[c.rows][row], place.astype(np.int32), pa.array(np.full(len(h), k, np.int32)), lists], schema=_SCHEMA)
    return run


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def _bits(windows: DataFrame) -> np.ndarray:
    return bitmap(windows.select(F.shiftrightunsigned("w", 42).alias("s")), "s", slots=True)


def _counted(windows: list[dict]) -> list[int]:
    """Places of the item's windows that count in one copy; windows: dicts of at and slots (dicts of p, asked, fill)."""
    slots = sorted({(x["p"], x["asked"], x["fill"]) for w in windows for x in w["slots"]})
    times = Counter((asked, fill) for _, asked, fill in slots)
    usual: dict[int, int] = {}
    for _, asked, fill in slots:
        rank = lambda f: (times[asked, f], f == asked)
        if asked not in usual or rank(fill) > rank(usual[asked]):
            usual[asked] = fill
    if sum(usual[asked] != fill for _, asked, fill in slots) <= max(1, len(slots) // 3):
        return sorted({w["at"] for w in windows})
    return sorted({w["at"] for w in windows if all(x["fill"] in (x["asked"], usual[x["asked"]]) for x in w["slots"])})


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns[:4], pa.array([_counted(w) for w in batch.column(4).to_pylist()], pa.list_(pa.int32()))], names=["d", "h", "item_id", "shift", "at"])


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(d, h, item_id, windows): per document key and contaminating item, the number of the item's windows found."""
    small_batches(docs.sparkSession)
    asked = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long").alias("x"), F.lit(0).cast("long").alias("y"), "text")
    names = bitmap(asked.select("text").mapInArrow(_names, "s long"), "s", slots=True)
    items = asked.mapInArrow(_found(None, [*range(PLAIN, WINDOW + 1)], names), _TYPES)
    items = save(items.select("w", F.col("x").alias("item_id"), F.col("place").alias("at"), "k", F.col("fill").alias("asked")), "items")
    keyed = docs.select(*doc_key(), "text")
    lengths = sorted(r[0] for r in items.select("k").distinct().collect())  # PLAIN to WINDOW
    here = keyed.select("d", "h", "text").mapInArrow(_found(_bits(items), lengths, names), _TYPES)
    met = here.join(items, "w").select(F.col("x").alias("d"), F.col("y").alias("h"), "item_id", "at", F.when(F.col("asked").isNotNull(), F.col("place") - F.col("at")).alias("shift"), "fill", "asked")
    slot = F.filter(F.transform("asked", lambda a, i: F.struct((F.col("at") + i).alias("p"), a.alias("asked"), F.get("fill", i).alias("fill"))), lambda x: x["asked"] != 0)
    # a copy has no more windows than its item
    copies = met.groupBy("d", "h", "item_id", "shift").agg(F.collect_set(F.struct("at", F.coalesce(slot, F.array()).alias("slots"))).alias("copy"))
    steady = copies.mapInArrow(_judged, "d long, h long, item_id long, shift int, at array<int>")
    template = lambda c, what: F.when(F.col(c).isNotNull(), F.col(what))
    size = items.groupBy("item_id").agg(F.countDistinct("at").alias("size"), F.countDistinct(template("asked", "at")).alias("plain_size"))
    number = lambda lists: F.size(F.array_distinct(F.flatten(F.collect_list(lists))))
    whole = steady.groupBy("d", "h", "item_id").agg(number("at").alias("windows"), number(template("shift", "at")).alias("plain")).join(size, "item_id")
    enough = (F.col("windows") >= WINDOWS) | (2 * F.col("windows") >= F.col("size")) | (F.col("plain") > 0) & (2 * F.col("plain") >= F.col("plain_size"))
    return whole.where(enough & (F.col("windows") > 0)).select("d", "h", "item_id", "windows")


def doc_key() -> list:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("h")]


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, contaminated, kept, items (contaminating item ids, sorted), windows (most of one item)."""
    hits = matches(docs, benchmark).groupBy("d", "h").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.max("windows").cast("long").alias("windows"))
    out = docs.select("doc_id", *doc_key()).join(hits, ["d", "h"], "left")
    found = F.col("items").isNotNull()
    return out.select("doc_id", found.alias("contaminated"), (~found).alias("kept"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("windows", F.lit(0).cast("long")).alias("windows"))


def clean_only(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns, without those that the benchmark contaminates."""
    keys = [k.alias(n) for k, n in zip(doc_key(), ("_key_d", "_key_h"), strict=True)]
    hits = matches(docs, benchmark).select(F.col("d").alias("_key_d"), F.col("h").alias("_key_h")).distinct()
    return docs.select("*", *keys).join(hits, ["_key_d", "_key_h"], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
