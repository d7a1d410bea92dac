"""Language of a text as a mixture: expectation-maximisation over n-gram likelihoods, the set by penalised likelihood.

Learning counts four-byte letter sequences (lower-cased, anything but letters a space) by language, hashed into
``BUCKETS`` buckets. The model is one row of likelihoods a language; its size is the number of languages times ``BUCKETS``
numbers, whatever the size of the corpus. For each text, expectation-maximisation estimates the share of every language.
Then the languages with the largest shares are tried as the text's set, one, two, three, ...; each more must raise the
likelihood by more than its penalty (sequences overlap, so a text counts as a quarter of its sequences). The prediction is
the largest share of the set that wins, the score is this share.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text where nothing could be
learned; of equal shares the first language name wins; equal rows get equal results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm import words as W
from factweave.llm.storage import small_batches
from factweave.llm.toxicity import held_out

BUCKETS = 1 << 16
ROUNDS, LEAST_SHARE, SMOOTH = 12, 0.01, 0.1
#: Languages whose counts a task holds before it sends them on.
HELD = 32

_ARR = np.arange(256)
_CLEAN = np.where((_ARR >= 128) | ((_ARR | 32) >= 97) & ((_ARR | 32) <= 122), np.where(_ARR < 128, _ARR | 32, _ARR), 32).astype(np.uint8)
_ANY_LETTER = regex.compile(r"\p{L}")


def _grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each four-byte sequence with a letter first or second and inside one document, and the first one of each row."""
    x = _CLEAN[data].astype(np.uint32)
    n = max(len(x) - 3, 0)
    g = x[:n] | x[1 : n + 1] << np.uint32(8) | x[2 : n + 2] << np.uint32(16) | x[3 : n + 3] << np.uint32(24)
    ok = (x[1 : n + 1] != 32) & (x[2 : n + 2] != 32)
    for o in off[(off > 0) & (off < len(x))]:
        ok[max(0, o - 3) : o] = False
    at = np.flatnonzero(ok)
    g = (g[at] * np.uint32(2654435761)) >> np.uint32(16)
    return g.astype(np.int32), np.searchsorted(at, off)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    data, off = W.texts_of(batch, "text")
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + W.CHUNK_BYTES, side="right")) - 1)
        yield slice(a, b), data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


@dataclass
class Model:
    """Languages in the order of their names, and the likelihood of each bucket by language."""

    names: list[str]
    likelihood: np.ndarray


def learn(docs: DataFrame) -> Model:
    """Counts over all rows with a language; the counts are added up by Spark."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("lang", pa.string()), ("g", pa.int32()), ("n", pa.int64())])

    def flush(held: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            g = np.flatnonzero(counts)
            yield pa.record_batch([pa.array([lang] * len(g), pa.string()), g.astype(np.int32), counts[g]], schema=schema)
        held.clear()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for rows, data, off in _parts(batch):
                g, first = _grams(data, off)
                names, which = np.unique(np.array(langs[rows], dtype=object).astype(str), return_inverse=True)
                owner = np.repeat(which, np.diff(first))
                for i, lang in enumerate(names):
                    if lang not in held and len(held) >= HELD:
                        yield from flush(held)
                    held[str(lang)] = held.get(str(lang), 0) + np.bincount(g[owner == i], minlength=BUCKETS)
        yield from flush(held)

    got = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(count, "lang string, g int, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    lang, g, n = np.array(got["lang"].to_pylist(), dtype=object), got["g"].to_numpy(), got["n"].to_numpy()
    names = sorted(set(lang))
    m = np.full((len(names), BUCKETS), SMOOTH)
    for i, name in enumerate(names):
        own = lang == name
        m[i, g[own]] += n[own]
    return Model(names, (m / m.sum(1, keepdims=True)).astype(np.float32) if names else m.astype(np.float32))


def _shares(m: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """Mixture shares of the rows of m by expectation-maximisation, and the log likelihood."""
    share, total = np.full(len(m), 1 / len(m)), counts.sum()
    for _ in range(rounds):
        mixed = share @ m
        share = share * (m @ (counts / mixed)) / total
    return share, float(counts @ np.log(np.maximum(share @ m, 1e-300)))


def mixture(m: np.ndarray, grams: np.ndarray) -> list[tuple[int, float]]:
    """Languages of a text (numbers of rows) with their shares, the largest first; grams: its buckets."""
    seen, counts = np.unique(grams, return_counts=True)
    m, counts = m[:, seen].astype(np.float64), counts.astype(np.float64)
    share, _ = _shares(m, counts, ROUNDS)
    order = np.argsort(-share, kind="stable")
    # half the log of a text's size for each free share, its sequences counted as a quarter
    penalty = 2 * np.log(max(len(grams) / 4, 2))
    best, chosen = float(counts @ np.log(m[order[0]])), [(int(order[0]), 1.0)]
    for k in range(2, 1 + int((share >= LEAST_SHARE).sum())):
        part, fit = _shares(m[order[:k]], counts, ROUNDS)
        if fit - (k - 1) * penalty <= best:
            break
        best = fit - (k - 1) * penalty
        by = np.argsort(-part, kind="stable")
        chosen = [(int(order[i]), float(part[i])) for i in by]
    return chosen if len(chosen) > 1 else [(chosen[0][0], float(share[order[0]]))]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, languages): the languages of the chosen set with their shares."""
    names, m = model.names, model.likelihood
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, off in _parts(batch):
                g, first = _grams(data, off)
                ascii_letters = np.append(0, np.cumsum((_CLEAN[data] != 32) & (data < 128)))
                out = []
                for r in range(len(off) - 1):
                    letters = ascii_letters[off[r + 1]] > ascii_letters[off[r]] or _ANY_LETTER.search(data[off[r] : off[r + 1]].tobytes().decode())
                    if not letters or not names:
                        out.append(("und", 0.0, []))
                        continue
                    own = g[first[r] : first[r + 1]]
                    found = mixture(m, own) if len(own) else [(0, 1 / len(names))]
                    out.append((names[found[0][0]], min(found[0][1], 1.0), [{"lang": names[i], "share": s} for i, s in found]))
                yield pa.record_batch([batch.column(0).slice(rows.start, len(out)).cast(pa.int64()), *[pa.array([o[i] for o in out], schema.field(i + 1).type) for i in range(3)]], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def language_id(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages; learned from rows that are not held out."""
    out = identify(docs, learn(docs.where(~held_out(4, 2))))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "languages")
