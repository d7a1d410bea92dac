"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all other text is unlabelled (it holds toxic text too). A linear classifier
minimises ``prior * P(loss +) + max(0, U(loss -) - prior * P(loss -))``: the share of positives among the unlabelled is
taken off their risk as negatives, and the corrected part may not fall below zero, which keeps a flexible model
from learning its positives by heart. Several such classifiers with different draws of batches are averaged in weight.

Features are words and word beginnings of 4, 5 and 6 bytes, lower-cased and without outer punctuation, hashed into
``BUCKETS`` buckets, present or not. Which features are telling, and how far the prior is corrected, follows from their shares
among at most ``POSITIVES`` toxic documents and among all documents that aren't held out, counted in one pass. Only the
gradient steps take their unlabelled rows from a sample, ``UNLABELLED`` documents chosen by the hash of their id. The class prior
is the share of toxic rows among all usable labels, or less where the most telling features are rarer among the
unlabelled than that share allows. All documents are scored.

Defined results: a null or empty text has no features and gets the score of the bias; several labels of one document
count as toxic if one is; labels without id or value are ignored; without toxic labels every score is the prior; equal
rows get equal scores; a row with a null doc_id is scored and never held out; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import words as W
from factweave.llm.storage import save, small_batches

BUCKETS = 1 << 18
BEGINNINGS = (4, 5, 6)
#: Bounds of the sample that the classifiers are fitted on, and of the features that they weigh.
POSITIVES, UNLABELLED, FEATURES = 20_000, 40_000, 8192
#: Least signed root of the likelihood ratio by which a feature's share among positives exceeds that among all; below, it is chance.
LEAST_Z = 3.0
CLASSIFIERS, STEPS, BATCH = 3, 800, 1024
#: Bytes of text whose features are held at once.
CHUNK = 1 << 17


def held_out(divisor: int, remainder: int) -> Column:
    """Whether crc32(doc_id as text) leaves this remainder."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def _features(c: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each word and word beginning of a lower-cased chunk, repeats included."""
    s, e = W.stripped(c)
    row = W.rows_of(c, np.arange(len(s)))
    ok = s < e
    s, e, row = s[ok], e[ok], row[ok]
    rows, found = [row], [W.hashes(c.data, s, e)]
    for n in BEGINNINGS:
        longer = e - s > n
        rows.append(row[longer])
        found.append(W.mix(W.hashes(c.data, s[longer], s[longer] + n) + np.uint64(n)))
    return np.concatenate(rows), (np.concatenate(found) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _first_by_hash(ids: DataFrame, most: int) -> DataFrame:
    """At most so many ids, the first by hash. The count tells where to cut, so that only about that many rows are sorted."""
    place = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 40))
    cut = min(1.0, (1.1 * most + 1000) / max(ids.count(), 1))
    return ids.where(place < int(cut * (1 << 40))).orderBy(place, "doc_id").limit(most)


def sample(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> tuple[DataFrame, float]:
    """(p, buckets) of the rows to learn from, p = 1 for confirmed toxic ones, and the class prior."""
    usable = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    usable = usable.where(~held_out(5, 0))
    share = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    chosen = _first_by_hash(usable.where("toxic = 1").select("doc_id"), positives).select("doc_id", F.lit(1).alias("p"))
    others = _first_by_hash(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull() & ~held_out(5, 0)), unlabelled)
    both = save(chosen.union(others.distinct().select("doc_id", F.lit(0).alias("p"))), "sample")  # the unlabelled hold positives too
    schema = pa.schema([("p", pa.int32()), ("buckets", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch, lower=True, limit=CHUNK):
                row, bucket = _features(c)
                key = np.unique(row * BUCKETS + bucket)
                ends = np.searchsorted(key, np.arange(c.rows.stop - c.rows.start + 1) * BUCKETS)
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((key % BUCKETS).astype(np.int32)))
                yield pa.record_batch([batch.column(1).slice(c.rows.start, len(lists)), lists], schema=schema)

    # at most positives + unlabelled ids: a bounded side
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(both), "doc_id").select("text", "p")
    return save(rows.mapInArrow(run, "p int, buckets array<int>"), "features"), float(share)


def _counted(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(f, b): in how many documents that aren't held out each wanted bucket occurs; f = -1 counts the documents. Tasks add up first."""
    schema = pa.schema([("f", pa.int32()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for c in W.chunks(batch, lower=True, limit=CHUNK):
                row, bucket = _features(c)
                ok = wanted[bucket]
                f, times = np.unique(np.unique(row[ok] * BUCKETS + bucket[ok]) % BUCKETS, return_counts=True)
                total[f] += times
                n += c.rows.stop - c.rows.start
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(-1, found).astype(np.int32)), pa.array(np.append(n, total[found]))], schema=schema)

    rest = docs.where(F.col("doc_id").isNotNull() & ~held_out(5, 0)).select("text")
    return rest.mapInArrow(run, "f int, b long").groupBy("f").agg(F.sum("b").alias("b"))


def _telling(rows: DataFrame, docs: DataFrame, most: int) -> DataFrame:
    """The features whose share among positives exceeds that among all documents most, by the likelihood ratio of two shares
    against one. Standard errors would call three of ten positives telling where six in two hundred documents are expected."""
    positives = rows.where("p = 1")
    counts = save(positives.select(F.explode("buckets").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("a")).where("a >= 3"), "positive_features")
    wanted = np.zeros(BUCKETS, bool)
    wanted[counts.select("f").toArrow()["f"].to_numpy()] = True  # BUCKETS rows at most
    among = save(_counted(docs, wanted), "shares")
    np_, nu = max(positives.count(), 1), max(sum(r["b"] for r in among.where("f = -1").collect()), 1)  # one row, none without documents
    counts = counts.join(among, "f", "left").withColumn("b", F.coalesce("b", F.lit(0)))
    a, b = F.col("a"), F.col("b")
    both = (a + b) / (np_ + nu)
    part = lambda k, of: F.when(k > 0, k * F.log(k / of)).otherwise(0.0)
    ratio = part(a, np_ * both) + part(np_ - a, np_ * (1 - both)) + part(b, nu * both) + part(nu - b, nu * (1 - both))
    z = F.signum(a / np_ - b / nu) * F.sqrt(2 * F.greatest(ratio, F.lit(0.0)))
    return counts.where(z >= LEAST_Z).orderBy(F.desc(z), "f").limit(most).select("f", ((F.col("b") / nu) / (F.col("a") / np_)).alias("share"), z.alias("z"))


def fit(p: np.ndarray, rows: np.ndarray, columns: np.ndarray, width: int, prior: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier. p: 1 for positives, 0 for unlabelled; (rows, columns): the features present."""
    rng = np.random.Generator(np.random.PCG64(seed))
    begin = np.searchsorted(rows, np.arange(len(p) + 1))
    pos, unl = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
    w, b, lr = np.zeros(width), np.log(prior / (1 - prior)), 0.05
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def part(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = begin[ids + 1] - begin[ids]
        r = np.repeat(np.arange(len(ids)), size)
        c = columns[np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size) + begin[ids][r]]
        return r, c, np.bincount(r, w[c], len(ids)) + b

    def pull(r: np.ndarray, c: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(c, slope[r], width), slope.sum()) / max(len(slope), 1)

    share = min(1.0, BATCH / len(p))
    draw = lambda ids: rng.choice(ids, max(1, round(share * len(ids))), replace=False)
    for step in range(1, STEPS + 1):
        iu, ip = draw(unl), draw(pos)
        ru, cu, zu = part(iu)
        rp, cp, zp = part(ip)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative = pull(ru, cu, sigmoid(zu)) - prior * pull(rp, cp, sigmoid(zp))
        # a corrected risk below zero is over-fitted: step back from it
        g = prior * pull(rp, cp, -sigmoid(-zp)) + as_negative if negative >= 0 else -as_negative
        g[:-1] += 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def learn(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> tuple[np.ndarray, float]:
    """A weight for each bucket, and the bias."""
    small_batches(docs.sparkSession)
    rows, prior = sample(docs, labels, positives, unlabelled)
    prior = min(max(prior, 1e-3), 0.5)
    weights, bias = np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    telling = save(_telling(rows, docs, FEATURES), "telling")
    told = telling.toArrow()
    names = np.sort(told["f"].to_numpy())
    if len(names):
        # among the unlabelled a feature is at least prior times as frequent as among positives: labels may overstate the prior
        best = np.argsort(-told["z"].to_numpy(), kind="stable")[:10]
        prior = min(prior, max(float(np.median(told["share"].to_numpy()[best])), 1e-3))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            ok = np.isin(flat, names)
            ends = np.append(0, np.cumsum(ok))[np.append(0, np.cumsum(sizes))]
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[ok]))], names=["p", "f"])

    got = rows.mapInArrow(chosen, "p int, f array<int>").toArrow().combine_chunks()
    p = got["p"].to_numpy()
    if not len(names) or not p.any() or p.all():
        return weights, bias
    lists = got["f"].combine_chunks() if isinstance(got["f"], pa.ChunkedArray) else got["f"]
    sizes = np.array([0 if n is None else n for n in pa.compute.list_value_length(lists).to_pylist()])
    flat = lists.flatten().to_numpy()
    # a fixed order of rows, whatever task read them first
    key = np.array([hash_row(p[i], flat[a - n : a]) for i, (a, n) in enumerate(zip(np.cumsum(sizes), sizes, strict=True))])
    order = np.argsort(key, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    rows_ = np.repeat(np.arange(len(p)), sizes[order])
    inside = np.arange(len(rows_)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
    columns = np.searchsorted(names, flat[starts[rows_] + inside])
    fits = [fit(p[order], rows_, columns, len(names), prior, seed) for seed in range(CLASSIFIERS)]
    weights[names] = np.mean([w for w, _ in fits], axis=0)
    return weights, float(np.mean([b for _, b in fits]))


def hash_row(p: int, features: np.ndarray) -> int:
    return int(W.mix(np.sort(features).astype(np.uint64) + np.uint64(p)).sum(dtype=np.uint64))


def _scores(batch: pa.RecordBatch, weights: np.ndarray, bias: float) -> Iterator[tuple[slice, np.ndarray]]:
    present = weights != 0
    for c in W.chunks(batch, lower=True, limit=CHUNK):
        row, bucket = _features(c)
        ok = present[bucket]
        key = np.unique(row[ok] * BUCKETS + bucket[ok])
        z = bias + np.bincount(key // BUCKETS, weights[key % BUCKETS].astype(np.float64), c.rows.stop - c.rows.start)
        yield c.rows, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of all rows; equal texts get equal scores."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, s in _scores(batch, weights, bias):
                yield pa.record_batch([batch.column(0).slice(rows.start, len(s)).cast(pa.int64()), s], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    weights, bias = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, s in _scores(batch, weights, bias):
                yield batch.slice(rows.start, len(s)).filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from a score of 0.5)."""
    weights, bias = learn(docs, labels, positives, unlabelled)
    return score(docs, weights, bias).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
