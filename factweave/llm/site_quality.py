"""Document quality by hierarchical empirical Bayes: a text classifier, and what its host and path are known for.

Three levels stand over a document: all documents, its host, its path on that host. At each level the labelled documents
count as Bernoulli trials, and the parent's posterior mean is the prior of the child: Beta(k * mean, k * (1 - mean)). The
strength k of the host and path level is estimated from the data by moments (the spread of the rates beyond their sampling
error), so a level that tells nothing shrinks its sites almost wholly to the parent, and a site with few labels too. A naive
Bayes classifier over word features gives the document's own evidence as a log likelihood ratio, tempered to the
reliability that it shows on the labels; the posterior adds it to the path's log odds.

Levels are grouped aggregates over all labels. The classifier is learned from counts in at most ``TRAINING`` labelled
documents, chosen by the hash of their id.

Defined results: a null or empty text has no evidence of its own and gets its path's posterior; a null host or path is a site of
its own; several labels of one document are reduced to their mean, rounded (half is good); labels without id or value are
ignored; without labels every posterior is one half; equal rows get equal results; a row with a null doc_id is scored
like any other; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm import words as W
from factweave.llm.storage import save, small_batches

BUCKETS = 1 << 14
TRAINING = 50_000
#: Evidence of a document is the mean over its features times this many, so that long texts don't outvote everything.
FEATURES_COUNTED = 30.0
WEAKEST, STRONGEST = 2.0, 1000.0


def _features(c: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of what a chunk's texts show: shapes of words, word beginnings, repeats of lines' and windows' words."""
    s, e = W.stripped(c)
    row = W.rows_of(c, np.arange(len(s)))
    data, words = c.data, np.diff(c.first)
    length = np.minimum(c.ends - c.starts, 30)
    edge = (e - s) < (c.ends - c.starts)
    odd = ~((data >= 97) & (data <= 122) | (data >= 128))
    odds = np.append(0, np.cumsum(odd))
    shape = length * 64 + np.minimum(odds[c.ends] - odds[c.starts], 7) * 8 + edge * 4 + (s >= e) * 2
    last = np.where(len(data) > 0, data[c.ends - 1] if len(c.ends) else 0, 0)
    found = [(row, W.mix(shape.astype(np.uint64))), (row, W.mix(last.astype(np.uint64) + np.uint64(1 << 20)))]
    windows, at = c.windows(3)
    if len(at):
        r = W.rows_of(c, at)
        key = W.mix(windows ^ r.astype(np.uint64))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        found.append((r, W.mix(np.minimum(count[which], 9).astype(np.uint64) + np.uint64(1 << 21))))
    size = np.flatnonzero(words)
    found.append((np.repeat(size, 5), W.mix(np.repeat(np.log2(words[size]).astype(np.uint64) + np.uint64(1 << 22), 5))))
    rows, h = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    return rows, (h & np.uint64(BUCKETS - 1)).astype(np.int64)


def _labels(labels: DataFrame) -> DataFrame:
    good = F.when(F.avg("quality") >= 0.5, 1).otherwise(0)
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("y"))


def feature_counts(docs: DataFrame, labelled: DataFrame, most: int = TRAINING) -> DataFrame:
    """(y, f, n): how often each feature occurs in the good and in the bad labelled documents."""
    schema = pa.schema([("y", pa.int32()), ("f", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy()
            for c in W.chunks(batch, lower=True):
                row, f = _features(c)
                for v in (0, 1):
                    total[v] += np.bincount(f[y[c.rows][row] == v], minlength=BUCKETS)
        for v in (0, 1):
            f = np.flatnonzero(total[v])
            yield pa.record_batch([np.full(len(f), v, np.int32), f.astype(np.int32), total[v][f]], schema=schema)

    chosen = F.broadcast(labelled.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(most))  # a bounded side
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("text", "y")
    return rows.mapInArrow(count, "y int, f int, n long").groupBy("y", "f").agg(F.sum("n").alias("n"))


def evidence(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """doc_id, host, path and the log likelihood ratio of each document's own text."""
    got = counts.toArrow()  # 2 * BUCKETS rows at most
    n = np.ones((2, BUCKETS))
    n[got["y"].to_numpy(), got["f"].to_numpy()] += got["n"].to_numpy()
    ratio = (np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())).astype(np.float32)
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("own", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in W.chunks(batch, lower=True):
                row, f = _features(c)
                k = c.rows.stop - c.rows.start
                many = np.bincount(row, minlength=k)
                own = np.bincount(row, ratio[f], k) / np.maximum(many, 1) * FEATURES_COUNTED
                yield pa.record_batch([*[batch.column(i).slice(c.rows.start, k).cast(schema.field(i).type) for i in range(3)], own], schema=schema)

    return docs.select("doc_id", "host", "path", "text").mapInArrow(run, "doc_id long, host string, path string, own double")


def _strength(sites: DataFrame, prior: Column) -> Column:
    """Moment estimate of a level's Beta strength from (n, good) of its sites and their prior means."""
    rate = F.col("good") / F.col("n")
    between = F.sum(F.col("n") * F.pow(rate - prior, 2)) - F.sum(prior * (1 - prior))
    room = F.sum((F.col("n") - 1) * prior * (1 - prior))
    share = F.least(F.greatest(between / room, F.lit(1 / (1 + STRONGEST))), F.lit(1 / (1 + WEAKEST)))  # the correlation inside a site
    return F.coalesce(1 / share - 1, F.lit(STRONGEST))


def site_posteriors(labelled: DataFrame) -> DataFrame:
    """labelled(host, path, y) -> (host, path, path_mean, host_mean, global_mean): posterior rates of good documents."""
    paths = save(labelled.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")), "paths")
    whole = paths.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("g")).first()["g"] or 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    k = hosts.agg(_strength(hosts, F.lit(whole)).alias("k")).first()["k"]
    means = hosts.select(F.col("host").alias("site"), ((F.col("good") + k * whole) / (F.col("n") + k)).alias("host_mean"))
    paths = paths.join(means, F.col("host").eqNullSafe(F.col("site"))).drop("site")
    k = paths.agg(_strength(paths, F.col("host_mean")).alias("k")).first()["k"]
    return paths.select("host", "path", "host_mean", ((F.col("good") + k * F.col("host_mean")) / (F.col("n") + k)).alias("path_mean"), F.lit(whole).alias("global_mean"))


def site_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, host, path, text) -> one row per document: doc_id, host, path, own, path_mean, posterior, kept.

    own is the tempered evidence of the text in log odds; a site without labels has its host's mean, or the global one.
    """
    small_batches(docs.sparkSession)
    y = _labels(labels)
    own = save(evidence(docs, feature_counts(docs, y)), "evidence")
    labelled = save(own.join(y, "doc_id"), "labelled")
    sites = save(site_posteriors(labelled), "sites")
    r = labelled.agg(F.avg(F.when(F.col("y") == 1, F.col("own"))).alias("a"), F.avg(F.when(F.col("y") == 0, F.col("own"))).alias("b"), F.var_samp(F.when(F.col("y") == 1, F.col("own"))).alias("va"), F.var_samp(F.when(F.col("y") == 0, F.col("own"))).alias("vb")).first()
    # two normal densities with a common spread: slope and middle of the calibrated log odds
    known = r["a"] is not None and r["b"] is not None and r["a"] > r["b"]
    spread = max(((r["va"] or 0.0) + (r["vb"] or 0.0)) / 2, 1e-3) if known else 1.0
    slope, middle = ((r["a"] - r["b"]) / spread, (r["a"] + r["b"]) / 2) if known else (0.0, 0.0)
    whole = (sites.select("global_mean").first() or [0.5])[0]
    hosts = sites.groupBy("host").agg(F.first("host_mean").alias("hm"))
    x = own.join(sites.select("host", "path", "path_mean").withColumnsRenamed({"host": "h", "path": "p"}), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    x = x.join(hosts.withColumnRenamed("host", "hh"), F.col("host").eqNullSafe(F.col("hh")), "left")
    mean = F.coalesce("path_mean", "hm", F.lit(whole))
    tempered = F.when(F.col("own") == 0, 0.0).otherwise(F.greatest(F.lit(-12.0), F.least(F.lit(12.0), slope * (F.col("own") - middle))))
    out = x.select("doc_id", "host", "path", tempered.alias("own"), mean.alias("path_mean"))
    posterior = 1 / (1 + F.exp(-(F.log(F.col("path_mean") / (1 - F.col("path_mean"))) + F.col("own"))))
    return out.withColumn("posterior", posterior).withColumn("kept", posterior >= 0.5)
