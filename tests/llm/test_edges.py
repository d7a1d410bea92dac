"""Pseudonyms against a plain Feistel network, and the pipeline on null, empty and repeated rows and on an empty table."""

import datetime
import hashlib
import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factweave.llm import words as W
from factweave.llm.pii import ROUNDS, pii
from factweave.llm.toxicity import LEAST_Z, _features, _telling, toxicity

ROOT = "/root/testdata/sf0.001"
FIRST_DAY = datetime.date(1700, 1, 1)
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="needs the shared tables")


def feistel(key, kind, left, right, a, b):
    for i in range(1, ROUNDS + 1):
        moved = lambda x, m: int(hashlib.sha256(f"{key}|{kind}|{i}|{a}|{b}|{x}".encode()).hexdigest()[:15], 16) % m
        if i % 2:
            left = (left + moved(right, a)) % a
        else:
            right = (right + moved(left, b)) % b
    return left, right


def plain_ip(key, v):
    o = [int(x) for x in v.split(".")]
    halves = feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
    return ".".join(f"{h // 256}.{h % 256}" for h in halves)


def plain_ssn(key, v):
    d = v.replace("-", "")
    left, right = feistel(key, "ssn", int(d[:4]), int(d[4:]), 10**4, 10**5)
    d = f"{left:04}{right:05}"
    return f"{d[:3]}-{d[3:5]}-{d[5:]}"


def plain_date(key, v):
    n = (datetime.date.fromisoformat(v) - FIRST_DAY).days
    left, right = feistel(key, "date", n // 773, n % 773, 189, 773)
    return (FIRST_DAY + datetime.timedelta(left * 773 + right)).isoformat()


def test_pseudonyms_equal_a_plain_network(spark):
    rng = random.Random(9)
    values = [(plain_ip, ".".join(str(rng.randint(0, 255)) for _ in range(4))) for _ in range(40)]
    values += [(plain_ssn, f"{rng.randint(0, 999):03}-{rng.randint(0, 99):02}-{rng.randint(0, 9999):04}") for _ in range(40)]
    values += [(plain_date, (FIRST_DAY + datetime.timedelta(rng.randrange(146_097))).isoformat()) for _ in range(40)]
    rows = [(i, f"see {v} there") for i, (_, v) in enumerate(values)]
    # one very long text holds them all
    rows.append((len(values), " and ".join(["plain words"] * 20_000 + [v for _, v in values])))
    out = {r.doc_id: r for r in pii(spark.createDataFrame(rows, "doc_id long, text string"), "k1").collect()}
    expected = [f("k1", v) for f, v in values]
    assert [out[i].text for i in range(len(values))] == [f"see {e} there" for e in expected]
    assert out[len(values)].text == " and ".join(["plain words"] * 20_000 + expected) and out[len(values)].n_replaced == len(values)


def _bucket(word):
    batch = pa.record_batch([pa.array([1]), pa.array([word])], names=["doc_id", "text"])
    return int(next(_features(c)[1][0] for c in W.chunks(batch, lower=True)))


def copied_tables(spark, folder, documents):
    documents.write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{ROOT}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@needs_tables
def test_pipeline_on_null_empty_and_repeated_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    kept = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, ROOT).collect()}
    some = docs.where(F.col("doc_id").isin(sorted(kept)[:5]))
    same = lambda i, text: some.limit(1).withColumn("doc_id", F.lit(i).cast(docs.schema["doc_id"].dataType)).withColumn("text", F.lit(text).cast("string"))
    odd = [same(10**9, None), same(10**9 + 1, ""), same(10**9 + 2, " \n\t"), same(None, None)]
    whole = docs.union(some)
    for o in odd:
        whole = whole.union(o)
    whole = whole.select("*", F.lit(7).alias("y"), F.lit("extra").alias("ids"))  # names that the stages use themselves
    folder = copied_tables(spark, tmp_path, whole)
    out = corpus_pipeline.run(spark, folder).collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids))  # a repeated row is kept once
    assert {10**9, 10**9 + 1, 10**9 + 2, None} <= set(ids)
    assert all(r.n_tokens == 0 for r in out if r.doc_id in (10**9, 10**9 + 1, None))
    # more rows are another table to learn from: exactly the documents that are toxic by the operator's own scores on it leave
    labels = spark.read.parquet(f"{ROOT}/labels.parquet")
    toxic = {r.doc_id for r in toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels).where("predicted = 1").collect()}
    lost = set(kept) - set(ids)
    assert lost <= toxic and not toxic & set(ids)
    assert {r.doc_id: list(r.ids) for r in out if r.doc_id in kept} == {i: x for i, x in kept.items() if i not in lost}


def test_features_of_a_few_positives_are_chance(spark):
    """Three of ten positives against six of two hundred documents: four standard errors, yet chance among many features."""
    rows = spark.createDataFrame([(1, [1, 2] if i < 3 else [1]) for i in range(10)], "p int, buckets array<int>")
    word = lambda i: {True: "common", False: "other"}[i < 6]
    docs = spark.createDataFrame([(i, word(i)) for i in range(200)], "doc_id long, text string")
    found = {r.f: r.z for r in _telling(rows, docs, 10).collect()}
    assert set(found) == {1, 2}  # neither is in any document: both telling
    assert found[1] > found[2] >= LEAST_Z
    bucket = _bucket("common")
    rows = spark.createDataFrame([(1, [bucket] if i < 3 else [7]) for i in range(10)], "p int, buckets array<int>")
    assert bucket not in {r.f for r in _telling(rows, docs, 10).collect()}


@needs_tables
def test_pipeline_of_an_empty_table(spark, tmp_path):
    empty = spark.read.parquet(f"{ROOT}/documents.parquet").where("false")
    assert corpus_pipeline.run(spark, copied_tables(spark, tmp_path, empty)).collect() == []
