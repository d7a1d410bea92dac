"""Chunked windows equal plain windows; reuse, usage, audit and scrubbing."""

import datetime
import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from factweave.operators import certify as cert
from factweave.operators import ordered
from factweave.operators import runs as op


def test_chunked_windows_equal_plain_windows(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([("hot" if rnd.random() < 0.7 else f"k{rnd.randint(0, 4)}", i, rnd.randint(0, 9)) for i in range(400)], "k string, t int, v int")
    w = W.partitionBy("k").orderBy("t")
    plain = df.select("k", "t", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"), F.sum("v").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("s"))
    a = ordered.with_neighbors(df, ["k"], F.floor(F.col("t") / 7), ["t"], ["v"])
    b = ordered.with_running(a, ["k"], F.floor(F.col("t") / 5), ["t"], F.col("v"), "s").select("k", "t", F.col("prior.v").alias("p"), F.col("next.v").alias("n"), "s")
    key = lambda r: (r.k, r.t)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, b.collect()))


def test_reuse_equals_a_walk_in_time_order(spark):
    rnd, at, rows = random.Random(5), datetime.datetime(2024, 1, 1), []
    for i in range(300):
        at += datetime.timedelta(seconds=rnd.choice([0, 1, 30, 59, 61, 400, 899, 1000]))
        rows.append((i, rnd.choice("ab"), at, rnd.random() < 0.3))
    until, want = {}, {}
    for i, key, ts, warned in rows:
        sec = int(ts.timestamp())
        want[i] = sec < until.get(key, -1)
        if not want[i]:
            until[key] = sec + (60 if warned else 900)
    got = op.research_reuse(spark.createDataFrame(rows, "request_id long, key string, ts timestamp, warned boolean")).collect()
    assert {r.request_id: r.hit for r in got} == want


def test_unknown_usage_is_no_zero(spark):
    df = spark.createDataFrame([("a", 11, 7, None), ("b", None, None, None), ("c", 1, 2, 3), ("c", 5, None, None), ("d", -1, 2, None)], "k string, prompt_tokens int, completion_tokens int, total_tokens int")
    got = {r.k: (r.total_tokens, r.usage_complete) for r in op.usage_totals(df, ["k"]).collect()}
    assert got == {"a": (18, True), "b": (None, False), "c": (None, False), "d": (None, False)}


def test_panel_status(spark):
    rows = [("41.77", 41.772881, True, False), ("41.78", 41.772881, True, False), (None, 1.0, True, False), ("1.0", 1.0, False, False), ("1.0", 1.0, True, True), ("287", 287.141894, True, False)]
    df = spark.createDataFrame(rows, "token string, expected double, ok boolean, inconsistent boolean").withColumn("scale", F.lit(1.0))
    assert [r.status for r in op.panel_audit(df).collect()] == ["correct", "incorrect", "omitted", "unavailable", "inconsistent", "correct"]


def test_scrub_at_any_depth(spark):
    df = spark.sql("select named_struct('Authorization', 'x', 'm', named_struct('headers', 1, 'ok', 2), 'l', array(named_struct('api_key', 1, 'k', 2))) as r, 's' as api_key")
    assert op.scrub(df).schema.simpleString() == "struct<r:struct<m:struct<ok:int>,l:array<struct<k:int>>>>"


def test_margin_certificate(spark):
    box = "391034500000D as a_lo, 391035500000D as a_hi, 210351500000D as b_lo, 210352500000D as b_hi"
    df = spark.sql(f"select 0.462D as value, '3' as decimals, {box} union all select 0.481D, '3', {box} union all select 4.62D, '2', {box} union all select 0.462D, '3', null, null, 1D, 2D union all select 0.4D, '1', -1D, 1D, 0D, 0D")
    assert [r.verdict for r in cert.certify_margins(df).collect()] == ["certified", "inconsistent", "inconsistent", "unknown_fact", "undefined_denominator"]


def test_bootstrap_brackets_the_mean(spark):
    df = spark.createDataFrame([(f"c{i}", float(10 * i), 10) for i in range(40)], "cluster string, total double, n int")
    r = cert.cluster_bootstrap(df).first()
    assert r.replicates == 200 and r.low < 19.5 < r.high
