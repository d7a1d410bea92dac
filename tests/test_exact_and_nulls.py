"""Exact amounts, rows with missing keys, and streams that don't depend on how rows arrive."""

import decimal
import random

import pytest
from pyspark.sql import functions as F

from factweave.operators import certify, facts, filings, graph, ordered, runs, text
from factweave.sources import acquisition
from factweave.streaming import jobs

FACT = "id string, ticker string, concept string, roles array<string>, value string, scale string, unit string, currency string, dimensions map<string,string>, period struct<start:date,end:date,kind:string,fiscal_year:int,fiscal_period:string>, path string, ordinal long"


@pytest.mark.parametrize(("value", "scale", "status", "amount"), [
    ("5", "0.001", "ok", "0.005"), ("1.23456", "1", "ok", "1.23456"), ("0.00004", "1", "ok", "0.00004"), ("12345678901234567.5", "1", "ok", "12345678901234567.5"),
    ("-1.5e3", None, "ok", "-1500"), ("+7.", "1000", "ok", "7000"), (".5", "1", "ok", "0.5"), ("-0.000", "1e9", "ok", "0"), ("1e27", "1", "ok", "1" + "0" * 27),
    ("1e28", "1", "not_exact", None), ("0.0000000001", "1", "not_exact", None), ("9" * 38, "9", "not_exact", None), ("NaN", "1", "nonfinite", None), (" Infinity ", "1", "nonfinite", None),
    ("", "1", "invalid_value", None), (".", "1", "invalid_value", None), ("1,000", "1", "invalid_value", None), (None, "1", "invalid_value", None), ("1", "x", "invalid_value", None),
])
def test_amounts_are_exact_or_say_why(spark, value, scale, status, amount):
    r = facts.with_amount(spark.createDataFrame([(value, scale)], "value string, scale string")).first()
    assert r.value_status == status and r.amount == (None if amount is None else decimal.Decimal(amount))


def test_a_fact_without_end_is_not_the_latest(spark):
    period = lambda end, year: (None, end, "duration", year, "FY")
    import datetime
    rows = [("a", "T", "us-gaap:Revenues", ["revenue"], "1", "1", "USD", "USD", {}, period(None, 2024), "p", 1), ("b", "T", "us-gaap:Revenues", ["revenue"], "2", "1", "USD", "USD", {}, period(datetime.date(2024, 12, 31), 2024), "p", 2)]
    f = spark.createDataFrame(rows, FACT)
    req = spark.createDataFrame([(1, "T", "revenue", None, None)], "question_id long, ticker string, role string, year int, fiscal_period string")
    assert facts.direct_fact(req, f).first().fact.id == "b"


def test_rows_with_missing_keys_stay(spark):
    rows = [(1, "A", 1), (2, "A", None), (3, None, 1), (4, None, 2), (5, "A", 2)]
    x = spark.createDataFrame(rows, "id int, k string, t int")
    near = ordered.with_neighbors(x, ["k"], F.floor(F.col("t") / 64), ["t"], ["id"]).collect()
    assert sorted(r.id for r in near) == [1, 2, 3, 4, 5] and {r.id: r.prior and r.prior.id for r in near} == {1: 2, 2: None, 3: None, 4: 3, 5: 1}
    total = ordered.with_running(x, ["k"], F.col("t"), ["t"], F.lit(1), "n").collect()
    assert {r.id: r.n for r in total} == {1: 2, 2: 1, 3: 1, 4: 2, 5: 3}


def test_timeline_keeps_undated_filings(spark):
    import datetime
    d = datetime.date(2024, 1, 1)
    f = spark.createDataFrame([("1", "A", d, "x"), ("2", "A", None, "y"), ("3", None, d, "z"), ("4", "A", d.replace(month=5), "w")], "id string, ticker string, filing_date date, accession string")
    assert sorted(r.id for r in filings.timeline(f).collect()) == ["1", "2", "3", "4"]


def test_scale_errors_of_any_power(spark):
    x = spark.createDataFrame([(2.5e9, 2.5), (2.5, 2.5e12), (2.5, 2.5), (-2.5, 2.5), (7.0, 2.5), (1.0, 0.0)], "p double, g double")
    got = [r[0] for r in x.select(certify.gold_class(F.col("p"), F.col("g"), F.array().cast("array<double>"), F.lit(0.005))).collect()]
    assert got == ["scale", "scale", "correct", "sign", "fabricated", "fabricated"]


def test_last_overlay_row_wins(spark):
    n = spark.createDataFrame([("a", "10-K", "old")], "id string, form string, preview string")
    o = spark.createDataFrame([("a", 1, "finance.filing", "zz", "zz"), ("a", 2, "finance.filing", "aa", "bb")], "id string, position int, type string, form string, preview string")
    assert graph.node_overlay(n, o).first()[:] == ("a", "aa", "bb")


def test_excerpt_of_a_question_without_terms(spark):
    docs = spark.createDataFrame([("p", "Some text of a filing.\n\nMore of it.")], "path string, text string")
    none = acquisition.structured_facts(docs)
    assert text.filing_excerpts(docs, none, "why is it so").first().excerpt.startswith("Some text")


EVENTS = "vault string, turn long, position int, cache_hit boolean, source_key string, content_hash string"


def _in_files(spark, rows, schema, path, n):
    rows = list(rows)
    random.Random(n).shuffle(rows)
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_streams_don_t_depend_on_batches(spark, tmp_path):
    rng = random.Random(2)
    ev = [("v", t, p, bool(rng.randrange(2)), f"s{rng.randrange(3)}", f"h{rng.randrange(2)}") for t in range(30) for p in range(4)]
    req = [(i, "k", 1000 + i * 37 + rng.randrange(30), i % 5 == 0) for i in range(120)]
    trades = [(i, "A", 1_600_000_000 + i * 40_000, float(i)) for i in range(60)]
    ans = [(f"q{i // 2}", ["web", "local"][i % 2], "failed" if i % 7 == 0 else "ok", i) for i in range(21)]
    out = {}
    for n in (1, 5):
        at = lambda x: F.struct("turn", (-F.col("position")).alias("p"))
        e = lambda name: _in_files(spark, ev, EVENTS, tmp_path / f"{name}{n}", n).withColumn("at", at(0))
        q = _in_files(spark, req, "request_id long, key string, sec long, warned boolean", tmp_path / f"r{n}", n).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        t = _in_files(spark, trades, "event_id long, ticker string, s long, value double", tmp_path / f"t{n}", n).withColumn("ts", F.timestamp_seconds("s"))
        a = _in_files(spark, ans, "q string, agent string, status string, n long", tmp_path / f"a{n}", n)
        frames = [jobs.evidence_usage(e("u")), jobs.source_versions(e("v").drop("at", "cache_hit")), jobs.research_reuse(q), jobs.price_bars(t), jobs.answer_events(a, ["q"], ["web", "local"])]
        out[n] = [sorted(map(str, f.collect())) for f in frames]
    assert out[1] == out[5] and all(out[1])
    finals = [x for x in out[1][4] if "final" in x]
    assert len(finals) == 10 and sum("status='failed'" in x for x in finals) == 3
    turns = {(t, s) for _, t, _, _, s, _ in ev}
    assert sum(int(x.split("use_count=")[1].split(",")[0]) for x in out[1][0]) == len(turns)


def test_turn_versions_start_at_one(spark):
    e = spark.createDataFrame([("v", "s", 1, None), ("v", "s", 2, "a"), ("v", "s", 3, "a")], "vault string, source_key string, turn long, content_hash string")
    assert [r.version for r in runs.turn_versions(e).orderBy("turn").collect()] == [1, 2, 2]


def test_reuse_of_a_key_without_pause_over_days(spark):
    rng = random.Random(3)
    rows, t = [], 86_400 * 5 - 400
    while t < 86_400 * 8:
        t += rng.choice([5, 40, 200, 600])
        rows += [(len(rows), rng.choice(["a", None]), t, rng.random() < 0.2)]
    until, want = {}, {}
    for i, k, sec, warned in rows:
        want[i] = sec < until.get(k, -1)
        if not want[i]:
            until[k] = sec + (60 if warned else 900)
    r = spark.createDataFrame(rows, "request_id long, key string, sec long, warned boolean").withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    assert {x.request_id: x.hit for x in runs.research_reuse(r).collect()} == want


def test_filings_of_several_companies(spark):
    import datetime
    f = spark.createDataFrame([(f"{t}{i}", t, "10-Q" if i % 4 else "10-K", 2000 + i // 4, datetime.date(2000 + i // 4, 1 + i % 4, 1), i) for t in "AB" for i in range(40)], "id string, ticker string, form string, fiscal_year int, filing_date date, ordinal long")
    req = spark.createDataFrame([(1, "A", [2003]), (2, "A", []), (2, "B", [])], "question_id long, ticker string, years array<int>")
    got = filings.retrieval_filings(req, f, 4, 2).collect()
    by = lambda q, t: [r.id for r in sorted(got, key=lambda r: r["rank"]) if (r.question_id, r.ticker) == (q, t)]
    assert by(1, "A") == ["A15", "A12", "A36", "A14"] and len(by(2, "A")) == len(by(2, "B")) == 2
