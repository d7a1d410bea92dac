"""Fail-closed binding of annual facts: a small set of measurements and one change per case."""

import datetime

import pytest
from pyspark.sql import functions as F

from factweave import schemas
from factweave.operators import facts as op
from factweave.operators import questions as qop

CONCEPT = {"revenue": "Revenues", "operating_income": "OperatingIncomeLoss", "net_income": "NetIncomeLoss", "operating_cash_flow": "NetCashProvidedByUsedInOperatingActivities"}
QUESTION = "Show the operating leverage across FY2024 and FY2025"


def fact(role, year, value, scale="1000000", ticker="TEST", start=None, period="FY", ordinal=0, **other):
    end = datetime.date(year, 12, 31) if period == "FY" else datetime.date(year, 3, 31)
    row = dict(
        id=f"{ticker}:{role}:{year}:{period}:{value}", ticker=ticker, concept="us-gaap:" + CONCEPT[role], roles=[role], value=value, scale=scale, unit="USD", currency="USD",
        dimensions={}, period=dict(start=start or datetime.date(year, 1, 1), end=end, kind="duration", fiscal_year=year, fiscal_period=period), path=f"filings/{ticker}/annual.yml", content_hash="v1", ordinal=ordinal)
    row.update(other)
    return row


def base(ticker="TEST", last="18"):
    return [fact("revenue", 2024, "100", ticker=ticker), fact("operating_income", 2024, "10000000", "1", ticker=ticker), fact("revenue", 2025, "120", ticker=ticker), fact("operating_income", 2025, last, ticker=ticker)]


CASES = {
    "plain": (base(), QUESTION),
    "higher": (base(last="20"), QUESTION),
    "missing year": (base(), "Show the operating leverage across FY2022 and FY2025"),
    "currency": (base()[:3] + [fact("operating_income", 2025, "18", currency="EUR")], QUESTION),
    "unit": (base()[:3] + [fact("operating_income", 2025, "18", unit="shares")], QUESTION),
    "nonfinite": (base()[:3] + [fact("operating_income", 2025, "NaN")], QUESTION),
    "scale": (base()[:3] + [fact("operating_income", 2025, "18", scale="unknown")], QUESTION),
    "dimension": (base()[:3] + [fact("operating_income", 2025, "18", dimensions={"segment": "x"})], QUESTION),
    "short": (base()[:3] + [fact("operating_income", 2025, "18", start=datetime.date(2025, 4, 1))], QUESTION),
    "conflict": (base() + [fact("operating_income", 2025, "99", ordinal=1)], QUESTION),
    "same value twice": (base() + [fact("operating_income", 2025, "18000000", "1", ordinal=1)], QUESTION),
    "no income": ([fact("operating_cash_flow", 2025, "50"), fact("net_income", 2025, "0")], "What was the cash conversion in FY2025?"),
    "loss": ([fact("operating_cash_flow", 2025, "50"), fact("net_income", 2025, "-10")], "What was the cash conversion in FY2025?"),
}


@pytest.fixture(scope="module")
def report(spark):
    """All cases in one job: the case is the ticker."""
    facts = [dict(f, ticker=name, id=f"{name}:{i}") for name, (fs, _) in CASES.items() for i, f in enumerate(fs)]
    f = spark.createDataFrame(facts, schemas.FACTS)
    q = spark.createDataFrame([(i, name, text) for i, (name, (_, text)) in enumerate(CASES.items())], "question_id long, ticker string, question string")
    rows = op.annual_report(qop.annual_requests(q), f).orderBy("ticker", "fiscal_year").collect()
    return {name: [r for r in rows if r.ticker == name] for name in CASES}


def test_incremental_margin_and_change(report):
    last = report["plain"][-1]
    assert last.incremental == pytest.approx(40.0) and last.delta == pytest.approx(500.0) and last.question_hit
    assert report["higher"][-1].incremental == pytest.approx(50.0)


def test_scaled_values_are_equal_facts(report):
    assert report["same value twice"][-1].question_hit


@pytest.mark.parametrize("case,reason", [
    ("missing year", "missing binding: revenue"), ("currency", "not in USD"), ("unit", "not in USD"), ("nonfinite", "nonfinite measurement"), ("scale", "invalid value or scale"),
    ("dimension", "missing binding: operating_income"), ("short", "missing binding: operating_income"), ("conflict", "conflicting facts: operating_income")])
def test_unsafe_input_is_rejected_with_a_reason(report, case, reason):
    assert report[case] and not report[case][0].question_hit and report[case][0].question_reason == reason


def test_ratio_without_meaning(report):
    for case in ("no income", "loss"):
        assert report[case][0].ratio is None and report[case][0].ratio_status.startswith("not meaningful")


def test_cash_binding_needs_the_same_period(spark):
    f = spark.createDataFrame([fact("operating_cash_flow", 2025, "100"), fact("net_income", 2025, "50"), fact("operating_cash_flow", 2025, "15", period="Q1")], schemas.FACTS)
    rows = op.cash_bindings(f).collect()
    assert len(rows) == 1 and rows[0].ratio == pytest.approx(2.0)


def test_several_companies_all_or_nothing(spark):
    names = ["MSFT", "AAPL", "GOOG"]
    f = spark.createDataFrame([r for n in names for r in base(n)], schemas.FACTS)
    pos = [(q, n, i) for q, ns in ((1, names), (2, ["MSFT", "NONE"])) for i, n in enumerate(ns)]
    q = spark.createDataFrame([(i, n, QUESTION) for i, n, _ in pos], "question_id long, ticker string, question string")
    p = spark.createDataFrame(pos, "question_id long, ticker string, position int")
    got = {r.question_id: r for r in op.multi_company(op.annual_rows(qop.annual_requests(q), f), p).collect()}
    assert got[1].hit and got[1].n_bindings == 12
    assert not got[2].hit and got[2].reason == "NONE: missing binding: revenue"


def test_calculation_key_follows_the_evidence(spark):
    q = spark.createDataFrame([(1, "A", QUESTION), (2, "B", QUESTION)], "question_id long, ticker string, question string")
    key = lambda rows: {r.ticker: r.calc_key for r in op.calculation_key(op.annual_report(qop.annual_requests(q), spark.createDataFrame(rows, schemas.FACTS))).collect()}
    one, two = key(base("A") + base("B")), key(base("A") + base("B", last="20"))
    assert one["A"] == two["A"] and one["B"] != two["B"] and one["A"].startswith("annual-v1:")


def test_plain_numbers_are_not_taken_apart(spark):
    import decimal

    from factweave.functions import fixed

    rows = [("1.5", None), ("-0012.340", "0.01"), ("1" * 19 + ".123456", "9999.999"), ("2e3", "1"), ("9" * 20, "1"), ("nan", "1"), ("nan", "0"), ("1.5", "0.0000000001"), ("x", "1"), (None, "1"), ("1 ", "1")]
    got = op.with_amount(spark.createDataFrame(rows, "value string, scale string"))
    # numbers of other forms alone are taken apart by patterns, inside a lambda, out of the generated code of the step
    lines = [x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if fixed.NUMBER_TEXT in x]
    assert lines and all("lambda" in x for x in lines)
    d = decimal.Decimal
    with decimal.localcontext(prec=60):
        big = d("1" * 19 + ".123456") * d("9999.999")
    assert [(r.amount, r.value_status) for r in got.collect()] == [
        (d("1.5"), "ok"), (d("-0.1234"), "ok"), (big, "ok"), (d(2000), "ok"), (d("9" * 20), "ok"), (None, "nonfinite"), (d(0), "nonfinite"), (None, "not_exact"),
        (None, "invalid_value"), (None, "invalid_value"), (d(1), "ok")]
